"""Personal information in free text: typed mentions and a readable text with placeholders.

Regular expressions and cue words propose spans, checksums confirm identity numbers, and words nearby raise or
lower a span's score; spans below the threshold of their kind are let go. Each text is one row's own work, read
whole in a single pass for the cues and a few for the shapes, so nothing is shuffled but the mentions found.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# ---- Fixed values: words around mentions -------------------------------------------------------------------

#: Words before a person's name. Those of weight 2 introduce nothing but a name, in whatever letters; after those of
#: weight 1 a name needs its shape.
NAME_CUES = {
    **dict.fromkeys(
        "author:|correspondence:|correspondence to|checked by|signed by|reviewed by|prepared by|interview,|steward:|person:|board:|author=|name=|"
        "korrespondenz:|ansprechpartner ist|ansprechpartnerin ist|ansprechpartner:|rückfragen an|unterzeichnet von|"
        "correspondance :|correspondance:|remercions|joindre|contacter|signé par|"
        "correspondencia:|agradecemos a|llamar a|a nombre de|contactar a|firmado por|"
        "感谢|通讯作者:|通讯作者:|联系人:|联系人:|作者:".split("|"),
        2,
    ),
    **dict.fromkeys(
        "participant|patient|patient,|referee was|reviewer was|editor was|author was|supervisor|colleague|thank|thanks to|thanks go to|grateful to|indebted to|"
        "interview with|spoke with|spoke to|dear|sincerely,|regards,|yours,|contact|please ask|ask|write to|written by|collected by|provided by|"
        "conducted by|performed by|drawn by|translated by|approved by|edited by|led by|named|"
        "grüßen|danken|dank an|teilnehmer|teilnehmerin|patientin|gezeichnet|erhoben von|betreut von|"
        "cordialement,|salutations,|participante|patiente|rédigé par|relu par|atentamente,|saludos,|paciente|redactado por|revisado por".split("|"),
        1,
    ),
}
#: Words that make a name of what follows them with another word in between: "data go to", "signed the report as".
NAME_CUES_APART = re.compile(
    r"(?:(?:goes|go|sent|send|addressed|directed|returned) to|sign(?:s|ed|ing)?(?: \w+){0,3} as|(?:reprints?|copies|samples|data|code)(?: \w+){0,3} from)(?= )", re.I
)
APART_WORDS = ("goes", "go", "sent", "send", "addressed", "directed", "returned", "sign", "reprint", "copies", "samples", "data", "code")
TITLE_WORDS = ("dr", "prof", "mr", "mrs", "ms", "mx", "herr", "frau", "sr", "sra", "mme", "mlle")
#: Words after a person's name.
NAME_AFTER = {
    **dict.fromkeys(("died in", "'s comments", "’s comments", "recalled"), 2),
    **dict.fromkeys("wrote|said|replied|withdrew|kindly|lives|lived|agreed to|called|phoned|signed".split("|"), 1),
}
ID_CUES = (
    "national id|passport|orcid|dni|nif|nie|steuer-id|steueridentifikationsnummer|steuernummer|sozialversicherungsnummer|sécurité sociale|"
    "nir|social security|national insurance|insurance number|tax id|tax number|personalausweis|pasaporte|passeport|reisepass|"
    "id=|\"id\":|身份证号|身份证|护照"
).split("|")
PHONE_CUES = re.compile(
    r"(?:phone|tel|fax|call|ring|reach|mobile|dial|ruf|llamar|joindre|电话|传真|手机|\bfrom|\bon|\bau|\bal|\bat|call me at|\bor)[\s\"“:.,]*(?:[^\W\d_]+\s){0,1}$", re.I
)
PHONE_NOT = re.compile(
    r"(?:grant|sample|trial|isbn|issn|doi|arxiv|pp?\.|kennzeichen|orcid|steuer-id|sociale|dni|passport|national id|number|seed at|id=|gives|trn|no\.|nr\.|version|page)[\s\":=.-]*$", re.I
)
TITLE = re.compile(r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Mx|Herr|Frau|Sra?|Mme|Mlle)\b\.?\s)+", re.I)
PARTICLES = frozenset("da de del della der di do dos du la le van von den ten ter al el bin ibn".split())
#: Words of street names, before or after which a house number stands.
STREET_WORDS = (
    "street|road|lane|drive|close|avenue|terrace|court|crescent|square|gardens|grove|walk|way|st|rd|ave|ln|dr|"
    "straße|strasse|str.|weg|hof|gasse|platz|allee|ring|damm|ufer|rue|boulevard|place|allée|chemin|quai|impasse|cours|bd|av.|"
    "calle|c/|plaza|pza.|avda.|avenida|paseo|camino|ronda|travesía"
).split("|")
#: Words that end a name or can't be part of one.
STOP = frozenset(
    "and or the a an on in at of for from to by with who whom whose was were is are has had have did does would said says recalled wrote died "
    "that this these those as after before when while not but if then than so we our you your they their he she his her its it no both each all any "
    "about without during since because until "
    "anonymous referees referee reviewers reviewer editor editors authors author participants colleagues staff team members everyone us them "
    "withdrew signed phone fax tel orcid passport national flat apt room street road email mail id dni introduction methods results discussion "
    "conclusion conclusions background abstract keywords acknowledgements references bibliography appendix table figure section note notes "
    "und oder der die das ein eine für auf am im um zu zum zur mit nach bei aus wir uns den dem des ist sind war sei hinweise telefon gutachter gutachtern "
    "et ou les un une pour au aux sur dans avec par sa son ses leur qui que est sont nous relecture courriel ce cette "
    "y o los las un una su sus por para con en que es son lectura correo se lo "
    "one two three four five several many some few other independent human hand readers annotators raters coders lectores lecteurs leser zwei zwo deux dos "
    "institute institut instituto foundation centre center laboratory society collaboration university criterion index method archives".split()
)

# ---- Shapes ------------------------------------------------------------------------------------------------

_AT = re.compile(r"@|\(at\)|\[at\]| AT (?=[\w-]+ ?(?:\.|DOT|\[dot\]|\(dot\)))")
_LOCAL = re.compile(r"[A-Za-z0-9_][\w.+-]*$")
_HOST = re.compile(r"\s?[\w-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sDOT\s)[\w-]+)+", re.A)
_PHONE_RUN = re.compile(r"(?<![A-Za-z0-9_.,/+@-])(?:\+\d|\(\+?\d|\d)[\d ()./–-]{7,24}(?![\w])")
_PHONE = re.compile(
    r"\+\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,8}){1,5}"  # international
    r"|(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"  # North America
    r"|\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{2,6}){0,2}"  # area code in brackets
    r"|0\d{2,4} \d{3,8}(?: \d{2,6}){0,2}|0\d{2,4}/\d{4,8}(?:[ -]\d{2,4})?|0\d{2,4} \d{4,6}-\d{2,4}"  # trunk prefix and area code
    r"|0\d(?:([ .]?)\d\d)(?:\1\d\d){3}|0\d{9,10}"
)
_ID_VALUE = re.compile(
    r"\d{17}[\dX](?![\dX])|\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{3}[\dX](?!\d)|\d ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?!\d)|\d{2} ?\d{3} ?\d{3} ?\d{3}(?! ?\d)|"
    r"[XYZ][- ]?\d{7}[- ]?[A-Z]\b|\d{8}[- ]?[A-Z]\b|\d{3}[- ]?\d{2}[- ]?\d{4}(?!\d)|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]\b|"
    r"[A-Z]{1,2} ?\d{3} ?\d{3,5}(?!\d)|[A-Z]{1,2}\d{6,9}(?!\d)"
)
_ID_GAP = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|n°|num\.?))?[\s:=#(\"]{0,4}", re.I)
#: Shapes that are proposed without a label.
_ID_FREE = re.compile(
    r"(?<![\w/.+-])(?:\d{17}[\dX]|\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{3}[\dX]|\d ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}|\d{2} \d{3} \d{3} \d{3}|\d{11}|"
    r"\d{3}[- ]\d{2}[- ]\d{4}|[XYZ]-?\d{7}-?[A-Z]|\d{8}[- ]?[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2} \d{3} \d{3,5}|[A-Z]{1,2}\d{6,9})(?![\w-]|[.,/]\d)"
)
#: Where such a shape may begin.
_ID_START = re.compile(r"(?<![\w/.+-])(?:[A-Z]{1,2}[ -]?)?\d[\d -]{5,}")
_ID_NEAR = re.compile(r"\b(?:id|ids|identity|identification|identifier|passport|tax|insurance|social|payroll|personnel|form|ausweis|steuer|identit[éy]|identidad|fiscal|orcid)\b", re.I)
_ID_NOT = re.compile(r"(?:grant|sample|trial|isbn|issn|trn|phone|tel|fax|call|ring|doi|arxiv|order|card|kennzeichen|version|n[ro]\.)\W{0,3}$", re.I)
_HOUSE = r"\d{1,5}[a-z]?(?:\s?[-–]\s?\d{1,5}[a-z]?)?"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Floor|Room) ?\d{1,4}[A-Z]?"
_ADDRESS = re.compile(
    rf"(?:{_FLAT}, )?(?<![\w.,-]){_HOUSE} (?:[NSEW]\. )?(?:[A-ZÀ-Ž][\w’'-]+ ){{1,3}}"
    rf"(?:Street|Road|Lane|Drive|Close|Avenue|Terrace|Court|Crescent|Square|Gardens|Grove|Walk|Way|St|Rd|Ave|Ln|Dr)\b\.?(?:, {_FLAT})?"
    r"|(?:\b(?:Am|An der|Auf der|Im|In der|Zum|Zur) )?\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|hof|gasse|platz|allee|ring|damm|ufer) \d{1,4}[a-z]?\b"
    r"|(?<![\w.,-])\d{1,4}(?: ?(?:bis|ter|quater)\b)?,? (?:rue|boulevard|avenue|place|allée|chemin|quai|impasse|cours|bd|av\.) (?:de la |de l’|de l'|des |du |de |d’|d'|la |le )?[A-ZÀ-Ž][\w’-]+(?: [A-ZÀ-Ž][\w’-]+)*"
    r"|\b(?:Calle|C/|Plaza|Pza\.|Av\.|Avda\.|Avenida|Paseo|Camino|Ronda|Travesía)(?: (?:de la|de los|de las|del|de))? ?[A-ZÀ-Ž][\w-]+(?: [A-ZÀ-Ž][\w-]+)*,? (?:n\.º ?)?\d{1,4}[a-z]?\b(?:, \d{1,2}\.?[ºª](?: ?[A-Z]\b)?)?"
)
_TOKEN = re.compile(r"\s?((?:[^\W\d_]\.[-‐]?)+|[^\W\d_](?:[\w’'­​‐-]*[\w­])?)(\.?)")
_CJK = re.compile("[⺀-鿿가-힯]")


# ---- Checksums ---------------------------------------------------------------------------------------------


def orcid_valid(digits: str) -> bool:
    """ISO 7064 mod 11-2."""
    total = 0
    for c in digits[:-1]:
        total = (total + int(c)) * 2
    return len(digits) == 16 and digits[-1] == "0123456789X"[(12 - total % 11) % 11]


def mod97_valid(digits: str) -> bool:
    """Key of the French number: what is missing to a multiple of 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def luhn_valid(digits: str) -> bool:
    """Check digit of the Canadian number and of many others."""
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def chinese_valid(text: str) -> bool:
    """ISO 7064 mod 11-2 over 17 digits."""
    total = 0
    for c in text[:-1]:
        total = (total + int(c)) * 2
    return len(text) == 18 and text[-1] == "0123456789X"[(12 - total % 11) % 11]


def tax_valid(digits: str) -> bool:
    """Check digit of the German number, ISO 7064 mod 11, 10."""
    product = 10
    for c in digits[:10]:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return len(digits) == 11 and (11 - product) % 10 == int(digits[10])


def dni_valid(text: str) -> bool:
    """Check letter of the Spanish numbers, those of foreigners with X, Y or Z in front among them."""
    digits = str("XYZ".find(text[0])) + text[1:] if text[0] in "XYZ" else text
    return len(digits) == 9 and digits[:8].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits[:8]) % 23] == digits[8]


def checksum(value: str) -> bool | None:
    """Whether the check digits of a number are right; None if numbers of its shape have none."""
    v = re.sub(r"[\s-]", "", value).upper()
    if re.fullmatch(r"[XYZ]\d{7}[A-Z]|\d{8}[A-Z]", v):
        return dni_valid(v)
    if re.fullmatch(r"\d{3}[- ]\d{3}[- ]\d{3}", value):
        return luhn_valid(v)
    if not re.fullmatch(r"\d+[\dX]", v):
        return None
    check = {18: chinese_valid, 16: orcid_valid}.get(len(v)) or (v.isdigit() and {15: mod97_valid, 11: tax_valid}.get(len(v)))
    return check(v) if check else None


def shape_score(value: str) -> float:
    """How much the shape alone speaks for an identity number."""
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]", value):
        return 1.0
    if re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]|\d{17}[\dX]|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}", value):
        return 0.5
    return -0.5 if value.isdigit() else 0.0


def id_score(value: str, before: str, labelled: bool) -> float:
    """Score of a proposed identity number: a label, the shape, right or wrong check digits, and the words before."""
    valid = checksum(value)
    score = (2.0 + max(0.0, shape_score(value)) if labelled else shape_score(value)) + (0.0 if valid is None else 1.0 if valid else -1.0)
    return score + 0.5 * bool(_ID_NEAR.search(before)) - 2.0 * (not labelled and bool(_ID_NOT.search(before)))


# ---- Proposals ---------------------------------------------------------------------------------------------


def _fold(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@cache
def _cues() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue, weight in NAME_CUES.items():
        a.add_word(cue, ("name", len(cue), weight))
    for cue, weight in NAME_AFTER.items():
        a.add_word(cue, ("after", len(cue), weight))
    for cue in ID_CUES:
        a.add_word(cue, ("id", len(cue), 2))
    for cue in STREET_WORDS:
        a.add_word(cue, ("street", len(cue), 0))
    for what, cues in (("apart", APART_WORDS), ("title", TITLE_WORDS)):
        for cue in cues:
            a.add_word(cue, (what, len(cue), 0))
    a.make_automaton()
    return a


def emails(t: str) -> list[Span]:
    found = []
    for m in _AT.finditer(t):
        i = m.start()
        gap = t[i - 1 : i] == " "
        at = end = i - gap
        while at and (t[at - 1].isalnum() or t[at - 1] in "_.+-"):
            at -= 1
        left = _LOCAL.search(t, at, end)
        right = _HOST.match(t, m.end())
        if not left or not right:
            continue
        # A blank around a plain sign belongs to a disguise only if it is on both sides.
        if m.group() == "@" and gap != (t[m.end() : m.end() + 1] == " "):
            continue
        host = right.group()
        last = re.split(r"[.\s\])]", host)[-1]
        while not (last.isalpha() and len(last) > 1):
            cut = max(host.rfind("."), host.rfind(" "))
            if cut < 0:
                break
            host = host[:cut].rstrip(" .")
            last = re.split(r"[.\s\])]", host)[-1]
            if not re.search(r"\.|dot|DOT", host):
                host = ""
                break
        if host and any(c.isalpha() for c in left.group()) and re.search(r"\.|\[dot\]|\(dot\)|\sDOT\s", host):
            found.append(Span(i - gap - len(left.group()), m.end() + len(host), "email"))
    return found


def phones(t: str) -> list[Span]:
    found = []
    for run in _PHONE_RUN.finditer(t):
        m = _PHONE.match(t, run.start())
        if not m:
            continue
        value = m.group()
        digits = sum(c.isdigit() for c in value)
        after = t[m.end() : m.end() + 1]
        if not 9 <= digits <= 15 or after.isalnum() or (after and after in "-/" and t[m.end() + 1 : m.end() + 2].isdigit()):
            continue
        before = t[max(0, m.start() - 40) : m.start()]
        score = 2.0 if value[0] in "+(" else 1.0 if re.search(r"[ ./-]", value) else 0.5
        score += 1.5 * bool(PHONE_CUES.search(before)) - 3 * bool(PHONE_NOT.search(before))
        if score >= 1:
            found.append(Span(m.start(), m.end(), "phone"))
    return found


def numbers(t: str, cues: list[int]) -> list[Span]:
    """Identity numbers: those behind a label and those of a telling shape, by score."""
    found, seen = [], set()
    for at in cues:
        gap = _ID_GAP.match(t, at)
        m = _ID_VALUE.match(t, gap.end())
        if m and (gap.end() > at or t[at - 1] in "=:"):
            seen.add(m.start())
            if id_score(m.group(), t[max(0, at - 40) : at], True) >= 1:
                found.append(Span(m.start(), m.end(), "id_number"))
    for start in _ID_START.finditer(t):
        m = _ID_FREE.match(t, start.start())
        if m and m.start() not in seen:
            after = bool(re.match(r"\s?(?:for |\()", t[m.end() : m.end() + 6]))
            if id_score(m.group(), t[max(0, m.start() - 40) : m.start()], False) + 0.5 * after >= 1:
                found.append(Span(m.start(), m.end(), "id_number"))
    return found


def addresses(t: str, streets: list[int]) -> list[Span]:
    """Looks around the places of street words only."""
    found = []
    windows: list[list[int]] = []
    for at in streets:
        a, b = max(0, at - 120), at + 120
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    # Found near the word, then read to its own end, wherever that is.
    near = (m.start() for a, b in windows for m in _ADDRESS.finditer(t, a, min(len(t), b)))
    for m in filter(None, (_ADDRESS.match(t, start) for start in near)):
        end = m.end()
        if m.group().endswith("St.") and not re.match(r"\s?(?:,|[a-z])", t[end:]):
            end -= 1  # the end of a sentence
        elif m.group().endswith(".") and not re.search(r"(?:Rd|Ave|Ln|Dr|St)\.$", m.group()):
            end -= 1
        found.append(Span(m.start(), end, "address"))
    return found


_AL = re.compile(r"^al-(?=.)")


def _second_particle(tokens: list[str], word: str) -> bool:
    """Whether a word such as "der" goes on from a particle, as in "van der"."""
    return bool(tokens) and tokens[-1].lower() in ("van", "von", "de") and word.lower() in PARTICLES


def name_at(t: str, at: int, weight: int) -> Span | None:
    """A person's name that begins at `at`, after any titles."""
    while t[at : at + 1] == " ":
        at += 1
    m = TITLE.match(t, at)
    score = weight + bool(m)
    at = start = m.end() if m else at
    end, tokens, comma = at, [], 0
    while len(tokens) < 7:
        m = _TOKEN.match(t, end)
        if not m:
            break
        w, dot = m.group(1), m.group(2)
        if (w.lower() in STOP and not _second_particle(tokens, w)) or w == "will" or _CJK.search(w) or (tokens and m.start(1) == end and not tokens[-1].endswith(("-", "."))):
            break
        short = len(w) == 1 or w.endswith(".")
        # A name in capitals doesn't go on into other words in small letters.
        if w[0].islower() and w.lower() not in PARTICLES and not _AL.match(w) and sum(x[0].isupper() for x in tokens) >= 2:
            break
        possessive = w.endswith(("'s", "’s"))
        tokens.append(w[:-2] if possessive else w)
        end = m.end() if short else m.end(1) - 2 * possessive
        if (dot and not short) or possessive:
            break
        if t[end : end + 2] == ", " and not comma:
            full = [x for x in tokens if x.lower() not in PARTICLES]
            if len(full) == 1 and len(full[0]) > 2 and not full[0].endswith("."):
                comma, end = len(tokens), end + 1
            else:
                break
    while tokens and tokens[-1].lower() in PARTICLES and (not comma or len(tokens) > comma):
        end = t.rindex(tokens.pop(), start, end)
        end = len(t[:end].rstrip())
    if comma and (len(tokens) == comma or len([x for x in tokens[comma:] if len(x) > 1 and not x.endswith(".")]) > 2):
        return None
    own = [x for x in tokens if x.lower() not in PARTICLES]
    long = [x for x in own if len(x.strip(".")) > 2]
    if len(own) < 2 or not long or len(long) > 4:
        return None
    if t[end : end + 1] == "-" or re.match(r"\s(?:et al|Institut|criterion|index)", t[end:]):
        return None
    capital = sum(_AL.sub("", x)[0].isupper() for x in own)
    score += 1 if capital == len(own) else -0.5 if capital else 0
    # In small letters anything might follow a cue; then only the shape of a full name will do.
    if capital == 0 and (max(map(len, own)) < 7 or len(long) not in (1, 2, 3) or len(own) > 3):
        return None
    return Span(start, end, "name") if score >= 2 else None


def name_before(t: str, end: int) -> Span | None:
    """A person's name that ends at `end`."""
    window = t[max(0, end - 200) : end]
    base = end - len(window)
    words = [(m.start(), m.group()) for m in re.finditer(r"\S+", window)]
    taken: list[tuple[int, str]] = []
    comma = False
    for pos, w in reversed(words):
        core = w.strip("“”\"'(<[")
        if core != w and w[0] in "“\"'(<[" and taken:
            core_only = True
        else:
            core_only = False
        initial = re.fullmatch(r"(?:[^\W\d_]\.[-‐]?)+|[^\W\d_]", core)
        if core.endswith(",") and taken and not comma:
            own = [x for _, x in taken if x.lower() not in PARTICLES]
            if len([x for x in own if len(x) > 2]) <= 1 and re.fullmatch(r"[^\W\d_][\w’'­‐-]+", core[:-1]) and core[:-1].lower() not in STOP:
                comma = True
                taken.append((pos, core))
                continue
            break
        if not (initial or re.fullmatch(r"[^\W\d_][\w’'­​‐-]*", core)) or (core.lower() in STOP and core.lower() not in PARTICLES) or _CJK.search(core) or re.fullmatch(TITLE.pattern.rstrip("+"), core + " ", re.I):
            break
        if comma and core.lower() not in PARTICLES:
            break
        taken.append((pos + (len(w) - len(w.lstrip("“\"'(<["))), core))
        if core_only or len(taken) > 6:
            break
    # A capitalised name doesn't go on into words in small letters before it.
    if taken and taken[0][1][0].isupper():
        while taken and _AL.sub("", taken[-1][1])[0].islower() and not (taken[-1][1].lower() in PARTICLES and comma):
            taken.pop()
    else:
        while len(taken) > 4:
            taken.pop()
    own = [x for _, x in taken if x.lower().strip(",") not in PARTICLES]
    if len(own) < 2 or not any(len(x.strip(".,")) > 2 for x in own):
        return None
    return Span(base + taken[-1][0], end, "name")


def _capital(name: str) -> bool:
    words = [w for w in name.replace(",", " ").split() if w.lower() not in PARTICLES]
    return all(_AL.sub("", w)[0].isupper() for w in words) and words[0].lower() not in STOP


_NEXT_NAME = re.compile(r"(?:,? (?:and|und|et|y|&) |, )")
_MAIL_BEFORE = re.compile(r"\s?[<(]$")


def mentions(t: str) -> list[Span]:
    """All mentions of a text whose white space is collapsed, in order, without overlaps."""
    if not t:
        return []
    low = _fold(t)
    names: list[tuple[int, int]] = []
    ids: list[int] = []
    after: list[tuple[int, int]] = []
    streets: list[int] = []
    titles: list[int] = []
    for last, (what, n, weight) in _cues().iter(low):
        start, end = last + 1 - n, last + 1
        if what == "street":
            if not low[end : end + 1].isalpha() and (" " in low[end : end + 2] or not low[end : end + 1].isalnum()):
                streets.append(start)
        elif what == "after":
            after.append((start, weight))
        elif what == "apart":
            if (not start or not low[start - 1].isalnum()) and (m := NAME_CUES_APART.match(t, start)):
                names.append((m.end(), 2))
        elif what == "title":
            if t[start].isupper() and (not start or not t[start - 1].isalnum()) and TITLE.match(t, start):
                titles.append(start)
        elif start and low[start - 1].isalnum() and low[start].isalpha() and not _CJK.match(low[start]):
            continue
        elif what == "id":
            ids.append(end)
        elif not (low[end : end + 1].isalpha() and not _CJK.match(low[last]) and low[last] not in "=:,"):
            names.append((end, weight))
    found = emails(t)
    mail = list(found)
    id_spans = numbers(t, ids)
    found += id_spans + addresses(t, streets) + phones(t)
    people: list[Span] = []
    for at, weight in names:
        span = name_at(t, at, weight)
        while span:
            people.append(span)
            more = _NEXT_NAME.match(t, span.end)
            span = name_at(t, more.end(), 1) if more else None
    for at in titles:
        if span := name_at(t, at, 1):
            people.append(span)
    for s in id_spans:
        m = re.compile(r"\s?(?:for |\()").match(t, s.end)
        if m and (span := name_at(t, m.end(), 2)):
            people.append(span)
    for at, weight in after:
        # A word such as "wrote" stands behind all kinds of subjects; only names are in capitals.
        if (span := name_before(t, at - (t[at - 1 : at] == " "))) and (weight == 2 or _capital(t[span.start : span.end])):
            people.append(span)
    for s in mail:
        m = _MAIL_BEFORE.search(t, max(0, s.start - 2), s.start)
        if m and t[m.end() - 1] == "<" and (span := name_before(t, m.start())):
            people.append(span)
    # Sure shapes come first; a name or phone inside of another mention isn't one.
    order = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}
    kept: list[Span] = []
    for s in sorted(set(found + people), key=lambda s: (order[s.kind], s.start, -s.end)):
        at = bisect_left(kept, s)  # spans kept so far don't overlap, so only the neighbours can
        if (at == 0 or kept[at - 1].end <= s.start) and (at == len(kept) or s.end <= kept[at].start):
            kept.insert(at, s)
    return kept


#: White space that isn't a single blank.
_SPACE = re.compile(r"\s{2,}|[^\S ]")


def collapse_space(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with each run of white space as one blank, and (place, shift) where the two begin to differ more."""
    shifts, gone, out, last = [], 0, [], 0
    for m in _SPACE.finditer(text):
        out.append(text[last : m.start()])
        out.append(" ")
        last = m.end()
        if m.end() - m.start() > 1:
            gone += m.end() - m.start() - 1
            shifts.append((m.end() - gone, gone))
    out.append(text[last:])
    return "".join(out), shifts


def redact(text: str, spans: list[Span], shifts: list[tuple[int, int]]) -> str:
    """The text as it was with each mention replaced by its kind in brackets."""
    keys = [k for k, _ in shifts]

    def place(i: int) -> int:
        j = bisect_right(keys, i)
        return i + (shifts[j - 1][1] if j else 0)

    out, last = [], 0
    for s in spans:
        a, b = place(s.start), place(s.end - 1) + 1
        out += [text[last:a], f"[{s.kind.upper()}]"]
        last = b
    out.append(text[last:])
    return "".join(out)


_MENTION = pa.struct([("kind", pa.string()), ("value", pa.string())])


def _scan(keep_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found, texts = [], []
            for text in batch.column(1).to_pylist():
                if not text:
                    found.append([])
                    texts.append(text)
                    continue
                flat, shifts = collapse_space(text)
                spans = mentions(flat)
                found.append(sorted({(s.kind, flat[s.start : s.end]) for s in spans}))
                if keep_text:
                    texts.append(redact(text, spans, shifts) if spans else text)
            columns = [batch.column(0), pa.array([[{"kind": k, "value": v} for k, v in f] for f in found], pa.list_(_MENTION))]
            names = ["doc_id", "mentions"]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def personal_mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, value): the distinct mentions per document; runs of white space in a value are one blank.
    Null and empty texts have none; texts of any length are read whole."""
    return (
        _documents(docs, key, text)
        .mapInArrow(_scan(False), "doc_id long, mentions array<struct<kind:string,value:string>>")
        .select("doc_id", F.explode("mentions").alias("m"))
        .select("doc_id", "m.kind", "m.value")
        .distinct()
    )


def redacted_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, redacted): each text with typed placeholders; null stays null and empty stays empty."""
    return _documents(docs, key, text).mapInArrow(_scan(True), "doc_id long, mentions array<struct<kind:string,value:string>>, redacted string").drop("mentions")
