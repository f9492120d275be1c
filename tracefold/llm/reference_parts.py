"""Splits a printed reference into its labelled parts, whatever their order, letter case and punctuation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import ahocorasick

#: Parts of a reference that have a label or shape, in the order of `parts_of`.
LABELLED = ("year", "venue", "volume", "pages", "identifier", "accessed")

_SUFFIX = r"10\W?\d{4,5}\W?(?:[a-z]{2,12}\W?(?:1[89]|20)\d\d\W?\d{1,7}|\S*?(?=[\s,;|\"”»“]|$))"
_IDENTIFIER = re.compile(
    r"https?\W{0,6}(?:[a-z]+[\W_]){0,3}?[a-z]+\W{0,2}" + _SUFFIX + r"|https?://\S*?(?=[\s,;|\"”»“]|$)"
    r"|doi\W{0,4}" + _SUFFIX + r"|arxiv\W{0,4}(?:\d{4}\W?\d{4,5}|[a-z-]+\W\d{7})(?:v\d+)?"
)
_ACCESSED = re.compile(r"accessed\W*\d{1,2}\W*[a-z]+\W*\d{4}(?!\d)")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐‑]\s+(?=[^\W\d_])")
_LABEL = r"(?<![^\W\d_])(?:vol|no|pp)"
_NUMERIC_START = re.compile(r"(?:[\W_]|\d|" + _LABEL + r"(?=[.\s]*\d))*(?<!\d)(?=[^\W\d_]|$)|(?:[\W_]|\d)*$")
_NUMERIC_END = re.compile(r"(?<![^\W_])(?:" + _LABEL + r"[.\s]*\d+|\d+)(?:[\W_]*" + _LABEL + r"[.\s]*\d+|[\W_]+\d+)*[\W_]*$")
_VOLUME = re.compile(r"(?<![a-z])vol\W*\d+(?:\W*no\W*\d+)?|(?<!\d)\d{1,3}\W?\(\d{1,3}\)?|(?<!\d)\d{1,3}\(?\d{1,2}\)")
_PAGES = re.compile(r"(?<![a-z])pp[.\s]*\d+(?:\W\d+)?|(?<!\d)\d{1,5}[-‐‑‒–—−]\d{1,5}(?!\d)")
_SPAN = re.compile(r"(\d+)[-‐‑‒–—−](\d+)")
_YEAR = re.compile(r"\(\W?\d{4}\W{0,2}\)|\([“\"]?(?:1[89]|20)\d\d(?!\d)|(?<!\d)(?:1[89]|20)\d\d[”\"]?\)|(?<!\d)(?:1[89]|20)\d\d(?=\d{1,3}\()")
_BARE_YEAR = re.compile(r"(?<![\d–-])(?:1[89]|20)\d\d(?![\d(]|[-‐‑‒–—−]\d)")
_NUMBER = re.compile(r"\d+(?:\W{1,2}\d+)*")


def letters(text: str | None) -> str:
    """Letters and digits only, caseless and composed."""
    if not text:
        return ""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFC", text).casefold()))


class VenueFinder:
    """Finds the longest known venue name or abbreviation in a text of letters and digits. Names of few letters, such as
    "Cell", count only as whole words."""

    SHORT = 6

    def __init__(self, names: list[str]):
        self.found = ahocorasick.Automaton()
        for n in {letters(x) for x in names}:
            if n:
                self.found.add_word(n, len(n))
        self.empty = len(self.found) == 0
        if not self.empty:
            self.found.make_automaton()

    def find(self, text: str, whole: Callable[[int, int], bool], start: int = 0, end: int | None = None) -> tuple[int, int] | None:
        """The name's span between start and end; `whole` tells whether a span begins and ends at word ends."""
        if self.empty:
            return None
        best = None
        for last, n in self.found.iter(text, start, len(text) if end is None else end):
            if (best is None or n > best[1] - best[0]) and (n >= self.SHORT or whole(last + 1 - n, last + 1)):
                best = (last + 1 - n, last + 1)
        return best


def _unglue(m: re.Match) -> str:
    """Pages printed without a gap to their neighbours: the ends of a span are of like length and size."""
    a, b = m.groups()
    if len(a) in (len(b), len(b) - 1) and len(a) < 5 and int(b) - int(a) < 1000:
        return m.group()
    for k in (4, 3, 2, 1):
        for n in (k, k + 1):
            x, y = a[-k:], b[:n]
            if len(x) == k and len(y) == n and 0 <= int(y) - int(x) < 100:
                return f"{a[:-k]} \0 {x}-{y} \0 {b[n:]}" if a[:-k] else f"{x}-{y} \0 {b[n:]}"
    return m.group()


def _numbers(zones: list[str]) -> tuple[str, str, str]:
    """(year, volume, pages) of the numeric zones. Clear marks decide first; what is left fills the gaps."""
    year = volume = pages = ""
    rest = " \0 ".join(zones)

    def take(pattern: re.Pattern) -> str:
        nonlocal rest
        m = pattern.search(rest)
        if not m:
            return ""
        rest = rest[: m.start()] + " \0 " + rest[m.end() :]
        return letters(m.group())

    rest = _SPAN.sub(_unglue, rest)
    year = take(_YEAR) or take(_BARE_YEAR)
    volume = take(_VOLUME)
    pages = take(_PAGES)
    left = [letters(m.group()) for m in _NUMBER.finditer(rest)]
    if not year and (four := next((x for x in left if len(x) == 4), "")):
        left.remove(four)  # a mistyped year
        year = four
    if left and not pages and (volume or len(left[-1]) > 3):
        pages = left.pop()
    if left and not volume:
        volume = left.pop(0)
    return year, volume, pages + "".join(left)


def parts_of(raw: str | None, title: str | None, authors: list[str | None] | None, venues: VenueFinder):
    """(runs, year, venue, volume, pages, identifier, accessed): runs are the texts left for authors and title,
    each of letters and digits only. A part that isn't there is empty."""
    s = unicodedata.normalize("NFC", raw or "").casefold().replace("­", "").replace("​", "")
    s = _BREAK.sub("", s)
    identifier = accessed = ""
    m = _ACCESSED.search(s)
    if m:
        accessed, s = letters(m.group()), s[: m.start()] + " \0 " + s[m.end() :]
    m = _IDENTIFIER.search(s)
    if m:
        identifier, s = letters(m.group()), s[: m.start()] + " \0 " + s[m.end() :]

    at = [i for i, c in enumerate(s) if c.isalnum() or c == "\0"]
    stream = "".join([s[i] for i in at])
    cuts: list[tuple[int, int]] = []

    def cut(span: tuple[int, int] | None) -> str:
        if not span:
            return ""
        cuts.append((at[span[0]], at[span[1] - 1] + 1))
        return stream[span[0] : span[1]]

    def free(a: int, b: int) -> bool:
        return all(at[b - 1] < x or at[a] >= y for x, y in cuts)

    found: list[str] = []
    name = letters(title)
    whole = lambda x, y: _edges(s, at, x, y)
    span = venues.find(stream, whole)
    a = stream.find(name) if name else -1
    # A title may hold a venue's words; then the venue is looked for outside of it.
    if a >= 0 and span and a <= span[0] and span[1] <= a + len(name):
        span = venues.find(stream, whole, a + len(name)) or venues.find(stream, whole, 0, a)
    venue = cut(span)
    if name:
        while a >= 0 and not (free(a, a + len(name)) and _edges(s, at, a, a + len(name))):
            a = stream.find(name, a + 1)
        if a < 0 and (b := stream.find(name)) >= 0 and free(b, b + len(name)):
            a = b
        if a >= 0:
            found.append(cut((a, a + len(name))))
    known = [letters(x) for x in authors or []]
    full = "".join(known)
    if full and (b := stream.find(full)) >= 0 and free(b, b + len(full)):
        end = b + len(full) + 4 * (stream[b + len(full) : b + len(full) + 4] == "etal")
        found.append(cut((b, end if free(b, end) else b + len(full))))
    elif full:
        for k in range(len(known) - 1, 0, -1):
            some = "".join(known[:k]) + "etal"
            if (b := stream.find(some)) >= 0 and free(b, b + len(some)):
                found.append(cut((b, b + len(some))))
                break

    pieces, last = [], 0
    for x, y in sorted(cuts):
        pieces += s[last:x].split("\0")
        last = y
    pieces += s[last:].split("\0")
    zones: list[str] = []
    for p in pieces:
        m = _NUMERIC_START.match(p)
        if m and m.end():
            zones.append(m.group())
            p = p[m.end() :]
        m = _NUMERIC_END.search(p)
        if m and m.group():
            zones.append(m.group())
            p = p[: m.start()]
        # A year between two runs parts them.
        inner = re.split(r"\W\([“\"]?((?:1[89]|20)\d\d)[”\".]{0,2}\)\W|[|;/—]\s*((?:1[89]|20)\d\d)\s*[|;/—]|[.,]\s+((?:1[89]|20)\d\d)[.,]\s", p)
        for i, x in enumerate(inner):
            if x and i % 4:
                zones.append(f"({x})")
            elif x and (t := letters(x)):
                found.append(t)
    year, volume, pages = _numbers(zones)
    return found, year, venue, volume, pages, identifier, accessed


def _edges(s: str, at: list[int], a: int, b: int) -> bool:
    """Whether the span begins and ends at word ends of the printed text."""
    before, after = at[a] - 1, at[b - 1] + 1
    return (before < 0 or not s[before].isalnum()) and (after >= len(s) or not s[after].isalnum())
