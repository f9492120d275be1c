"""No text makes a per-row helper fail, and what must hold for every text does."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import entities, names, pii
from tracefold.llm.reference_parts import LABELLED, VenueFinder, parts_of

PIECES = st.sampled_from(
    ["Ann", " ", ",", ".", "de", "al-", "von", "AB", "É", "ß", "İ", "­", " ", "\n", "(", ")", "12", "1999", "pp.", "vol.", "no", "doi:10.1234/ab.1999.1", "arXiv:1234.56789",
     "@", "x@y.example", "(at)", "+1 212 555 0144", "ORCID ", "0000-0002-1825-0097", "thank ", "Correspondence: ", " died in the ", "Street", "Am ", "hof 3", "中文", "感谢", "Institute", "accessed 1 May 2020", "“", "-", "\0"]
)
TEXTS = st.one_of(st.text(max_size=80), st.lists(PIECES, max_size=25).map("".join))
FINDER = VenueFinder(["Annals of Open Studies", ""])


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.one_of(st.none(), TEXTS), st.one_of(st.none(), st.lists(st.one_of(st.none(), TEXTS), max_size=3)))
def test_reference_parts(raw, title, authors):
    got = parts_of(raw, title, authors, FINDER)
    assert len(got) == len(LABELLED) + 1 and all(isinstance(x, str) for x in got[1:])


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_names(text):
    kind, *rest = names.parse_name(text, frozenset({"ann"}))
    assert kind in "poa" and all(isinstance(x, str) for x in rest)
    names.roles(text)
    assert entities.plain(text) == entities.plain(entities.plain(text))
    entities.author_key(text), entities.doi_key(text)


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_mentions_and_redaction(text):
    flat, shifts = pii.collapse_space(text)
    assert flat == __import__("re").sub(r"\s+", " ", text)
    spans = pii.mentions(flat)
    assert all(0 <= s.start < s.end <= len(flat) for s in spans)
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))
    out = pii.redact(text, spans, shifts)
    assert sum(out.count(f"[{k.upper()}]") for k in pii.KINDS) >= len(spans)
    if not spans:
        assert out == text
