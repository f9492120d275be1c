import pytest
from pyspark.sql import functions as F

from tracefold.operators import segment


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize("text,expected", [("a\nb\r\nc\n", ["a", "b", "c"]), ("", []), (None, []), ("\n\n", ["", ""]), ("a\x0bb c", ["a", "b", "c"])])
def test_lines(spark, text, expected):
    assert one(spark, segment.lines(F.col("t")), text) == expected


def test_last_heading_wins_and_is_in_neither_part(spark):
    docs = spark.createDataFrame([(1, "intro\nReferences\nmore\n7. REFERENCES \n[1] a"), (2, "none"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in segment.split_bibliography(docs).collect()}
    assert (rows[1].heading_line, rows[1].body_text, rows[1].references_text) == (4, "intro\nReferences\nmore", "[1] a")
    assert (rows[2].heading_line, rows[2].body_text, rows[2].references_text) == (None, "none", None)
    assert rows[3].body_text == ""


@pytest.mark.parametrize("pages,start", [(40, 35), (1, 1), (7, 7), (0, None), (None, None)])
def test_fallback_pages(spark, pages, start):
    df = spark.createDataFrame([(pages,)], "n int").select(segment.fallback_start(F.col("n"), 0.15).alias("x"))
    assert df.collect()[0].x == start


def test_page_furniture(spark):
    long = "Journal of Long Running Heads, page "
    text = "\n".join([f"{long}{i}\nbody {i}\n{i}\n" for i in range(3)])
    n = segment.numbered_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    kept = [r.line for r in segment.without_furniture(n).orderBy("line_no").collect()]
    assert kept == ["body 0", "", "", "body 1", "", "", "body 2", ""] or sorted(x for x in kept if x) == ["body 0", "body 1", "body 2"]


def test_entries():
    style, found = segment.split_entries("[1] First entry about\nsome-\nthing.\n[7] not next\n[2] Second 10-\n12 and on.\n\nshort\n")
    assert style == "bracketed"
    assert found == ["[1] First entry about something. [7] not next", "[2] Second 10-12 and on."]
    assert segment.split_entries("1. a b\n2) c d\n3. e f")[0] == "numbered"
    assert segment.split_entries("one\ntwo\n\nthree") == ("blank-line", ["one two", "three"])
    assert segment.split_entries(None) == ("blank-line", [])
    tail = "[1] one entry of a decent length here\n[2] two entries of a decent length here\nx\ny\nz"
    assert segment.split_entries(tail)[1][1] == "[2] two entries of a decent length here"


def test_entry_ids(spark):
    text = "\n".join(f"[{i}] entry number {i}" for i in range(1, 121))
    docs = spark.createDataFrame([(1, text, 5), (2, "[1] a b\n[2] c d", 5), (3, None, 5)], "doc_id long, references_text string, position int")
    rows = segment.entries(docs).collect()
    ids = {(r.doc_id, r.position): r.ref_id for r in rows}
    assert ids[1, 1] == "R001" and ids[1, 120] == "R120" and ids[2, 2] == "R02" and len(rows) == 122


@pytest.mark.parametrize(
    "text,numbers",
    [("x [1] y [2, 3] z [1-3]", [1, 2, 3]), ("[4–6; 9]", [4, 5, 6, 9]), ("[Fig. 1]", []), ("[9-2] [0-3] [1-200]", []), (None, None), ("[3, 3]", [3]), ("[12345678901]", []), ("[1 2]", []), ("[1000-1050]", []), ("[1 - 3]", [1, 2, 3]), ("[3, 1 , 2]", [3, 1, 2])],
)
def test_markers(spark, text, numbers):
    assert one(spark, segment.marker_numbers(F.col("t")), text) == numbers


def test_sentences(spark):
    assert one(spark, segment.sentences(F.col("t")), "One is.  Two\nis! (Three) 4.5 no. lower Yes?") == ["One is.", "Two is!", "(Three) 4.5 no. lower Yes?"]
    assert one(spark, segment.sentences(F.col("t")), None) == []


def test_claims_ignore_numbers_without_reference(spark):
    docs = spark.createDataFrame([(1, 5, "body", "We say so [1, 9]. Nothing here. Again [2]."), (2, None, "body", "No ledger [1].")], "doc_id long, ledger_id long, section string, body_text string")
    refs = spark.createDataFrame([(5, "R01"), (5, "R2"), (6, "R9")], "ledger_id long, ref_id string")
    got = sorted(tuple(r) for r in segment.claims(docs, refs).collect())
    assert got == [(1, 1, 1, "R01"), (1, 3, 2, "R2")]


def test_brackets_are_renumbered(spark):
    new = segment.remapped_markers(F.col("t"), lambda n: F.when(n != 9, n * 2))
    assert one(spark, new, "a [1, 3-4] b [9] c [Fig. 1] d [2;2]") == "a [2, 6, 8] b  c [Fig. 1] d [4]"
    assert one(spark, new, "none") == "none" and one(spark, new, None) is None


def test_contiguous_numbers(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 4), (2, 2), (3, None), (4, 1)], "k long, n int")
    assert {(r.k, r.entries, r.contiguous) for r in segment.contiguous_prefix(df, "k", "n").collect()} == {(1, 3, 2), (2, 1, 0), (4, 1, 1)}


def test_running_heads(spark):
    n = spark.createDataFrame([(1, 1, "A Fine Title"), (1, 2, "12 A FINE TITLE 13"), (1, 3, "body of a fine title"), (1, 4, "7"), (2, 1, "A fine title")], "doc_id long, line_no int, line string")
    titles = spark.createDataFrame([(1, "A fine title")], "doc_id long, title string")
    assert {(r.doc_id, r.line_no) for r in segment.without_running_heads(n, titles).collect()} == {(1, 3), (2, 1)}


def test_repairs(spark):
    from tracefold.functions import repair

    assert one(spark, repair.dehyphenate(F.col("t")), "exam-\nple amplitude- and fluctuation-based rule- based 10-\n12 Re-\nad") == "example amplitude- and fluctuation-based rule- based 10-\n12 Read"
    assert one(spark, repair.repair_doi(F.col("t")), "DOI:  10.3390/ e10030261, 10.1021/acs.chemrev. 9b00829. 10.1234/ab. 9 x") == "doi:10.3390/e10030261, 10.1021/acs.chemrev.9b00829. 10.1234/ab. 9 x"
    assert one(spark, repair.compose_accents(F.col("t")), "cafe\u0301 S\u00b4mieja C\u02c7ech") == "caf\u00e9 \u015amieja \u010cech"


@pytest.mark.parametrize(
    "text,tidy",
    [
        ("An algorithm proposed in @. It", "An algorithm. It"), ("as used in @, and", "as used, and"), ("found in @ and the references therein", "found in the references therein"),
        ("See, e.g., @ for references on", "See, e.g., references on"), ("so (see @) it", "so it"), ("words @ and @.", "words and."), ("no ( ) bracket , here .", "no ( ) bracket , here ."),
    ],
)
def test_tidy(spark, text, tidy):
    from tracefold.functions import repair

    assert one(spark, repair.tidy_punctuation(F.col("t")), text.replace("@", repair.DELETED)) == tidy


@pytest.mark.parametrize("line", ["References.", "7.References", "VI Bibliography", "  12. works cited ", "IV.LITERATURE CITED."])
def test_headings(spark, line):
    assert one(spark, F.col("t").rlike(segment.HEADING), line) and not one(spark, F.col("t").rlike(segment.HEADING), line + " at the end")


def test_reflow(spark):
    assert one(spark, segment.reflow(F.col("t")), "We saw 12 Cases here. 2.1 Methods were\n• one • two 3.2.1 End") == ["We saw 12 Cases here.", "2.1 Methods were", "• one", "• two", "3.2.1 End"]


def test_pages(spark):
    pages = [
        ["intro", "References\nmore", "body\n7. REFERENCES \n[1] a", "[2] b"], ["a", "b", "last\ntwo", "", "  "], ["one only"], ["", None], [], None,
        ["text\nReferences", ""], [f"p{i}" for i in range(20)],
    ]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(pages)], "doc_id long, pages array<string>, body_text string")
    rows = {r.doc_id: r for r in segment.split_pages(df.drop("body_text")).withColumn("bib", segment.bibliography_pages(F.col("pages"), F.col("ref_start_page"))).collect()}
    got = {i: (r.ref_start_page, r.body_text, r.references_text) for i, r in rows.items()}
    assert got[0] == (3, "intro\n\nReferences\nmore\n\nbody", "[1] a\n\n[2] b") and rows[0].notes == ["several headings, split at the last"] and len(rows[0].bib) == 2
    assert got[1] == (3, "a\n\nb", "last\ntwo\n\n  ") and "last pages blank, widened" in rows[1].notes
    assert got[2] == (1, "", "one only") and rows[2].notes[-1] == "a single page, all of it taken"
    assert got[3] == got[4] == got[5] == (None, "", "") and rows[3].notes == ["no text on any page"] and rows[3].bib == []
    assert got[6] == (1, "text", "") and rows[6].notes == ["nothing behind the heading"]
    assert got[7][0] == 18 and rows[7].references_text == "p17\n\np18\n\np19"


def test_claim_records(spark):
    docs = spark.createDataFrame([(1, 5, "body", 3, "We say so [2, 9, 1] and [2]. Nothing here. Again [1-2]."), (2, 5, "references", 4, "[1] No claim.")], "doc_id long, ledger_id long, section string, page int, body_text string")
    refs = spark.createDataFrame([(5, "R01"), (5, "R2"), (6, "R9")], "ledger_id long, ref_id string")
    rows = sorted(tuple(r) for r in segment.claim_records(docs, refs).collect())
    assert rows == [(1, 5, "C01", 3, "We say so [2, 9, 1] and [2].", ["R2", "R01"]), (1, 5, "C02", 3, "Again [1-2].", ["R01", "R2"])]
