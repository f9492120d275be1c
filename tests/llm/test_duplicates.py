import random

from pyspark.sql import functions as F

from tracefold.llm import duplicates
from tracefold.llm.reference_parts import VenueFinder, letters, parts_of

VENUES = [("Annals of Open Studies", "Ann. Open Stud."), ("Letters in Rivers", None)]
PARTS = ["Bell, A. B.; Dane, C.", "(2011)", "On river stones: a study of 40 beds", "Annals of Open Studies", "27(11)", "1410-1415", "doi:10.5555/fipo.2011.707"]
SCHEMA = "row_id long, raw_text string, title string, authors array<string>, print_a string"


def found(spark, rows, share=2):
    refs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    venues = spark.createDataFrame(VENUES, "name string, abbreviation string")
    return sorted(tuple(r) for r in duplicates.copies_of(duplicates.printed_fields(refs, venues), share).collect())


def test_typography_and_order_do_not_count(spark):
    title, authors = PARTS[2], ["Bell, A. B.", "Dane, C."]
    forms = [
        ". ".join(PARTS),
        " | ".join([PARTS[6], PARTS[0], "2011", *PARTS[2:6]]).upper(),
        " ".join(p.replace(":", "").replace("-", "") for p in PARTS),
        "; ".join([PARTS[3], PARTS[4], "2011", PARTS[2].replace("stones", "sto-\nnes"), PARTS[0], PARTS[5].replace("-", "–"), PARTS[6]]),
        "“" + " — ".join(PARTS[:3]) + "” — " + " — ".join(PARTS[3:]),
    ]
    rows = [(i, f, t, a) for i, (f, t, a) in enumerate(zip(forms, [title, title.upper(), f"“{title}”", "On  river stones a study of 40\nbeds.", title], [authors, None, authors, [], authors]))]
    assert found(spark, rows) == [(0, i) for i in range(1, 5)]


def test_real_differences_count(spark):
    base = ". ".join(PARTS)
    changed = [
        base.replace("Bell, A. B.; Dane, C.", "Dane, C.; Bell, A. B."), base.replace("1410-1415", "1401-1415"), base.replace("27(11)", "21(17)"),
        base.replace("2011)", "2101)"), base.replace("1410", "pp. 1410"), base.replace("river", "rivre"), base.replace("fipo", "pifo"),
    ]
    rows = [(i, t, None, None) for i, t in enumerate([base, *changed])]
    assert found(spark, rows) == []


def test_titles_and_nulls(spark):
    base = ". ".join(PARTS)
    rows = [(1, base, None, None), (2, base, "", None), (3, base, PARTS[2], None), (4, base, None, None), (5, None, None, None), (6, None, None, []), (7, "", None, None), (8, "x" * 70_000, None, None)]
    assert found(spark, rows) == [(1, 4), (5, 6), (5, 7)]
    assert found(spark, []) == []


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, ". ".join(PARTS) if i % 3 == 0 else f"Row {i}. Text {i}", None, None) for i in range(300)]
    assert found(spark, rows, 8) == found(spark, rows, 1000) == [(0, i) for i in range(3, 300, 3)]


def test_the_sum_of_hashes_ignores_order_and_keeps_values(spark):
    df = spark.createDataFrame([("a", "b", None), ("b", "a", None), ("a", "b", "")], "x string, y string, z string")
    one = duplicates.multiset_hash({"x": F.col("x"), "y": F.col("y"), "z": F.col("z")})
    two = duplicates.multiset_hash({"z": F.col("z"), "y": F.col("y"), "x": F.col("x")})
    rows = df.select(one.alias("a"), two.alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len({r.a for r in rows}) == 3


def test_random_shuffles_agree():
    finder, rng = VenueFinder([x for v in VENUES for x in v if x]), random.Random(1)
    whole = parts_of(". ".join(PARTS), PARTS[2], None, finder)
    for _ in range(50):
        order = PARTS[:]
        rng.shuffle(order)
        got = parts_of(rng.choice([". ", " | ", "; ", " / ", " — "]).join(order), PARTS[2], None, finder)
        assert sorted(got[0]) == sorted(whole[0]) and got[1:] == whole[1:], order
    assert letters("Straße 1-2") == "strasse12"


def test_short_venues_are_words_of_their_own():
    finder = VenueFinder(["Cell", "BMJ"])
    assert parts_of("Bell, A. On cellular maps. Cell. 27(11)", "On cellular maps", None, finder)[2] == "cell"
    assert parts_of("Bell, A. On cellular maps. 27(11)", "On cellular maps", None, finder)[2] == ""


def test_equal_prints_are_no_proof(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "fingerprinted", lambda f: f.withColumns({"print_a": F.lit(1), "print_b": F.lit(1)}))
    rows = [(i, ". ".join(PARTS) if i % 2 else f"Row {i}. Text", None, None) for i in range(1, 8)]
    assert found(spark, rows) == [(1, 3), (1, 5), (1, 7)]


def test_texts_in_any_order_and_from_any_beginning(spark):
    df = spark.createDataFrame([(["ab", "cd", "ab"], ["cd", "ab", "ab"], True), (["ab", "cd", "cd"], ["cd", "ab", "ab"], False), ([], [], True)], "x array<string>, y array<string>, same boolean")
    h = lambda c: duplicates.elements_hash(F.col(c), "t")
    assert all(r.e == r.same and r.h == r.same for r in df.select("same", duplicates._same_texts(F.col("x"), F.col("y")).alias("e"), (h("x") == h("y")).alias("h")).collect())
    rings = spark.createDataFrame([("abcdefghijk", "ghijkabcdef", True), ("abc", "cab", True), ("", "", True), ("abcdefghijk", "bacdefghijk", False), ("abc", "abcabc", False)], "x string, y string, same boolean")
    r = lambda c: duplicates.ring_hash(F.col(c), "t")
    assert all(x.h == x.same for x in rings.select("same", (r("x") == r("y")).alias("h")).collect())


def test_records_with_their_copies(spark):
    refs = spark.createDataFrame([(i, ". ".join(PARTS) if i < 3 else f"Row {i}", None, None, "x") for i in range(5)], SCHEMA)
    venues = spark.createDataFrame(VENUES, "name string, abbreviation string")
    assert sorted(tuple(r) for r in duplicates.reference_records(refs, venues).collect()) == [(0, 3), (3, 1), (4, 1)]
