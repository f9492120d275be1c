from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracefold.config import STATUSES
from tracefold.operators import constraints, counts, linkage, state

T = datetime(2025, 1, 1)
SOURCE = "source_id long, provider string, title string, authors array<string>, year int, doi string, arxiv_id string, is_retracted boolean, is_preprint boolean"
REF = "row_id long, ledger_id long, ref_id string, title string, authors array<string>, year int, doi string, arxiv_id string"


def test_latest_and_ties(spark):
    df = spark.createDataFrame([(1, "a", T, 1, "old"), (1, "a", T + timedelta(1), 2, "new"), (1, "b", None, 3, None), (1, "b", None, 4, "x")], "k long, id string, at timestamp, row_id long, v string")
    assert {(r.id, r.row_id, r.v) for r in state.latest(df, ["k", "id"], ["at", "row_id"]).collect()} == {("a", 2, "new"), ("b", 4, "x")}


def test_cache(spark):
    rows = [(1, "k", "{}", T), (2, "k", '\n {"a":1}', T + timedelta(hours=10)), (3, "old", "{}", T), (4, "bad", "{", T + timedelta(hours=11)), (5, "list", "[]", T + timedelta(hours=11))]
    df = spark.createDataFrame(rows, "raw_id long, cache_key string, payload string, fetched_at timestamp")
    now = F.lit(T + timedelta(hours=12))
    hits = state.cache_get(df, now, 2)
    assert [r.raw_id for r in hits.collect()] == [2]
    assert {r.raw_id for r in state.cache_get(df, now, 12).collect()} == {2, 3}
    assert {r.raw_id for r in state.cache_get(df, now, 11.9).collect()} == {2}
    wanted = spark.createDataFrame([("k",), ("new",), ("new",)], "cache_key string")
    assert [r.cache_key for r in state.cache_misses(wanted, hits).collect()] == ["new"]


def test_waterfall(spark):
    sources = spark.createDataFrame(
        [
            (1, "crossref", "A title of note", None, 2000, "10.1/a", None, False, False),
            (2, "openalex", "A title of note", None, 2000, "https://doi.org/10.1/A", None, True, None),
            (3, "arxiv", "Another", None, 2001, "10.48550/arxiv.1", "1111.2222v3", False, True),
            (4, "openalex", "Lone", None, 2002, None, None, None, False),
        ],
        SOURCE,
    )
    refs = spark.createDataFrame(
        [
            (1, 1, "R1", None, None, None, "doi:10.1/A.", None),
            (2, 1, "R2", "a TITLE of note!", None, None, "10.9/none", None),
            (3, 1, "R3", None, None, None, None, "1111.2222"),
            (4, 1, "R4", None, None, None, "10.48550/arXiv.1111.2222", None),
            (5, 1, "R5", "lone", None, None, None, "9999.9999"),
            (6, 1, "R6", None, None, None, None, None),
        ],
        REF,
    )
    got = {r.row_id: (r.source_id, r.branch) for r in linkage.resolve(refs, sources).collect()}
    assert got == {1: (1, "doi"), 2: (1, "title_search"), 3: (3, "arxiv_id"), 4: (3, "arxiv_id"), 5: (4, "title_search"), 6: (None, None)}
    flags = {r.source_id: r.is_retracted for r in linkage.retracted(sources).collect()}
    assert flags == {1: True, 2: True, 3: False, 4: False}


def test_divergent_duplicates_match_a_plain_loop(spark):
    rows = [(i, 1 + i % 2, f"R{i}", ["Same Title", "same title!", "Other", None, " "][i % 5], [["Ann Bell"], ["Bell, Ann"], ["Cy Dane"]][i % 3], [2000, None][i % 4 == 0], [None, "10.1/x", "10.1/y", ""][i % 4], None) for i in range(40)]
    refs = spark.createDataFrame(rows, REF)
    got = {r.row_id: r.sibling for r in linkage.divergent_duplicates(refs).collect()}
    fam = {"Ann Bell": "b", "Bell, Ann": "b", "Cy Dane": "d"}
    key = lambda r: (r[1], "".join(c for c in r[3].lower() if c.isalnum() or c == " ").strip(), r[5])
    ident = lambda r: (r[6] or "", fam[r[4][0]])
    titled = [r for r in rows if r[3] and r[3].strip()]
    want = {r[0]: min(o[0] for o in titled if key(o) == key(r) and ident(o) != ident(r)) for r in titled if any(key(o) == key(r) and ident(o) != ident(r) for o in titled)}
    assert got == want


def test_signals_and_indicators(spark):
    sources = spark.createDataFrame([(1, "openalex", "A title of note", ["Ann Bell"], 2001, "10.1/b", None, True, True)], SOURCE)
    refs = spark.createDataFrame([(1, 1, "R1", "a title of note", ["Bell, Ann"], 2000, "10.1/a", None), (2, 1, "R2", None, None, None, None, None)], REF)
    resolved = linkage.resolve(refs, sources)
    s = linkage.signals(refs, sources, resolved).collect()[0]
    assert (s.title_similarity, s.author_overlap, s.year_delta, s.doi_match) == (1.0, 1.0, 1, False)
    claims = spark.createDataFrame([(1, "C1", ["R1", None, "R1"]), (1, "C2", None)], "ledger_id long, claim_id string, ref_ids array<string>")
    got = {r.row_id: r.indicators for r in linkage.indicators(refs, claims, sources, resolved).collect()}
    assert got == {1: "retracted,doi_mismatch,version_mismatch", 2: "orphan"}
    assert [(r.ref_id, r.claims, r.first_claim) for r in linkage.citing_claims(claims).collect()] == [("R1", 1, "C1")]


VERDICT = "verdict_id long, ledger_id long, ref_id string, status string, confidence double, rationale string, checks array<string>, indicators array<string>, judge_model string, priority double, judged_at timestamp"


def verdicts(spark, *rows):
    full = [dict(verdict_id=i, ledger_id=1, ref_id=f"R{i}", status="verified", confidence=0.5, rationale="ok", checks=[], indicators=[], judge_model="m", priority=0.0, judged_at=T) | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in VERDICT.split(", ")) for r in full], VERDICT)


def test_counts_have_zeros(spark):
    v = verdicts(spark, {}, {"status": "conflict", "indicators": ["orphan"]}, {"status": None})
    assert {(r.status, r.n) for r in counts.summary_counts(v).collect()} == {("verified", 1), ("conflict", 1), ("needs_check", 0), ("unresolvable", 0)}
    assert {r.indicator: r.n for r in counts.indicator_counts(v).collect()}["orphan"] == 1
    assert counts.summary_counts(v.limit(0)).count() == 0
    assert {r.share for r in counts.status_shares(v.limit(0)).collect()} == {0.0}


def test_worklist_order(spark):
    v = verdicts(spark, {"priority": 0.5}, {"priority": 0.9}, {"priority": 0.5, "ref_id": "R"}, {"priority": None})
    assert [r.ref_id for r in counts.worklist(v, 3).orderBy("position").collect()] == ["R1", "R", "R0"]


def test_reconcile_and_matches(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "l long, r string"), spark.createDataFrame([(1, "y"), (2, "z")], "l long, r string")
    assert {(r.l, r.r, r.side) for r in counts.reconcile(a, b, ["l", "r"]).collect()} == {(1, "x", "expected only"), (2, "z", "observed only")}
    scored = spark.createDataFrame([("d1", True), ("d1", None), ("d2", True)], "d string, ok boolean")
    assert {r.d: r.detected for r in counts.all_rows_match(scored, ["d"], "ok").collect()} == {"d1": False, "d2": True}
    sets = spark.createDataFrame([(["a", "b", "a"], ["b", "a"]), (None, []), (["a"], None)], "x array<string>, y array<string>")
    assert [r.s for r in sets.select(counts.same_set(F.col("x"), F.col("y")).alias("s")).collect()] == [True, True, False]
    pairs = spark.createDataFrame([("verified", "conflict"), ("verified", "verified")], "e string, o string")
    assert {r.status: (r.expected, r.observed, r.matched) for r in counts.confusion(pairs, STATUSES, "e", "o").collect()}["verified"] == (2, 1, 1)


def test_open_items(spark):
    v = verdicts(spark, {"ref_id": "A", "status": "conflict"}, {"ref_id": "A", "judged_at": T + timedelta(1)}, {"ref_id": "B", "status": "conflict", "judged_at": T + timedelta(2)}, {"ref_id": "B"})
    got = counts.not_followed(v, F.col("status") != "verified", F.col("status") == "verified", ["ledger_id", "ref_id"], "judged_at")
    assert [r.ref_id for r in got.collect()] == ["B"]


def test_constraints(spark):
    good = verdicts(spark, {}, {"confidence": None})
    rules = constraints.verdict_rules()
    assert constraints.violations(good, "verdict_id", rules).count() == 0
    bad = verdicts(spark, {"confidence": 1.5}, {"rationale": ""}, {"checks": list("abcd")}, {"status": "odd"}, {"indicators": ["odd"]}, {"ref_id": None}, {"priority": -1.0})
    assert {r.rule for r in constraints.violations(bad, "verdict_id", rules).collect()} == set(rules)
    assert constraints.strict(good, rules).count() == 2
    with pytest.raises(Exception, match="broken: unknown_status"):
        constraints.strict(verdicts(spark, {"status": "odd"}), rules).collect()
    assert constraints.repeated_keys(verdicts(spark, {"ref_id": "A"}, {"ref_id": "A"}), ["ledger_id", "ref_id"]).collect()[0].n == 2
    terms = constraints.banned_terms(verdicts(spark, {"rationale": "A Hoax!"}), "verdict_id", [F.col("rationale")], ("hoax", "scam"))
    assert [r.term for r in terms.collect()] == ["hoax"]


def test_first_match_is_ordered(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    out = df.select(linkage.first_match([(F.col("x") > 3, F.lit("big")), (F.col("x") > 0, F.lit("some"))], F.lit("none")).alias("r"))
    assert [r.r for r in out.collect()] == ["some", "big", "none"]
