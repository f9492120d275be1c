import json

import pytest
from pyspark.sql import functions as F

from tracefold.config import Settings, load_settings
from tracefold.operators import orphans
from tracefold.sources import files, payloads, replies
from tracefold.streaming import arrivals


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).collect()[0].x


def test_settings(tmp_path):
    import dataclasses

    import yaml

    whole = dataclasses.asdict(Settings()) | {"banned_terms": ["a"]}
    p = tmp_path / "s.yaml"
    p.write_text(yaml.safe_dump(whole))
    assert load_settings(str(p)).banned_terms == ("a",)
    p.write_text(yaml.safe_dump({k: v for k, v in whole.items() if k != "title_weak"}))
    with pytest.raises(ValueError):
        load_settings(str(p))


def test_names(spark):
    df = spark.createDataFrame([("/in/a.b (1).PDF",)], "p string")
    n = files.document_name(F.col("p"))
    r = df.select(n.alias("n"), files.stem(n).alias("s"), files.label_stem(n).alias("l"), files.ledger_path(n, "out/").alias("o")).collect()[0]
    assert tuple(r) == ("a.b (1).PDF", "a.b (1)", "a.b (1)", "out/a.b (1)_ledger.json")


def test_ledgers_round_trip_and_refuse_unknown_keys(spark, tmp_path):
    refs = spark.createDataFrame([(1, "R1", "Raw “text”\n", "T", ["A"], 2000, None, None, "V")], "ledger_id long, ref_id string, raw_text string, title string, authors array<string>, year int, doi string, arxiv_id string, venue string")
    v = spark.createDataFrame([(1, "R1", "verified", 0.5, "why", ["c"], "m", 0.25)], "ledger_id long, ref_id string, status string, confidence double, rationale string, checks array<string>, judge_model string, priority double")
    entries = files.ledger_entries(refs, v)
    path = str(tmp_path / "out")
    files.write_ledgers(entries, path)
    back = files.read_ledgers(spark, path).select(*entries.columns)
    assert [r.asDict(True) for r in back.collect()] == [r.asDict(True) for r in entries.collect()]
    (tmp_path / "bad").mkdir()
    # The job ends at the first such line; nothing is read beforehand.
    for i, text in enumerate(['{"ledger_id": 1, "odd": 2}', '{"ledger_id": 1, "reference": {"ref_id": "R1", "odd": 2}}', '{"ledger_id": 1, "verdict": {"odd": []}}']):
        (tmp_path / "bad" / f"{i}").mkdir()
        (tmp_path / "bad" / f"{i}" / "x.json").write_text(text + "\n")
        with pytest.raises(Exception, match="unknown key: odd"):
            files.read_ledgers(spark, str(tmp_path / "bad" / f"{i}")).collect()
    (tmp_path / "bad" / "x.json").write_text("no json\n")
    with pytest.raises(Exception):
        files.read_ledgers(spark, str(tmp_path / "bad" / "x.json")).collect()


def test_newest_ledgers_come_first(spark, tmp_path):
    import os

    for k, name in enumerate(["b_ledger.json", "a_ledger.json", "notes.json"]):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1_000_000 + k, 1_000_000 + k))
    assert [r.file for r in files.newest_ledgers(spark, str(tmp_path)).collect()] == ["a_ledger.json", "b_ledger.json"]


def test_labels(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"document": "p", "control": False, "labels": [{"ref_id": "R1", "expected_indicators": ["orphan"], "injected": True}]}, indent=1))
    r = files.read_labels(spark, str(tmp_path)).collect()[0]
    assert (r.document, r.ref_id, r.expected_indicators, r.injected) == ("p", "R1", ["orphan"], True)


def test_binary_documents_and_fetching(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("page one\fpage two".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    rows = {r.name: r for r in files.decoded_documents(spark, str(tmp_path), lambda b: b.decode().split("\f")).collect()}
    assert rows["a.txt"].pages == ["page one", "page two"] and rows["a.txt"].note is None
    assert rows["b.txt"].pages == [] and "UnicodeDecodeError" in rows["b.txt"].note

    def fetch(url):
        if url == "raises":
            raise OSError("down")
        return (404, "") if url == "gone" else (200, "{}")

    asked = spark.createDataFrame([("1", "ok"), ("1", "ok"), ("2", "gone"), ("3", "raises")], "cache_key string, url string")
    got = {r.cache_key: (r.payload, r.note) for r in files.fetched(asked, fetch).collect()}
    assert got == {"1": ("{}", None), "2": (None, "status 404"), "3": (None, "OSError: down")}


def test_crossref_shapes(spark):
    works = [
        {"message": {"DOI": "d", "title": ["T"], "container-title": [], "type": "posted-content", "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[None]]}, "created": {"date-parts": [[2003]]}}},
        {"message": {"title": "T2", "author": [{"name": "Org"}]}},
        {"message": {"items": []}},
        {"message": "x"},
    ]
    raw = spark.createDataFrame([(i, json.dumps(w)) for i, w in enumerate(works)] + [(9, "no"), (10, None)], "raw_id long, payload string")
    rows = {r.raw_id: r for r in payloads.crossref_works(raw).collect()}
    assert set(rows) == {0, 1}
    assert (rows[0].title, rows[0].venue, rows[0].year, rows[0].authors, rows[0].is_preprint) == ("T", None, 2003, ["A B"], True)
    assert (rows[1].title, rows[1].authors, rows[1].year, rows[1].is_preprint) == ("T2", ["Org"], None, None)


def test_openalex_and_arxiv(spark):
    body = json.dumps({"doi": "d", "title": "T", "authorships": [{"author": {"display_name": "A"}}], "publication_year": 2001, "type": "article", "primary_location": {"source": {"display_name": "J", "type": "journal"}}})
    r = one(spark, payloads.openalex_work(F.col("t")), body)
    assert (r.title, r.authors, r.year, r.is_retracted, r.is_preprint, r.venue) == ("T", ["A"], 2001, False, False, "J")
    assert one(spark, payloads.openalex_work(F.col("t")), "no").title is None
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1234.5v2</id><title>A\n  title</title><published>2019-01-01</published><author><name>A B</name></author></entry></feed>'
    r = one(spark, payloads.arxiv_entry(F.col("t"), F.lit("1234.5")), feed)
    assert (r.arxiv_id, r.title, r.year, r.authors, r.doi, r.is_preprint) == ("1234.5v2", "A title", 2019, ["A B"], None, True)
    assert one(spark, payloads.arxiv_entry(F.col("t"), F.lit("x")), '<feed xmlns="http://www.w3.org/2005/Atom"/>') is None


def test_replies(spark):
    fenced = 'text\n```json\n{"title": " T ", "authors": ["A", " "], "year": "c. 1999", "doi": ""}\n```'
    r = one(spark, replies.reference_fields(F.col("t")), fenced)
    assert (r.title, r.authors, r.year, r.doi) == ("T", ["A"], 1999, None)
    assert one(spark, replies.reference_fields(F.col("t")), '{"title": "x", "odd": 1}') is None
    assert one(spark, replies.reference_fields(F.col("t")), "no json") is None
    judged = '<think>{"status": "conflict"}</think> {"a": "}"} {"status": " Verified", "confidence": 3, "rationale": "r", "checks": ["a", "", "b", "c", "d"]}'
    r = one(spark, replies.verdict_fields(F.col("t")), judged)
    assert (r.status, r.confidence, r.rationale, r.checks) == ("verified", 1.0, "r", ["a", "b", "c"])
    for bad in ('{"status": "odd", "rationale": "r"}', '{"status": "verified", "rationale": " "}', "{", None):
        assert one(spark, replies.verdict_fields(F.col("t")), bad) is None


def test_stream_of_arrivals(spark, tmp_path):
    rows = [(1, "2025-01-01 00:00:00"), (1, "2025-01-01 00:00:00"), (2, "2025-01-09 00:00:00")]
    spark.createDataFrame(rows, "row_id long, at string").selectExpr("row_id", "cast(at as timestamp) arrived_at", "cast(null as timestamp) deleted_at").write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), "row_id long, arrived_at timestamp, deleted_at timestamp")
    got = arrivals.run_available(arrivals.first_deliveries(stream, ["row_id"], "arrived_at"), "test")
    assert sorted(r.row_id for r in got.collect()) == [1, 2]


def test_state_folded_by_a_stream(spark, tmp_path):
    schema = "row_id long, ledger_id long, claim_id string, ref_ids array<string>, arrived_at timestamp, deleted_at timestamp"
    claims = spark.createDataFrame([(1, 1, "C1", ["R1", "R2"], None, None)], schema)
    deltas = orphans.reference_deltas(claims, "ledger_claims", "ref_ids")
    fold = arrivals.fold_into(str(tmp_path / "state"))
    fold(deltas, 0)
    fold(deltas, 1)
    fold(deltas, 1)  # a batch that is run again
    assert {r.target_key: r.refs for r in arrivals.folded_state(spark, str(tmp_path / "state")).collect()} == {"R1": 2, "R2": 2}


def test_progress_logs(spark, tmp_path):
    from tracefold.sources import progress

    (tmp_path / "mo.md").write_text(
        "# what mo did\n~~~\n## 0:05 — K1 READY\n~~~\n## 0:50 — K1 part two blocked\nWaits for: the key\n9: no field\n\nprose\n"
        "## 1:10 -- REQUEST → @bo\nask: a key\n#### aside\nask: not of the block\n## 1:40 – k1 PART two MERGED\nurl: http://x\n## soon - MERGED\n## 2:05 - request Merged\n"
    )
    (tmp_path / "bo.md").write_text("## 0:20 - K7 BLOCKED\n## 0:30 - REQUEST -> mo\n")
    (tmp_path / "_shape.md").write_text("## 0:01 — X READY\n")
    parsed = progress.blocks(progress.read_logs(spark, str(tmp_path)))
    rows = {(r.person, r.lineno): r for r in parsed.collect()}
    assert set(rows) == {("mo", 5), ("mo", 10), ("mo", 14), ("mo", 16), ("mo", 17), ("bo", 1), ("bo", 2)}
    first = rows["mo", 5]
    assert (first.clock, first.minutes, first.module, first.status) == ("0:50", 50, "K1 part two", "BLOCKED")
    assert [(f.k, f.v) for f in first.fields] == [("Waits for", "the key")]
    asked = rows["mo", 10]
    assert (asked.module, asked.status, asked.owner, [(f.k, f.v) for f in asked.fields]) == ("REQUEST", "REQUEST", "bo", [("ask", "a key")])
    assert [(f.k, f.v) for f in rows["mo", 14].fields] == [("url", "http://x")]
    assert rows["mo", 16].status is None and rows["mo", 16].minutes == progress.UNKNOWN_CLOCK
    assert {(r.person, r.status) for r in progress.latest_per_person(parsed).collect()} == {("mo", "MERGED"), ("bo", "REQUEST")}
    assert [(r.person, r.module) for r in progress.open_items(parsed).collect()] == [("bo", "K7"), ("bo", "REQUEST")]


def test_label_rules(spark, tmp_path):
    from tracefold.operators import constraints

    def write(name, **kw):
        row = {"ref_id": "R01", "expected_status": "verified", "expected_indicators": [], "injected": False}
        labels = [row | x for x in kw.pop("labels", [{}])]
        (tmp_path / name).write_text(json.dumps({"document": "p.pdf", "control": False, "source": {"license": "CC0"}, "labels": labels} | kw))

    def rules():
        return sorted((r.ref_id, r.rule) for r in constraints.label_violations(files.read_labels(spark, str(tmp_path))).collect())

    write("p.json", labels=[{}, {"ref_id": "R02", "injected": True, "defect_id": "d1", "defect": "x", "verified_by": "a", "verified_on": "2025-01-31"}])
    assert rules() == []
    write("p.json", control=True, source={}, labels=[{"expected_status": "odd", "expected_indicators": ["odd"]}, {"injected": True}, {"ref_id": "R03", "defect": "x", "verified_by": "a"}, {"ref_id": "R04", "verified_by": "a", "verified_on": "31.1.2025"}])
    got = {rule for _, rule in rules()}
    assert got == {"unknown_licence", "id_out_of_turn", "unknown_status", "unknown_indicator", "injected_without_defect", "defect_without_injection", "half_verified", "bad_date", "injected_in_control", "repeated_id"}
    write("p.json", labels=[{"injected": True, "defect_id": "d", "defect": "x"}])
    write("q.json", document="other", labels=[{"injected": True, "defect_id": "d", "defect": "x"}])
    assert {rule for _, rule in rules()} == {"file_name", "defect_in_several_documents"}
