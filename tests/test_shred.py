import json

from tracefold.operators import shred


def leaves(spark, payloads):
    raw = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "raw_id long, payload string, node string")
    return sorted((r.raw_id, r.item_pos, r.field, r.pos1, r.pos2, r.value) for r in shred.work_leaves(shred.shred(raw)).collect())


def test_places_and_shapes(spark):
    work = {
        "indexed": {"date-parts": [[2020, None, "05"], [2021]]},
        "license": [None, {"URL": "http://a"}, {"URL": None}, {"start": {}}],
        "content-domain": {"domain": ["x.example", None, "y.example"]},
    }
    got = leaves(spark, [json.dumps({"message": work})])
    assert got == [
        (0, 0, "content-domain.domain", 0, 0, "x.example"),
        (0, 0, "content-domain.domain", 2, 0, "y.example"),
        (0, 0, "indexed.date-parts", 0, 0, "2020"),
        (0, 0, "indexed.date-parts", 0, 2, "05"),
        (0, 0, "indexed.date-parts", 1, 0, "2021"),
        (0, 0, "license.URL", 1, 0, "http://a"),
    ]


def test_wrapping_and_single_values(spark):
    flat = {"indexed": {"date-parts": [2016, None, 7]}, "license": {"URL": "u"}, "content-domain": {"domain": "d"}}
    expected = [("content-domain.domain", 0, 0, "d"), ("indexed.date-parts", 0, 0, "2016"), ("indexed.date-parts", 0, 2, "7"), ("license.URL", 0, 0, "u")]
    got = leaves(spark, [json.dumps(flat), json.dumps({"message": json.dumps(flat)}), json.dumps({"message": {"items": [None, flat]}})])
    assert [(r[0], r[1]) for r in got] == [(0, 0)] * 4 + [(1, 0)] * 4 + [(2, 1)] * 4
    assert [r[2:] for r in got] == expected * 3
    mixed = {"indexed": {"date-parts": [[2001], 2002]}}
    assert [r[3:] for r in leaves(spark, [json.dumps(mixed)])] == [(0, 0, "2001"), (1, 0, "2002")]
    assert [r[3:] for r in leaves(spark, ['{"indexed": {"date-parts": 1999}}'])] == [(0, 0, "1999")]


def test_what_holds_no_work_gives_nothing(spark):
    bad = [None, "", "no json", "[1]", "1", '{"message": null}', '{"message": "text"}', '{"message": []}', '{"message": {"items": []}}', '{"a": NaN}', '{"indexed": {"date-parts": []}', "[" * 5000]
    assert leaves(spark, bad) == []
    assert leaves(spark, []) == []


def test_values_stay_as_printed(spark):
    got = leaves(spark, ['{"indexed": {"date-parts": [[2.50, 1e3, true, 12345678901234567890123]]}, "license": {"URL": "http:\\/\\/a\\u00e9\\ud800"}}'])
    assert [r[5] for r in got] == ["2.50", "1e3", "true", "12345678901234567890123", "http://aé?"]


def test_entities_keep_their_links(spark):
    payload = json.dumps({"message": {"DOI": "10.1/a", "author": [{"given": "A", "family": "B"}, None, {"name": "Org"}], "reference": [{"key": "r1", "DOI": "d"}]}})
    nodes = shred.shred(spark.createDataFrame([(5, payload)], "raw_id long, payload string"))
    work = shred.work_table(nodes).collect()[0]
    assert (work.raw_id, work.item_pos, work.doi) == (5, 0, "10.1/a")
    authors = sorted((a.pos, a.given, a.family, a.name) for a in shred.author_table(nodes).collect())
    assert authors == [(0, "A", "B", None), (2, None, None, "Org")]
    assert {a.work_node for a in shred.author_table(nodes).collect()} == {work.work_node}
    assert [(r.pos, r.key, r.doi) for r in shred.reference_table(nodes).collect()] == [(0, "r1", "d")]
