import pytest

from tracefold.llm import names

GIVEN = frozenset({"anna", "maria", "bartholomew"})


@pytest.mark.parametrize(
    "name,parsed",
    [
        ("Anna B. Zuthudorran", ("p", "zuthudorran", "anna", "b", "")),
        ("ZUTHUDORRAN, Anna", ("p", "zuthudorran", "anna", "", "")),
        ("Zuthudorran AB", ("p", "zuthudorran", "a", "b", "")),
        ("A.B. Zuthudorran", ("p", "zuthudorran", "a", "b", "")),
        ("Zuthudorran, Anna da", ("p", "zuthudorran", "anna", "", "")),
        ("Bart Short", ("p", "short", "bartholomew", "", "")),
        ("Bartholomew Short, PhD", ("p", "short", "bartholomew", "", "")),
        ("The Zuthu Inst. f. River Studies (ZIRS)", ("o", "zuthu", "", "", "institute river studies")),
        ("Collaboration, Zuthu", ("o", "zuthu", "", "", "collaboration")),
        ("TISM", ("a", "tism", "", "", "")),
    ],
)
def test_parse(name, parsed):
    assert names.parse_name(name, GIVEN) == parsed


def groups(spark, works):
    rows = [(i, t, a, "x") for i, (t, a) in enumerate(works)]
    df = spark.createDataFrame(rows, "source_id long, title string, authors array<string>, name string")
    return {tuple(r) for r in names.variant_pairs(df).collect()}


def test_variants_are_linked_and_others_are_not(spark):
    works = [
        ("t one two three", ["Anna B. Zuthudorran", "Carl Meprovelk"]),
        ("t one two three", ["Zuthudorran, A.B.", "MEPROVELK, Carl"]),
        ("u", ["ANNA B. ZUTHUDORRAN", "Carla Meprovelk", None, "", "et al."]),
        ("v", ["Anna B. Zutuhdorran", "Erik Zuthudorran", "Zuthu Society for Rivers", "Zuthu Soc. f. Rivers"]),
        *((None, [f"{f}, {g}"]) for f, g in [("Abornu", "Carl"), ("Ebornu", "Carl"), ("Ibornu", "Carl"), ("Obornex", "Carla"), ("Uburnel", "Carla"), ("Yburmil", "Carla")]),
        (None, None),
    ]
    got = groups(spark, works)
    same = [{"Anna B. Zuthudorran", "Zuthudorran, A.B.", "ANNA B. ZUTHUDORRAN", "Anna B. Zutuhdorran"}, {"Carl Meprovelk", "MEPROVELK, Carl"}, {"Zuthu Society for Rivers", "Zuthu Soc. f. Rivers"}]
    assert got == {(a, b) for g in same for a in g for b in g if a < b}
    assert groups(spark, []) == set()
    df = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(works)], "source_id long, title string, authors array<string>")
    per_name = {r.name: (r.first_name, r.spellings) for r in names.name_clusters(df).collect()}
    assert all(per_name[n] == (min(g), len(g)) for g in same for n in g) and per_name["Erik Zuthudorran"] == ("Erik Zuthudorran", 1)


def test_average_linkage_equals_a_plain_one(spark):
    import random

    rng = random.Random(4)
    n = 14
    sim = {(a, b): round(rng.random(), 3) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
    clusters = [{i} for i in range(n)]
    mean = lambda x, y: sum(sim.get((min(a, b), max(a, b)), 0) for a in x for b in y) / len(x) / len(y)
    while True:
        best = max(((mean(x, y), -i, -j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j), default=(0, 0, 0))
        if best[0] < 0.4:
            break
        x, y = clusters[-best[1]], clusters[-best[2]]
        clusters = [c for c in clusters if c is not x and c is not y] + [x | y]
    nodes = spark.createDataFrame([(i, 1) for i in range(n)], "node long, size long")
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a long, b long, similarity double")
    got: dict = {}
    for r in names.average_linkage(nodes, edges, 0.4).collect():
        got.setdefault(r.cluster, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, clusters))


def test_family_join_finds_all_pairs_above_the_threshold(spark):
    import itertools
    import math
    from collections import Counter

    words = ["zuthudorran", "zutuhdorran", "zuthudoran", "vonzuthudorran", "meprovelk", "meprovelc", "kleiskatarey", "kleizkatarey", "abc", "li", "lii", "x", *(f"{a}{b}{c}" for a in ("ma", "zu", "li") for b in ("ro", "ku", "thi") for c in ("velk", "dorran"))]
    grams = {w: {f"^{w}$"[i : i + 3] for i in range(len(w))} for w in words}
    df = Counter(g for gs in grams.values() for g in gs)
    vec = {w: {g: math.log(1 + len(words) / df[g]) for g in gs} for w, gs in grams.items()}
    norm = {w: math.sqrt(sum(x * x for x in v.values())) for w, v in vec.items()}

    want = set()
    for a, b in itertools.combinations(sorted(words), 2):
        cos = sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) / norm[a] / norm[b]
        if cos >= 0.4:
            want.add((a, b))
    got = {(r.fa, r.fb) for r in names.family_links(spark.createDataFrame([(w,) for w in words], "family string"), 0.4).collect() if r.fa < r.fb}
    assert got == want and ("vonzuthudorran", "zuthudorran") in got
    few = names.family_links(spark.createDataFrame([(w,) for w in words], "family string"), 0.4, part=2)
    assert got == {(r.fa, r.fb) for r in few.collect() if r.fa < r.fb}


def clusters_of(df):
    got: dict = {}
    for r in df.collect():
        got.setdefault(r.cluster, set()).add(r.node)
    return sorted(map(sorted, got.values()))


def test_tied_nodes_form_one_cluster_however_many(spark):
    n = 100
    # A second group: one frequent spelling and rare ones tied with it alone, which join it one by one.
    star = range(1000, 1000 + 60)
    nodes = spark.createDataFrame([(i, 1) for i in range(n)] + [(i, 10_000 if i == 1000 else 1) for i in star], "node long, size long")
    edges = [(a, b, 0.9) for a in range(n) for b in range(a + 1, n)] + [(1000, i, 0.9) for i in star if i > 1000]
    got = names.average_linkage(nodes, spark.createDataFrame(edges, "a long, b long, similarity double"))
    assert clusters_of(got) == [list(range(n)), list(star)]


def test_rounds_in_one_task_and_over_tables_give_the_same(spark):
    import random

    rng = random.Random(9)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(50)]
    nodes = spark.createDataFrame([(i, rng.randint(1, 5)) for i in ids], "node long, size long")
    pairs = [(min(a, b), max(a, b)) for k, a in enumerate(ids) for b in ids[:k] if rng.random() < 0.3]
    edges = spark.createDataFrame([(a, b, rng.choice([0.95, 0.9, 0.855, 0.65])) for a, b in pairs], "a long, b long, similarity double")
    got = clusters_of(names.average_linkage(nodes, edges))
    assert got == clusters_of(names.average_linkage(nodes, edges, local=0)) and 1 < len(got) < 50


def test_a_key_of_many_rows_is_paired_whole(spark):
    rows = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 7), (None, 8)], "k long, v long")
    got = names.within_keys(rows.withColumnRenamed("v", "a"), rows.withColumnRenamed("v", "b"), ["k"], 4).collect()
    assert len(got) == len(set(got)) == 30 * 30 + 1


def test_a_string_of_two_authors_is_in_both_clusters_and_they_stay_apart(spark):
    works = []
    for i, first in enumerate(["Johanna", "Julius"]):
        works += [(f"work number {i} of some length", [f"{first} Meprovelk"]), (f"work number {i} of some length", ["J. Meprovelk"])]
        works += [(f"work number {i} of some length", [f"MEPROVELK, {first}"])]
    got = groups(spark, works)
    for first in ("Johanna", "Julius"):
        assert ("J. Meprovelk", f"MEPROVELK, {first}") in got and (f"{first} Meprovelk", f"MEPROVELK, {first}") in got
    assert not any("Johanna" in a + b and "Julius" in a + b for a, b in got)


def test_works_are_told_by_their_authors_however_many_records(spark):
    rows = [(i, "a title of many words", ["Ann Bellweather", f"N{i} Person{i}"]) for i in range(60)]
    rows += [(100 + i, "letter to the editor", [f"A. {chr(97 + i % 26)}{chr(97 + i // 26)}morton"]) for i in range(60)]
    df = spark.createDataFrame(rows, "source_id long, title string, authors array<string>")
    parsed = names.parsed_names(names.distinct_names(df), frozenset())
    assert names.works_of_nodes(df, parsed).select("work").distinct().count() == 1


def test_pairs_of_lots_are_those_of_one_and_scratch_goes(spark, monkeypatch):
    from pathlib import Path

    from tracefold.session import ensure_checkpoint_dir

    at = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    works = [(f"work number {i} of some length", [f"Anna {a}{b}velk", f"{a}{b}velk, A."]) for i, (a, b) in enumerate((a, b) for a in ("Mero", "Zuthu", "Liro") for b in ("ku", "thi", "ro"))]
    whole = groups(spark, works)
    monkeypatch.setattr(names, "LOT_PAIRS", 20, raising=False)
    before = set(at.iterdir())
    assert groups(spark, works) == whole != set()
    left = {p.name.rsplit("-", 1)[0] for p in set(at.iterdir()) - before}
    assert not left & {"family-vectors", "family-prefixes", "named-works", "linkage", "nearest"}
