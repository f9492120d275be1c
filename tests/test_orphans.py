import random
from datetime import datetime, timedelta

from tracefold.operators import orphans

CLAIMS = "row_id long, ledger_id long, claim_id string, ref_ids array<string>, arrived_at timestamp, deleted_at timestamp, kind string"
REFS = "row_id long, ledger_id long, ref_id string, cited_by_claims array<string>, arrived_at timestamp, deleted_at timestamp, kind string"
DAY = datetime(2025, 1, 1)


def brute(claims, refs):
    out = set()
    for name, own, other in (("ledger_claims", claims, refs), ("bib_refs", refs, claims)):
        for r in own:
            if r[5] is not None:
                continue
            for key in {k for k in r[3] or [] if k is not None}:
                there = [o for o in other if o[1] == r[1] and o[2] == key]
                live = [o for o in there if o[5] is None]
                kind = "missing" if not there else "deleted" if not live else None
                if live and r[4] and all(o[4] is not None and o[4] > r[4] for o in live):
                    kind = "late"
                if kind:
                    out.add((name, r[0], key, kind, r[4].strftime("%Y-%m") if r[4] else None))
    return out


def found(spark, claims, refs, **kw):
    df = orphans.orphan_references(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(refs, REFS), **kw)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_tables_match_brute_force(spark):
    rng = random.Random(7)
    for _ in range(3):
        def side(letter, other):
            return [
                (
                    i, rng.choice([1, 1, 1, 2, None]), rng.choice([f"{letter}{rng.randrange(6)}", "", None]),
                    rng.choice([None, [], [f"{other}{rng.randrange(8)}" for _ in range(rng.randrange(5))] + [None, ""]]),
                    rng.choice([DAY + timedelta(days=rng.randrange(90)), None]), rng.choice([None, None, DAY]), "extra",
                )
                for i in range(60)
            ]

        claims, refs = side("C", "R"), side("R", "C")
        assert found(spark, claims, refs) == brute(claims, refs)


def test_one_hot_key_and_empty_tables(spark):
    claims = [(i, 1, f"C{i}", ["R1"], DAY, None, "x") for i in range(300)]
    assert len(found(spark, claims, [])) == 300
    assert found(spark, [], []) == set()
    late = [(1, 1, "R1", None, DAY + timedelta(days=1), None, "x")]
    assert {r[3] for r in found(spark, claims, late)} == {"late"}


def test_folding_in_two_batches_gives_the_same_state(spark):
    claims = spark.createDataFrame([(i, 1, f"C{i}", [f"R{i % 3}", "R9"], DAY, None, "x") for i in range(20)], CLAIMS)
    refs = spark.createDataFrame([(i, 1, f"R{i}", [f"C{i}"], DAY, DAY if i == 2 else None, "x") for i in range(3)], REFS)
    whole = orphans.key_state(orphans.fold_deltas(orphans.change_deltas(claims, refs)))
    deltas = orphans.reference_deltas(claims, "ledger_claims", "ref_ids")
    first, second = deltas.filter("ledger_id = 1").limit(15), orphans.existence_deltas(refs, "ref_id", "ledger_claims")
    rest = deltas.exceptAll(first)
    folded = orphans.fold_deltas(orphans.fold_deltas(first).unionByName(orphans.fold_deltas(rest.unionByName(second)).select(orphans.fold_deltas(first).columns)))
    state = orphans.key_state(folded)
    mine = {tuple(r) for r in state.collect()}
    assert mine == {tuple(r) for r in whole.filter("source_table = 'ledger_claims'").collect()}
    assert {r.target_key for r in orphans.open_keys(state).collect()} == {"R2", "R9"}


def test_a_later_deletion_takes_counts_and_arrivals_back(spark):
    t = lambda n: DAY + timedelta(days=n)
    claims = [(1, 1, "C1", ["R1"], t(5), None, "x"), (2, 1, "C2", ["R1"], t(9), t(20), "x")]
    refs = [(1, 1, "R1", None, t(1), t(20), "x"), (2, 1, "R1", None, t(7), t(30), "x")]
    deltas = orphans.change_deltas(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(refs, REFS)).filter("target_key = 'R1'").cache()
    got = []
    for day in (10, 25, 40):
        # The state of one day after the other, each from the one before and the changes since.
        folded = orphans.fold_deltas(deltas.filter(deltas.happened_at <= t(day)))
        r = orphans.key_state(folded).first()
        got.append((r.refs, r.inserted, r.existing, r.named_at, r.usable_at))
    assert got == [(2, 2, 2, t(5), t(1)), (1, 2, 1, t(5), t(7)), (1, 2, 0, t(5), None)]


def test_rows_of_a_hot_key_are_spread(spark):
    from tracefold.functions.skew import spread_join

    rows = spark.createDataFrame([(1 if i % 3 else i + 10, i) for i in range(300)] + [(None, 999)], "k long, row long")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", rows.k * 2)
    for share in (1, 3, 1000):
        got = spread_join(rows, keyed.filter("k is not null"), ["k"], "n", "row", share).collect()
        assert sorted((r.k, r.row, r.v) for r in got) == sorted((1 if i % 3 else i + 10, i, 2 * (1 if i % 3 else i + 10)) for i in range(300))
