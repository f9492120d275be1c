"""Counts, shares, rankings and reconciliations of judged ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.config import INDICATORS, STATUS_ORDER, STATUSES


def zero_filled(df: DataFrame, keys: list[str], column: str, vocabulary: tuple[str, ...]) -> DataFrame:
    """(keys, column, n): counts per key and word of the vocabulary, zeros included. One aggregation with a counter
    per word, then unfolded: no join with the vocabulary."""
    counters = [F.count_if(F.col(column) == w).alias(f"c{i}") for i, w in enumerate(vocabulary)]
    wide = df.groupBy(*keys).agg(*counters) if keys else df.agg(*counters)
    words = F.array(*(F.struct(F.lit(w).alias(column), F.col(f"c{i}").alias("n")) for i, w in enumerate(vocabulary)))
    return wide.select(*keys, F.explode(words).alias("w")).select(*keys, f"w.{column}", "w.n")


def summary_counts(verdicts: DataFrame) -> DataFrame:
    return zero_filled(verdicts, ["ledger_id"], "status", STATUSES)


def indicator_counts(verdicts: DataFrame) -> DataFrame:
    counters = [F.count_if(F.array_contains("indicators", w)).alias(f"c{i}") for i, w in enumerate(INDICATORS)]
    words = F.array(*(F.struct(F.lit(w).alias("indicator"), F.col(f"c{i}").alias("n")) for i, w in enumerate(INDICATORS)))
    return verdicts.groupBy("ledger_id").agg(*counters).select("ledger_id", F.explode(words).alias("w")).select("ledger_id", "w.indicator", "w.n")


def coverage(part: Column, whole: Column) -> Column:
    """Share to 4 places; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 4))


def headline(verdicts: DataFrame, resolved: DataFrame, claims: DataFrame) -> DataFrame:
    """Counts per ledger. resolved: (ledger_id, ref_id) of references with a record; coverage is the share of entries
    with one. claims: the ledgers' claims."""
    found = resolved.select("ledger_id", "ref_id", F.lit(True).alias("found")).dropDuplicates(["ledger_id", "ref_id"])
    total, verified, known = F.count(F.lit(1)), F.count_if(F.col("status") == "verified"), F.count_if("found")
    per = verdicts.join(found, ["ledger_id", "ref_id"], "left").groupBy("ledger_id").agg(
        total.alias("total"),
        (total - verified).alias("worth_checking"),
        verified.alias("verified"),
        known.alias("resolved"),
        coverage(known.cast("double"), total).alias("coverage"),
        F.countDistinct("judge_model").alias("judges"),
    )
    said = claims.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("claims"))
    return per.join(said, "ledger_id", "left").fillna({"claims": 0})


def shared_ids(rows: DataFrame, column: str) -> DataFrame:
    """(ids, rows, not_in_pairs): distinct ids of all rows, rows with one, and ids that other than two rows share."""
    each = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") != 2).alias("not_in_pairs"))


def status_shares(verdicts: DataFrame) -> DataFrame:
    """Count and share per status over all ledgers, worst first by position."""
    n = zero_filled(verdicts, [], "status", STATUSES)
    total = F.sum("n").over(Window.partitionBy())  # four rows
    return n.select(
        "status",
        F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")).cast("int").alias("position"),
        "n",
        F.when(total == 0, 0.0).otherwise(F.round(F.col("n") / total, 4)).alias("share"),
    )


def judge_models(verdicts: DataFrame) -> DataFrame:
    """Distinct judges per ledger with their first verdict: first-seen order without a list."""
    return verdicts.groupBy("ledger_id", "judge_model").agg(F.min("verdict_id").alias("first_seen"), F.count(F.lit(1)).alias("n"))


def worklist(verdicts: DataFrame, k: int) -> DataFrame:
    """The first k references of each ledger by priority, then id. Spark keeps k rows per group while it reads."""
    w = Window.partitionBy("ledger_id").orderBy(F.col("priority").desc_nulls_last(), F.col("ref_id").asc(), F.col("verdict_id").asc())
    ranked = verdicts.select("ledger_id", "ref_id", "verdict_id", "status", "priority", F.row_number().over(w).alias("position"))
    return ranked.filter(F.col("position") <= k)


def reconcile(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): ids that only one side has. An empty result means that both agree."""
    a = expected.select(*keys).dropDuplicates().withColumn("expected", F.lit(True))
    b = observed.select(*keys).dropDuplicates().withColumn("observed", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.filter(F.col("expected").isNull() | F.col("observed").isNull()).select(
        *keys, F.when(F.col("observed").isNull(), "expected only").otherwise("observed only").alias("side")
    )


def all_rows_match(scored: DataFrame, group: list[str], matched: str) -> DataFrame:
    """(group, rows, matched_rows, detected): a group is detected only if every row of it matches."""
    return scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(matched)).alias("matched_rows"),
        F.every(F.coalesce(F.col(matched), F.lit(False))).alias("detected"),
    )


def confusion(scored: DataFrame, vocabulary: tuple[str, ...], expected: str, observed: str) -> DataFrame:
    """(status, expected, observed, matched): three independent counts per word of the vocabulary."""
    wide = scored.agg(
        *(c for i, w in enumerate(vocabulary) for c in (
            F.count_if(F.col(expected) == w).alias(f"e{i}"),
            F.count_if(F.col(observed) == w).alias(f"o{i}"),
            F.count_if((F.col(expected) == w) & (F.col(observed) == w)).alias(f"m{i}"),
        ))
    )
    rows = F.array(*(F.struct(F.lit(w).alias("status"), F.col(f"e{i}").alias("expected"), F.col(f"o{i}").alias("observed"), F.col(f"m{i}").alias("matched")) for i, w in enumerate(vocabulary)))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same values; null is an empty list."""
    empty = F.array().cast("array<string>")
    key = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, empty)))
    return key(a) == key(b)


def not_followed(events: DataFrame, opens: Column, closes: Column, keys: list[str], order: str) -> DataFrame:
    """Opening events without a later closing event of the same key. The last closing time per key decides, so the
    inequality needs no pairing of events."""
    closed = events.filter(closes).groupBy(*keys).agg(F.max(order).alias("last_close"))
    return events.filter(opens).join(closed, keys, "left").filter(F.col("last_close").isNull() | (F.col("last_close") <= F.col(order))).drop("last_close")
