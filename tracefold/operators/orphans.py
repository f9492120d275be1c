"""References to records that do not exist: signed counts per key from change deltas.

Every delivered row is a change: it adds one to the existence of its own key and one reference to each distinct id it
names; a deletion takes both back by deltas of minus one. Deltas are summed per (table, ledger, key) and arrival, with
a partial sum before the shuffle, so one hot key costs each map task one record per arrival, and earliest arrivals can
be taken back as well. Keys with positive references and zero existence are the current orphans; keys that exist, yet
whose first usable row arrived after the first naming row, are the late candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.skew import spread_join
from tracefold.session import written

KEYS = ["source_table", "ledger_id", "target_key"]
COUNTS = ["refs", "inserted", "existing"]


def _named_ids(df: DataFrame, table: str, ids: str, *more: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("source_table"), "row_id", "ledger_id", F.col("arrived_at").alias("named_at"), *more,
        F.explode(F.array_distinct(F.col(ids))).alias("target_key"),
    ).filter(F.col("target_key").isNotNull())


def naming_rows(df: DataFrame, table: str, ids: str) -> DataFrame:
    """One row per usable row and distinct non-null id it names. A null or empty array names nothing."""
    return _named_ids(df.filter(F.col("deleted_at").isNull()), table, ids)


def _changes() -> Column:
    """Of each row its insertion and, if it was deleted, its deletion: sign and time."""
    change = lambda sign, at: F.struct(F.lit(sign).cast("long").alias("sign"), at.alias("happened_at"))
    inserted, deleted = change(1, F.col("arrived_at")), change(-1, F.col("deleted_at"))
    return F.explode(F.when(F.col("deleted_at").isNull(), F.array(inserted)).otherwise(F.array(inserted, deleted))).alias("change")


def existence_deltas(df: DataFrame, key: str, named_by: str) -> DataFrame:
    """One delta per change of a row with that key. An unknown arrival can't be shown to be late, so it counts as the
    earliest. `inserted` counts deliveries and is never taken back."""
    return df.filter(F.col(key).isNotNull()).select("ledger_id", key, "arrived_at", "deleted_at", _changes()).select(
        F.lit(named_by).alias("source_table"), "ledger_id", F.col(key).alias("target_key"),
        F.coalesce(F.col("arrived_at"), F.lit("0001-01-01").cast("timestamp")).alias("arrived_at"), F.col("change.happened_at").alias("happened_at"),
        F.lit(0).cast("long").alias("refs"), F.greatest(F.col("change.sign"), F.lit(0).cast("long")).alias("inserted"), F.col("change.sign").alias("existing"),
    )


def reference_deltas(df: DataFrame, table: str, ids: str) -> DataFrame:
    """One delta per change of a row and distinct non-null id it names."""
    zero = F.lit(0).cast("long")
    return _named_ids(df.select("row_id", "ledger_id", "arrived_at", ids, _changes()), table, ids, "change").select(
        *KEYS, F.col("named_at").alias("arrived_at"), F.col("change.happened_at").alias("happened_at"),
        F.col("change.sign").alias("refs"), zero.alias("inserted"), zero.alias("existing"),
    )


def change_deltas(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """The deltas of all changes of both tables."""
    return (
        reference_deltas(claims, "ledger_claims", "ref_ids")
        .unionByName(reference_deltas(refs, "bib_refs", "cited_by_claims"))
        .unionByName(existence_deltas(refs, "ref_id", "ledger_claims"))
        .unionByName(existence_deltas(claims, "claim_id", "bib_refs"))
    )


def fold_deltas(deltas: DataFrame) -> DataFrame:
    """Sums deltas, or sums folded before with new deltas: the operator is its own incremental form."""
    return deltas.groupBy(*KEYS, "arrived_at").agg(*(F.sum(c).alias(c) for c in COUNTS))


def key_state(folded: DataFrame) -> DataFrame:
    """The counts of every key and the earliest arrivals that count: of a row that names it and of a usable row."""
    first = lambda count: F.min(F.when(F.col(count) > 0, F.col("arrived_at")))
    return folded.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in COUNTS), first("refs").alias("named_at"), first("existing").alias("usable_at"))


def open_keys(state: DataFrame) -> DataFrame:
    """Keys with at least one case: no usable row, or one that arrived after a row that names it."""
    return state.filter(
        (F.col("refs") > 0) & ((F.col("existing") == 0) | (F.col("usable_at") > F.col("named_at")))
    )


def _kind() -> Column:
    return (
        F.when(F.col("inserted") == 0, "missing")
        .when(F.col("existing") == 0, "deleted")
        .when(F.col("usable_at") > F.col("named_at"), "late")
    )


def orphan_references(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per usable row and distinct id it names that leads to no usable record of its ledger.

    Ids are exact strings, the empty string among them; null ids and null arrays name nothing. Null ledgers
    match each other. A null arrival of a naming row makes `late` impossible and `period` null; a null arrival
    of a usable target counts as earliest. Empty tables give no rows. Only the named columns are read, so
    extra columns don't matter.
    """
    key = F.xxhash64("source_table", F.col("ledger_id").isNull(), "ledger_id", "target_key").alias("key")
    keys = open_keys(key_state(fold_deltas(change_deltas(claims, refs))))
    keys = written(keys.select(key, *(F.col(c).alias(f"k_{c}") for c in KEYS), "refs", "inserted", "existing", "usable_at"), "open-keys")
    naming = naming_rows(claims, "ledger_claims", "ref_ids").unionByName(naming_rows(refs, "bib_refs", "cited_by_claims"))
    found = spread_join(naming.select(key, "*"), keys, ["key"], "refs", "row_id")
    same = [F.col(f"k_{c}").eqNullSafe(F.col(c)) for c in KEYS]  # the join is on the keys' hash
    return (
        found.filter(same[0] & same[1] & same[2])
        .select("source_table", "row_id", "target_key", _kind().alias("kind"), F.date_format("named_at", "yyyy-MM").alias("period"))
        .filter(F.col("kind").isNotNull())
    )


def orphan_report(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """Cases per table, month and kind."""
    return (
        orphan_references(claims, refs)
        .groupBy("source_table", "period", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )
