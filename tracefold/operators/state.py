"""Current rows of append-only tables: last write wins, deletions, and a response cache with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The last row per key by the order columns, nulls first, with `columns` (all of them by default): ask only for
    what is needed, as nothing else is read or shuffled. A running maximum, so a key of any size costs each map task one
    row; there is no window over the group.

    With the order columns alone, a time and an id, the maximum is one number of fixed width and the aggregate hashes.
    """
    rest = [c for c in df.columns if c not in keys and c not in order] if columns is None else [c for c in columns if c not in keys and c not in order]
    if not rest and [df.schema[c].dataType.typeName() for c in order] == ["timestamp", "long"]:
        return _newest(df, keys, *order)
    newest = F.max_by(F.struct(*order, *rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in [*order, *rest]))


def _newest(df: DataFrame, keys: list[str], time: str, row: str) -> DataFrame:
    """(keys, time, row) of the last row per key: microseconds and id as digits of one decimal."""
    wide = "decimal(38,0)"
    step, none = F.lit(1 << 64).cast(wide), F.lit(-(1 << 62)).cast("long")
    digits = lambda c, low: F.coalesce(c, low).cast("decimal(19,0)")
    rank = (digits(F.unix_micros(time), none).cast(wide) * step + digits(F.col(row), F.lit(-(1 << 63)).cast("long"))).cast(wide)
    # The id is what is left of the nearest whole step, as it lies within half of one.
    last = df.select(*keys, rank.alias("rank")).groupBy(*keys).agg(F.max("rank").alias("rank"))
    micros = F.floor(((F.col("rank") + F.lit(1 << 63).cast(wide)) / step)).cast("long")
    left = (F.col("rank") - micros.cast(wide) * step).cast("long")
    return last.select(*keys, F.when(micros != none, F.timestamp_micros(micros)).alias(time), left.alias(row))


def usable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def current_references(refs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Of each (ledger, reference) the usable row that arrived last."""
    return latest(usable(refs), ["ledger_id", "ref_id"], ["arrived_at", "row_id"], columns)


def current_claims(claims: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return latest(usable(claims), ["ledger_id", "claim_id"], ["arrived_at", "row_id"], columns)


def current_verdicts(verdicts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return latest(verdicts, ["ledger_id", "ref_id"], ["judged_at", "verdict_id"], columns)


def is_json_object(payload: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(payload)), F.lit("OBJECT")), F.lit(False))


def cache_get(responses: DataFrame, now: Column, ttl_hours: float, payload: bool = False) -> DataFrame:
    """(cache_key, raw_id, fetched_at): the last stored reply per key if it is a JSON object and not strictly older than
    the time to live. Older rows stay stored, so a longer time to live finds them again at once. Payloads are looked at
    where they are read and stay there, unless asked for."""
    seen = responses.select("cache_key", "raw_id", "fetched_at", is_json_object(F.col("payload")).alias("good"), *(["payload"] if payload else []))
    last = latest(seen, ["cache_key"], ["fetched_at", "raw_id"], ["good", *(["payload"] if payload else [])])
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 3.6e9
    return last.filter((age <= ttl_hours) & F.col("good")).drop("good")


def cache_misses(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """Distinct wanted keys without a fresh reply: what one batch has to fetch."""
    return wanted.select("cache_key").dropDuplicates().join(hits.select("cache_key"), "cache_key", "left_anti")


def compacted(responses: DataFrame) -> DataFrame:
    """One row per key with its number of stored replies."""
    return responses.groupBy("cache_key").agg(
        F.count(F.lit(1)).alias("stored"), F.max("fetched_at").alias("fetched_at"), F.max_by("raw_id", F.struct("fetched_at", "raw_id")).alias("raw_id")
    )
