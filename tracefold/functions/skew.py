"""Joins of many rows with one row per key, whatever share of the rows one key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with at least one in so many of all rows are spread; so there are at most that many of them.
SHARE = 1000


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, by: str, share: int = SHARE) -> DataFrame:
    """Inner join on the columns `on`, without `n`. keyed has one row per key and in `n` the number of rows it will meet;
    it is read twice: store it first. The rows of the keys that hold at least one in `share` of them are spread by the
    column `by` over all partitions, each of which gets those keys' row; the list of such keys has at most `share`
    entries, so it is broadcast."""
    spark = rows.sparkSession
    total = keyed.agg(F.sum(n)).first()[0] or 0
    lots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(keyed.filter(F.col(n) * share >= total).select(*on, F.lit(lots).alias("lots")))
    a = rows.join(hot, on, "left").withColumn("lot", F.when(F.col("lots").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(lots))).cast("int"))
    b = keyed.withColumn("lot", F.explode(F.sequence(F.lit(0), F.when(F.col(n) * share >= total, lots - 1).otherwise(0))))
    return a.drop("lots").join(b.drop(n), [*on, "lot"]).drop("lot")
