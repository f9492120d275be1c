"""Arriving rows as a stream: repeated deliveries dropped, arrivals counted per window, key states kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import orphans
from tracefold.session import ensure_checkpoint_dir


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, one Parquet file or a folder of them, as a stream of its files."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(batch.schema)
    if all(f.rstrip("/").endswith(f"/{name}.parquet") for f in batch.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def first_deliveries(stream: DataFrame, keys: list[str], at: str, delay: str = "60 days") -> DataFrame:
    """Rows whose key wasn't delivered before within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def arrivals_per_window(stream: DataFrame, at: str, window: str = "7 days", delay: str = "60 days") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count("deleted_at").alias("deleted"))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Writes all that is available to the shared folder, with the stream's own checkpoint, and reads it back."""
    spark = stream.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").option("path", f"{at}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def in_slices(changes: DataFrame, at: str, slices: int, name: str) -> str:
    """Writes changes to a folder of the shared folder in the order of time `at`, one slice after the other, as a feed
    would deliver them; changes without a time come first."""
    folder = f"{ensure_checkpoint_dir(changes.sparkSession)}/{name}-{uuid.uuid4().hex}"
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    low, high = changes.agg(F.min(second), F.max(second)).first()
    low, high = low or 0, (high or 0) + 1
    place = F.coalesce(F.floor((second - low) * slices / (high - low)), F.lit(0))
    for k in range(slices):
        changes.filter(place == k).write.mode("append").parquet(folder)
    return folder


def run_fold(deltas: DataFrame) -> DataFrame:
    """Folds all available deltas batch by batch and gives the sums after the last one."""
    spark = deltas.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/orphan-state-{uuid.uuid4().hex}"
    query = deltas.writeStream.foreachBatch(fold_into(f"{at}/state")).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # nothing has arrived
        return spark.createDataFrame([], orphans.fold_deltas(deltas).schema)
    return folded_state(spark, f"{at}/state")


def fold_into(state_path: str):
    """A foreachBatch function that adds the sums of a batch's deltas to the stored state. A batch writes the keys it
    changes, in a folder of its own, so one that is run again leaves the same state, and none rewrites what others
    wrote; the state is the sum of all folders."""

    def run(batch: DataFrame, epoch: int) -> None:
        orphans.fold_deltas(batch).write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")

    return run


def folded_state(spark: SparkSession, state_path: str) -> DataFrame:
    return orphans.fold_deltas(spark.read.parquet(state_path).drop("epoch"))
