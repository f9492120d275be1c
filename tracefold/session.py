"""Session, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app: str = "tracefold", cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings the session."""
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session. Where none is set, a session of one machine gets a temporary folder, as
    in tests; a cluster's is refused, as its executors share no such folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tracefold-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files when they end; without it, those stay until the driver happens to
    collect its garbage. Frames made inside are to be run once."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lineage cut that survives lost executors and
    keeps column pruning and filter pushdown for its readers."""
    return written_in_lots([df], name)


def written_in_lots(lots: Iterable[DataFrame], name: str, by: str | None = None) -> DataFrame:
    """Writes frames of one schema, at least one, one after the other into a single table, so that disk holds the shuffle
    files of one of them only. `by`: a whole number by which the table is stored, so that each `part` may go by itself."""
    path = schema = None
    for df in lots:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with shuffles_freed(spark):
            df.write.mode("append").parquet(path, partitionBy=by)
    table = spark.read.schema(schema).parquet(path)
    table.scratch = path
    return table


def part(table: DataFrame, by: str, value: int) -> DataFrame:
    """The rows of a table stored by `by` that have this value there."""
    spark, path = table.sparkSession, f"{table.scratch}/{by}={value}"
    columns = StructType([f for f in table.schema.fields if f.name != by])
    there = _files(table, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    rows = spark.read.schema(columns).parquet(path) if there else spark.createDataFrame([], columns)
    rows.scratch = path
    return rows


def _files(table: DataFrame, path: str):
    spark = table.sparkSession
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, or parts of them, that nothing reads any more."""
    for t in tables:
        _files(t, t.scratch).delete(t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch), True)
