"""Progress logs in Markdown: blocks of "## clock — module STATUS" with key: value lines, one file per person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.operators import state
from tracefold.operators.segment import numbered_lines

# The status words, and what may part a clock from the rest.
STATUS_WORDS = ("READY", "STARTED", "MERGED", "BLOCKED", "AHEAD", "REQUEST", "OBJECTION", "SCOPE-CUT")
DASHES = ("—", "–", "-", "--")
ARROWS = ("->", "→")
UNKNOWN_CLOCK = 1_000_000


def clock_minutes(clock: Column) -> Column:
    """2:40 is 160; what isn't a clock sorts last."""
    parts = F.split(clock, ":")
    hours, minutes = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2))
    good = (F.size(parts) == 2) & (F.length(parts[1]) == 2) & (hours >= 0) & (minutes >= 0)
    return F.when(good, hours * 60 + minutes).otherwise(F.lit(UNKNOWN_CLOCK))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(person, text) of the Markdown files under a path; names that begin with "_" and README are none."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.md$", "")
    return files.select(name.alias("person"), F.col("value").alias("text")).filter(~F.startswith("person", F.lit("_")) & (F.upper("person") != "README"))


def _heading(line: Column) -> Column:
    """Struct of a block's heading, null for other lines. A request names no module of its own, so that is its module;
    a status word alone, or another last word, gives no status."""
    words = F.split(F.rtrim(line), r"\s+")
    rest = F.slice(words, 4, F.size(words))
    arrow = F.try_element_at(rest, F.lit(2)).isin(*ARROWS) & (F.upper(F.try_element_at(rest, F.lit(1))) == "REQUEST") & (F.size(rest) == 3)
    last = F.upper(F.try_element_at(rest, F.lit(-1)))
    known = last.isin(*STATUS_WORDS) & (F.size(rest) > 1)
    asked = F.coalesce(arrow, F.lit(False))
    told = F.struct(
        words[1].alias("clock"),
        F.when(asked, F.lit("REQUEST")).when(known, F.array_join(F.slice(rest, 1, F.size(rest) - 1), " ")).otherwise(F.array_join(rest, " ")).alias("module"),
        F.when(asked, F.lit("REQUEST")).when(known, last).alias("status"),
        F.when(asked, F.ltrim(F.try_element_at(rest, F.lit(3)), F.lit("@"))).alias("owner"),
    )
    return F.when((F.size(words) > 3) & (words[0] == "##") & words[2].isin(*DASHES), told)


def _field(line: Column) -> Column:
    """Struct (k, v) of a "key: value" line; keys begin with a letter and hold letters, digits, blanks, "_" and "-"."""
    key = F.split_part(line, F.lit(":"), F.lit(1))
    value = F.trim(F.substr(line, F.length(key) + 2))
    return F.when(F.contains(line, F.lit(":")) & key.rlike(r"^[A-Za-z][\w -]*$"), F.struct(F.trim(key).alias("k"), value.alias("v")))


def blocks(logs: DataFrame) -> DataFrame:
    """(person, lineno, clock, minutes, module, status, owner, fields): one row per block. Fenced text is skipped, and
    any other heading ends a block."""
    per_line = Window.partitionBy("person").orderBy("line_no")  # a log is one person's file
    n = numbered_lines(logs, "person").withColumn("fence", F.ltrim("line").startswith("```") | F.ltrim("line").startswith("~~~"))
    n = n.withColumn("inside", (F.sum(F.col("fence").cast("int")).over(per_line) % 2 == 1) | F.col("fence"))
    n = n.filter(~F.col("inside")).withColumns({"head": _heading(F.col("line")), "sharp": F.startswith("line", F.lit("#"))})
    n = n.withColumn("block", F.sum(F.col("sharp").cast("int")).over(per_line))
    field = F.when(~F.col("sharp"), _field(F.col("line")))
    found = n.withColumn("f", F.when(field.isNotNull(), F.struct("line_no", field.alias("f")))).groupBy("person", "block").agg(
        F.min(F.when(F.col("head").isNotNull(), F.col("line_no"))).alias("lineno"),
        F.max_by("head", F.col("head").isNotNull()).alias("head"),
        F.array_sort(F.collect_list("f")).alias("f"),  # the fields of one block of a person's file
    )
    return found.filter(F.col("head").isNotNull()).select(
        "person", "lineno", "head.clock", clock_minutes(F.col("head.clock")).alias("minutes"), "head.module", "head.status", "head.owner",
        F.transform("f", lambda x: x["f"]).alias("fields"),
    )


def latest_per_person(parsed: DataFrame) -> DataFrame:
    return state.latest(parsed.filter(F.col("status").isNotNull()).drop("fields"), ["person"], ["lineno"])


def open_items(parsed: DataFrame) -> DataFrame:
    """Requests and blocks that no later merge of the same person and module retires, oldest clock first."""
    key = F.lower("module")
    merged = parsed.filter(F.col("status") == "MERGED").groupBy("person", key.alias("m")).agg(F.max("lineno").alias("merged_at"))
    asked = parsed.filter(F.col("status").isin("REQUEST", "BLOCKED")).withColumn("m", key).join(merged, ["person", "m"], "left")
    still = asked.filter(F.col("merged_at").isNull() | (F.col("merged_at") <= F.col("lineno")))
    return still.select("person", "lineno", "clock", "minutes", "module", "status", "owner").orderBy("minutes", "person", "lineno")
