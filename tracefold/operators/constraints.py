"""Integrity constraints: each gives its violations as rows; strict mode ends the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.config import INDICATORS, STATUSES


def _outside(c: str, low: float, high: float) -> Column:
    return ~F.coalesce(F.col(c).between(low, high), F.lit(True))


def verdict_rules(max_checks: int = 3) -> dict[str, Column]:
    """Name of each rule and the condition under which a row breaks it. Unknown values break no bound."""
    return {
        "confidence_bounds": _outside("confidence", 0, 1),
        "priority_bounds": _outside("priority", 0, 1),
        "rationale_empty": F.coalesce(F.length("rationale") < 1, F.lit(True)),
        "too_many_checks": F.coalesce(F.size("checks") > max_checks, F.lit(False)),
        "unknown_status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "unknown_indicator": F.coalesce(F.size(F.array_except("indicators", F.array(*map(F.lit, INDICATORS)))) > 0, F.lit(False)),
        "no_reference": F.col("ref_id").isNull() | F.col("ledger_id").isNull(),
    }


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): one row per broken rule, in one pass."""
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda r: r.isNotNull())
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def unflagged_retractions(entries: DataFrame, key: str) -> DataFrame:
    """Keys of entries whose record is retracted and whose indicators don't say so."""
    said = F.coalesce(F.array_contains("indicators", "retracted"), F.lit(False))
    return entries.filter(F.coalesce("is_retracted", F.lit(False)) & ~said).select(key)


def misaligned(entries: DataFrame, key: list[str], parts: list[str]) -> DataFrame:
    """Entries whose parts, such as reference and verdict, name different ids; a missing part differs from any id."""
    same = F.lit(True)
    for p in parts[1:]:
        same = same & F.col(parts[0]).eqNullSafe(F.col(p))
    return entries.filter(~same).select(*key, *parts)


def dropped(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(first key, entries, kept, complete): per group how many distinct entries there were and how many came out; a
    step may add nothing and leave out nothing."""
    group, *rest = keys
    a = before.select(*keys).dropDuplicates().withColumn("b", F.lit(1))
    both = a.join(after.select(*keys).dropDuplicates().withColumn("a", F.lit(1)), keys, "full_outer")
    counted = both.groupBy(group).agg(F.count("b").alias("entries"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"), F.count_if(F.col("b").isNull()).alias("added"))
    return counted.select(group, "entries", "kept", ((F.col("kept") == F.col("entries")) & (F.col("added") == 0)).alias("complete"))


def strict(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The same rows; the job fails at the first row that breaks a rule."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return df.withColumn("_broken", broken).filter(F.when(F.size("_broken") > 0, F.raise_error(F.concat(F.lit("broken: "), F.array_join("_broken", ",")))).otherwise(F.lit(True))).drop("_broken")


def banned_terms(df: DataFrame, key: str, texts: list[Column], terms: tuple[str, ...]) -> DataFrame:
    """(key, term): terms found in any of the texts, as substrings in any case."""
    joined = F.lower(F.concat_ws("\n", *texts))
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(joined, F.lower(t)))
    return df.select(F.col(key), F.explode(found).alias("term"))


#: Licences under which a labelled document may be kept.
LICENCES = ("CC-BY", "CC-BY-SA", "CC0", "PMC-OA", "arXiv-perpetual")


def label_violations(labels: DataFrame, licences: tuple[str, ...] = LICENCES) -> DataFrame:
    """(document, ref_id, rule) of golden labels, as `files.read_labels` gives them: each label by itself, each
    document's ids in turn, and defect ids over the whole corpus."""
    number = F.nullif(F.regexp_extract("ref_id", r"^R0*(\d{1,9})$", 1), F.lit("")).cast("int")
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    injected = F.coalesce("injected", F.lit(False))
    rules = {
        "file_name": F.col("file_stem") != F.regexp_replace("document", r"(?i)\.pdf$", ""),
        "no_control_flag": F.col("control").isNull(),
        "unknown_licence": ~F.coalesce(F.col("license").isin(*licences), F.lit(False)),
        "id_out_of_turn": F.coalesce(number != F.col("pos") + 1, F.lit(True)),
        "unknown_status": ~F.coalesce(F.col("expected_status").isin(*STATUSES), F.lit(False)),
        "unknown_indicator": F.coalesce(F.size(F.array_except("expected_indicators", F.array(*map(F.lit, INDICATORS)))) > 0, F.lit(False)),
        "injected_without_defect": injected & ~(some("defect_id") & some("defect")),
        "defect_without_injection": ~injected & (some("defect_id") | some("defect")),
        "half_verified": some("verified_by") != some("verified_on"),
        "bad_date": some("verified_on") & F.try_to_timestamp(F.col("verified_on"), F.lit("yyyy-MM-dd")).isNull(),
        "injected_in_control": F.coalesce(F.col("control"), F.lit(False)) & injected,
    }
    keyed = labels.withColumn("key", F.struct("document", "ref_id"))
    own = violations(keyed, "key", rules)
    twice = repeated_keys(labels, ["document", "ref_id"]).select(F.struct("document", "ref_id").alias("key"), F.lit("repeated_id").alias("rule"))
    spread = labels.filter(some("defect_id")).groupBy("defect_id").agg(F.countDistinct("document").alias("documents"), F.min(F.struct("document", "ref_id")).alias("key"))
    shared = spread.filter(F.col("documents") > 1).select("key", F.lit("defect_in_several_documents").alias("rule"))
    return own.unionByName(twice).unionByName(shared).select("key.document", "key.ref_id", "rule")
