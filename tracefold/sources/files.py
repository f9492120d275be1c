"""Files in and out: ledgers as JSON lines and Parquet, label files, binary documents, fetched replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = (
    "ledger_id long, reference struct<ref_id:string,raw_text:string,title:string,authors:array<string>,year:int,doi:string,arxiv_id:string,venue:string>, "
    "verdict struct<status:string,confidence:double,rationale:string,checks:array<string>,judge_model:string>, priority double"
)
LABEL_SCHEMA = (
    "document string, control boolean, source struct<license:string,origin_url:string,origin_file:string>, labels array<struct<ref_id:string,defect_id:string,"
    "expected_status:string,expected_indicators:array<string>,defect:string,injected:boolean,verified_by:string,verified_on:string>>"
)


def document_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """Name without its last ending."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def ledger_path(name: Column, output: str) -> Column:
    return F.concat(F.lit(output.rstrip("/") + "/"), stem(name), F.lit("_ledger.json"))


def label_stem(name: Column) -> Column:
    """Name under which a document's label file is looked for: a .pdf ending in any case is dropped."""
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def ledger_entries(refs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One nested entry per judged reference; ids agree because they are the join key."""
    v = verdicts.select("ledger_id", "ref_id", F.struct("status", "confidence", "rationale", "checks", "judge_model").alias("verdict"), "priority")
    r = refs.select("ledger_id", "ref_id", F.struct("ref_id", "raw_text", "title", "authors", "year", "doi", "arxiv_id", "venue").alias("reference"))
    return r.join(v, ["ledger_id", "ref_id"]).select("ledger_id", "reference", "verdict", "priority")


#: Folders over which ledgers are spread by hash, whatever their number.
BUCKETS = 64


def write_ledgers(entries: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """JSON lines in folders of ledgers with the same hash, so the number of files follows the tasks and not the
    ledgers. Entries of a large ledger stay spread over many files."""
    entries.withColumn("bucket", F.pmod(F.xxhash64("ledger_id"), F.lit(buckets))).write.partitionBy("bucket").mode("overwrite").json(path)


#: Keys that an entry and its parts may have.
ENTRY_KEYS = {"$": ("ledger_id", "reference", "verdict", "priority"), "$.reference": ("ref_id", "raw_text", "title", "authors", "year", "doi", "arxiv_id", "venue"),
              "$.verdict": ("status", "confidence", "rationale", "checks", "judge_model")}


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a line that isn't JSON or doesn't fit the schema ends the job; so does an unknown key, in an entry or in
    a part of it. Lines are read once."""
    value = F.col("value")
    part = lambda p: value if p == "$" else F.get_json_object(value, p)
    unknown = F.concat(*(F.array_except(F.coalesce(F.json_object_keys(part(p)), F.array().cast("array<string>")), F.array(*map(F.lit, keys))) for p, keys in ENTRY_KEYS.items()))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("a ledger entry has an unknown key: "), F.array_join(unknown, ",")))).otherwise(value)
    lines = spark.read.text(path).select(F.from_json(checked, ENTRY_SCHEMA, {"mode": "FAILFAST"}).alias("e"))
    return lines.select("e.*")


def newest_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """(file, written_at) of the ledger files under a path, the newest first; only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_ledger.json").option("recursiveFileLookup", True).load(path)
    return files.select(document_name(F.col("path")).alias("file"), F.col("modificationTime").alias("written_at")).orderBy(F.desc("written_at"), "file")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One row per label of the label files under a path, with the name its file should have."""
    files = spark.read.schema(LABEL_SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(path)
    named = files.withColumn("file_stem", stem(document_name(F.col("_metadata.file_path"))))
    return named.select("document", "file_stem", "control", F.col("source.license").alias("license"), F.posexplode("labels").alias("pos", "l")).select(
        "document", "file_stem", "control", "license", "pos", "l.*"
    )


def decoded_documents(spark: SparkSession, path: str, decode: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, name, pages, note) of binary files; a page that can't be decoded is '' with a note, by the decoder's
    choice, and a file that can't be opened has no pages and its error as the note."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            pages, notes = [], []
            for content in batch["content"]:
                try:
                    pages.append(decode(bytes(content)))
                    notes.append(None)
                except Exception as e:  # noqa: BLE001 - any decoder's failure is this file's own
                    pages.append([])
                    notes.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": batch["path"], "pages": pages, "note": notes})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, pages array<string>, note string").withColumn("name", document_name(F.col("path")))


def fetched(requests: DataFrame, fetch: Callable[[str], tuple[int, str]], retries: int = 1) -> DataFrame:
    """(cache_key, url, payload, note): fetches each distinct request once, again after an exception or an answer
    that isn't 200 or 404. What fails is a note with a null payload, never an error."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            payloads, notes = [], []
            for url in batch["url"]:
                payload, note = None, None
                for _ in range(retries + 1):
                    try:
                        status, body = fetch(url)
                    except Exception as e:  # noqa: BLE001 - the connector's failure is data
                        note = f"{type(e).__name__}: {e}"
                        continue
                    payload, note = (body, None) if status == 200 else (None, f"status {status}")
                    if status in (200, 404):
                        break
                payloads.append(payload)
                notes.append(note)
            yield batch.assign(payload=payloads, note=notes)

    one = requests.select("cache_key", "url").dropDuplicates(["cache_key"])
    return one.mapInPandas(run, "cache_key string, url string, payload string, note string")
