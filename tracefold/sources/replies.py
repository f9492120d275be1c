"""Model replies as columns: JSON out of prose, checked against a closed set of keys and values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracefold.config import STATUSES

REFERENCE_KEYS = ("title", "authors", "year", "doi", "arxiv_id", "venue")


def outermost_json(reply: Column) -> Column:
    """From the first brace to the last, without code fences; null without both."""
    bare = F.regexp_replace(reply, r"(?m)^\s*```\w*\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def _status_object(reply: str) -> str | None:
    """First balanced object outside of strings that has a status, else the first that can be read."""
    import re

    text = re.sub(r"(?s)<think>.*?(?:</think>|$)|```\w*", " ", reply)
    first = None
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
            continue
        if isinstance(value, dict) and "status" in value:
            return text[at:end]
        if first is None and isinstance(value, dict):
            first = text[at:end]
        at = text.find("{", end)
    return first


@F.pandas_udf(StringType())
def status_object(reply: pd.Series) -> pd.Series:
    return reply.map(_status_object, na_action="ignore")


def reference_fields(reply: Column) -> Column:
    """Struct of the six reference fields of a reply, or null if it isn't an object or has other keys. Texts are
    trimmed and empty ones null."""
    body = outermost_json(reply)
    keys = F.json_object_keys(body)
    known = F.size(F.array_except(keys, F.array(*map(F.lit, REFERENCE_KEYS)))) == 0
    s = F.from_json(body, "title string, authors array<string>, year string, doi string, arxiv_id string, venue string")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    fields = F.struct(
        text(s["title"]).alias("title"),
        F.filter(F.transform(s["authors"], text), lambda a: a.isNotNull()).alias("authors"),
        F.nullif(F.regexp_extract(s["year"], r"(?<!\d)(1[5-9]\d\d|2[01]\d\d)(?!\d)", 1), F.lit("")).cast("int").alias("year"),
        text(s["doi"]).alias("doi"),
        text(s["arxiv_id"]).alias("arxiv_id"),
        text(s["venue"]).alias("venue"),
    )
    return F.when(keys.isNotNull() & known, fields)


def verdict_fields(reply: Column, max_checks: int = 3) -> Column:
    """Struct of a judging reply, or null unless the status is known and the rationale isn't empty. Confidence is
    kept within 0 and 1, checks are trimmed and the first few kept."""
    s = F.from_json(status_object(reply), "status string, confidence double, rationale string, checks array<string>")
    status, why = F.lower(F.trim(s["status"])), F.trim(s["rationale"])
    checks = F.filter(F.transform(F.coalesce(s["checks"], F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")
    good = status.isin(*STATUSES) & (F.length(why) > 0)
    return F.when(
        good,
        F.struct(
            status.alias("status"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["confidence"])).alias("confidence"),
            why.alias("rationale"),
            F.slice(checks, 1, max_checks).alias("checks"),
        ),
    )
