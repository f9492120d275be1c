"""Identifiers, titles and names in comparable form, and how far two of them agree.

Everything is a Column of built-in functions but for Arrow functions: Unicode decomposition, which only sees
values that aren't plain ASCII, and the Gestalt ratio, which only sees pairs that aren't equal or empty.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

ARXIV_DOI = r"(?i)10\.48550/arxiv\.(\S+)"


def normalise_doi(doi: Column) -> Column:
    """Without resolver, label and trailing punctuation, in lower case; null stays null."""
    bare = F.regexp_replace(F.trim(doi), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", "")
    return F.regexp_replace(F.lower(F.trim(bare)), r"[\s;:,.]+$", "")


def _decompose(text: str) -> str:
    t = unicodedata.normalize("NFKD", text)
    return " ".join(re.findall("[a-z0-9]+", "".join([c for c in t if not unicodedata.combining(c)]).casefold()))


@F.pandas_udf(StringType())
def _decomposed(column: pd.Series) -> pd.Series:
    return column.map(_decompose, na_action="ignore")


def normalise_text(text: Column) -> Column:
    """Words of a-z and 0-9 after compatibility decomposition and case folding, joined by one blank; null gives ''."""
    text = F.coalesce(text, F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, plain).otherwise(_decomposed(F.when(~ascii_only, text)))


def sorted_words(normal: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normal, " ")), " ")


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def title_similarity(printed: Column, found: Column) -> Column:
    """Gestalt ratio of the sorted words of two normalised titles, printed one first, to 4 places; 0 if one is
    empty. Equal ones are 1 without leaving the JVM. The ratio isn't symmetric."""
    return sorted_similarity(sorted_words(printed), sorted_words(found))


def sorted_similarity(a: Column, b: Column) -> Column:
    """The same for words that are sorted already."""
    some = (a != "") & (b != "")
    asked = some & (a != b)
    ratio = _ratio(F.when(asked, a), F.when(asked, b))
    return F.when(~some, 0.0).when(a == b, 1.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)), 4))


@F.pandas_udf(ArrayType(StringType()))
def _decomposed_each(column: pd.Series) -> pd.Series:
    return column.map(lambda names: [_decompose(n) for n in names], na_action="ignore")


def _comparable_each(names: Column) -> Column:
    """normalise_text of every element; arrays of plain ASCII don't leave the JVM."""
    plain = F.transform(names, lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")))
    ascii_only = F.array_join(names, " ").rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, plain).otherwise(_decomposed_each(F.when(~ascii_only, names)))


def surnames(authors: Column) -> Column:
    """Distinct comparable surnames of a list, sorted. Of "Family, Given" the last comparable word before the comma; of
    several words the last comparable one of the last word, or the word before it whole if the last is up to three
    capitals, which are initials; a single word whole. Null and empty names are left out, a null list is empty."""
    # Each step binds its result for the next: a lambda would else evaluate the words once per use.
    clean = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")
    worded = F.transform(clean, lambda c: F.struct(c.alias("c"), F.split(c, r"\s+").alias("w")))
    told = F.transform(
        worded, lambda x: F.struct(x["c"].alias("c"), x["w"].alias("w"), F.contains(x["c"], F.lit(",")).alias("comma"), F.regexp_replace(F.element_at(x["w"], -1), r"\.+$", "").alias("tail"))
    )
    initials = lambda x: x["tail"].rlike(r"^\p{Lu}{1,3}$")
    chosen = F.transform(
        told, lambda x: F.when(x["comma"], F.split_part(x["c"], F.lit(","), F.lit(1))).when(F.size(x["w"]) == 1, x["c"]).when(initials(x), F.try_element_at(x["w"], F.lit(-2))).otherwise(x["tail"])
    )
    last = F.transform(told, lambda x: x["comma"] | ((F.size(x["w"]) > 1) & ~initials(x)))
    keys = F.zip_with(_comparable_each(chosen), last, lambda k, one: F.when(one, F.element_at(F.split(k, " "), -1)).otherwise(k))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


def author_overlap(a: Column, b: Column) -> Column:
    """Jaccard index of two surname lists, to 4 places; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(both / F.size(F.array_union(a, b)), 4))


def year_delta(a: Column, b: Column) -> Column:
    """Null if either is unknown."""
    return F.abs(a - b)


def doi_match(a: Column, b: Column) -> Column:
    """Three-valued: null if either is missing. Punctuation doesn't count."""
    some = F.nullif(a, F.lit("")).isNotNull() & F.nullif(b, F.lit("")).isNotNull()
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.when(some, key(a) == key(b))


def coerce_year(text: Column) -> Column:
    """First number from 1500 to 2199 that stands alone; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(1[5-9]\d\d|2[01]\d\d)(?!\d)", 1), F.lit("")).cast("int")


def arxiv_in_doi(doi: Column) -> Column:
    return F.nullif(F.regexp_extract(doi, ARXIV_DOI, 1), F.lit(""))


def strip_version(arxiv_id: Column) -> Column:
    return F.regexp_replace(arxiv_id, r"(?i)v\d+$", "")


def looks_like_preprint(doi: Column, arxiv_id: Column) -> Column:
    return F.coalesce(arxiv_id.isNotNull(), F.lit(False)) | F.coalesce(F.startswith(doi, F.lit("10.48550/")), F.lit(False))


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


def squash(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def is_printed(identifier: Column, entry: Column) -> Column:
    """Whether an identifier stands in the printed entry, whatever its prefix, spacing, case and version."""
    bare = F.regexp_replace(squash(identifier), r"^(https?://|(dx\.)?doi\.org/|www\.|arxiv\.org/(abs|pdf)/|doi:|arxiv:|urn:)+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[./,;:]+", ""), r"[./,;:]+$", "")
    within = squash(F.coalesce(entry, F.lit("")))
    return (bare != "") & (F.contains(within, bare) | F.contains(within, F.regexp_replace(bare, r"v\d+$", "")))


def printed_or_null(identifier: Column, entry: Column) -> Column:
    """An identifier if it stands in the printed entry, else null: what no one can point to on the page was made up."""
    return F.when(is_printed(identifier, entry), identifier)


def request_key(url: Column, params: Column, schema_version: int) -> Column:
    """SHA-256 of the request with its parameters in order of name; the version is a part of the key."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(params)))
    return F.sha2(F.to_json(F.struct(ordered.alias("params"), F.lit(schema_version).alias("schema_version"), url.alias("url"))), 256)


def extraction_key(entry: Column, model: Column, temperature: Column, prompt_version: int, schema_version: int) -> Column:
    """SHA-256 of everything that can change a model's reply to a printed entry."""
    parts = (entry, model, F.format_string("%.3f", temperature), F.lit(str(prompt_version)), F.lit(str(schema_version)))
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("\x00")) for c in parts)), 256)


def doi_in_text(text: Column) -> Column:
    """First DOI printed in a text, without the marks that follow it; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"<>,;]+)", 1), r"[.):\]]+$", ""), F.lit(""))


def arxiv_in_text(text: Column) -> Column:
    """First labelled arXiv id in a text; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?i)arxiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?)", 1), F.lit(""))


def plain_similarity(a: Column, b: Column) -> Column:
    """Gestalt ratio of two normalised texts as they stand, words unsorted; 0 if one is empty."""
    return sorted_similarity(a, b)
