"""Registry replies as columns. Paths that a reply lacks, or holds in another shape, give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a Crossref work may tell its year, best first.
YEAR_FIELDS = ("issued", "published", "published-print", "published-online", "created")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(v: Column, field: str) -> Column:
    """First element of a list of strings, or the string that stands in its place."""
    whole = _get(v, f'$["{field}"]')
    return F.coalesce(_get(v, f'$["{field}"][0]'), F.when(~F.startswith(whole, F.lit("[")), whole))


def crossref_works(raw: DataFrame) -> DataFrame:
    """(raw_id, item_pos, doi, title, venue, authors, year, is_preprint) of each work of stored replies: the message, or
    each element of its items. An author is given name and family, or the name of a group."""
    v = F.try_parse_json("payload")
    is_object = lambda c: F.schema_of_variant(c).startswith("OBJECT")
    m = raw.select("raw_id", F.try_variant_get(v, "$.message", "variant").alias("m")).filter(is_object("m"))
    listed = _get(F.col("m"), "$.items", "variant")
    each = F.when(listed.isNull(), F.array("m")).otherwise(_get(F.col("m"), "$.items", "array<variant>"))
    works = m.select("raw_id", F.posexplode(each).alias("item_pos", "w")).filter(is_object("w"))
    w = F.col("w")
    kind = _get(w, "$.type")

    def name(a: Column) -> Column:
        family, given, group = (_get(a, f"$.{k}") for k in ("family", "given", "name"))
        return F.when(family.isNotNull(), F.concat_ws(" ", given, family)).otherwise(group)

    people = F.coalesce(_get(w, "$.author", "array<variant>"), F.array().cast("array<variant>"))
    return works.select(
        "raw_id",
        "item_pos",
        _get(w, "$.DOI").alias("doi"),
        _first(w, "title").alias("title"),
        _first(w, "container-title").alias("venue"),
        F.filter(F.transform(people, name), lambda n: n.isNotNull()).alias("authors"),
        F.coalesce(*(_get(w, f'$["{f}"]["date-parts"][0][0]', "int") for f in YEAR_FIELDS)).alias("year"),
        F.when(kind == "posted-content", True).when(kind == "journal-article", False).alias("is_preprint"),
    )


def openalex_work(payload: Column) -> Column:
    """Struct of an OpenAlex reply."""
    v = F.try_parse_json(payload)
    kind, where = _get(v, "$.type"), _get(v, "$.primary_location.source.type")
    return F.struct(
        _get(v, "$.doi").alias("doi"),
        F.coalesce(_get(v, "$.display_name"), _get(v, "$.title")).alias("title"),
        _get(v, "$.primary_location.source.display_name").alias("venue"),
        F.transform(_get(v, "$.authorships", "array<variant>"), lambda a: F.try_variant_get(a, "$.author.display_name", "string")).alias("authors"),
        _get(v, "$.publication_year", "int").alias("year"),
        F.coalesce(_get(v, "$.is_retracted", "boolean"), F.lit(False)).alias("is_retracted"),
        F.when((kind == "preprint") | (where == "repository"), True).when((kind == "article") & (where == "journal"), False).alias("is_preprint"),
    )


def arxiv_entry(body: Column, requested: Column) -> Column:
    """Struct of the first entry of an Atom feed; null for an empty feed, a broken one or an error entry."""
    path = lambda p: f"/*[local-name()='feed']/*[local-name()='entry'][1]/{p}"
    text = lambda n: F.nullif(F.trim(F.regexp_replace(F.xpath_string(body, F.lit(path(f"*[local-name()='{n}']"))), r"\s+", " ")), F.lit(""))
    found = text("id")
    whole = F.struct(
        F.coalesce(F.nullif(F.regexp_extract(found, r"/abs/(\S+)$", 1), F.lit("")), requested).alias("arxiv_id"),
        text("title").alias("title"),
        F.xpath(body, F.lit(path("*[local-name()='author']/*[local-name()='name']/text()"))).alias("authors"),
        F.substring(text("published"), 1, 4).cast("int").alias("year"),
        text("doi").alias("doi"),
        F.lit("arXiv").alias("venue"),
        F.lit(True).alias("is_preprint"),
    )
    return F.when(found.isNotNull() & ~F.startswith(F.coalesce(text("title"), F.lit("Error")), F.lit("Error")), whole)
