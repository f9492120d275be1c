"""Citations, registry lookups and the signals that tell how a printed reference agrees with a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.config import Settings
from tracefold.functions import normalize as N


def citations(claims: DataFrame) -> DataFrame:
    """(ledger_id, claim_id, ref_id, ord): one row per distinct id in a claim, in first-seen order."""
    return (
        claims.select("ledger_id", "claim_id", F.posexplode(F.array_distinct("ref_ids")).alias("ord", "ref_id"))
        .filter(F.col("ref_id").isNotNull())
        .select("ledger_id", "claim_id", "ref_id", "ord")
    )


def citing_claims(claims: DataFrame) -> DataFrame:
    """The inverse: per reference the number of claims that cite it and the first of them. The edges themselves are
    `citations`; no list of unbounded length is built."""
    return citations(claims).groupBy("ledger_id", "ref_id").agg(F.count(F.lit(1)).alias("claims"), F.min("claim_id").alias("first_claim"))


def uncited(refs: DataFrame, claims: DataFrame) -> DataFrame:
    """References that no claim of their ledger cites."""
    cited = citations(claims).select("ledger_id", "ref_id").dropDuplicates()
    return refs.join(cited, ["ledger_id", "ref_id"], "left_anti")


#: Lookup steps in order: rank, branch, provider, key.
STEPS = (
    (1, "arxiv_id", "arxiv", "arxiv"),
    (2, "arxiv_id", "openalex", "doi"),
    (3, "doi", "crossref", "doi"),
    (4, "doi", "openalex", "doi"),
    (5, "title_search", "crossref", "title"),
    (6, "title_search", "openalex", "title"),
)


def registry_keys(sources: DataFrame) -> DataFrame:
    """(provider, kind, key, source_id): of each provider's key the record fetched first, so a key finds one record."""
    kinds = F.array(
        F.struct(F.lit("arxiv").alias("kind"), N.strip_version(F.trim("arxiv_id")).alias("key")),
        F.struct(F.lit("doi").alias("kind"), N.normalise_doi(F.col("doi")).alias("key")),
        F.struct(F.lit("title").alias("kind"), N.normalise_text(F.col("title")).alias("key")),
    )
    return (
        sources.select("provider", "source_id", F.explode(kinds).alias("k"))
        .select("provider", "source_id", "k.kind", "k.key")
        .filter(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("provider", "kind", "key")
        .agg(F.min("source_id").alias("source_id"))
    )


def resolve(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """(row_id, source_id, branch): the waterfall. A reference with an arXiv id, printed or inside its DOI, asks
    arXiv and then OpenAlex by DOI; one with another DOI asks Crossref and then OpenAlex; whatever found nothing asks
    for the exact comparable title. All steps run as one equi-join on (provider, kind, key), and the least rank wins;
    references without a hit keep nulls.
    """
    doi = N.normalise_doi(F.col("doi"))
    arxiv = F.coalesce(N.strip_version(F.trim("arxiv_id")), N.strip_version(N.arxiv_in_doi(F.col("doi"))))
    keyed = refs.select("row_id", arxiv.alias("arxiv"), F.nullif(doi, F.lit("")).alias("doi"), N.normalise_text(F.col("title")).alias("title"))
    by_arxiv = F.col("arxiv").isNotNull()
    allowed = {"arxiv_id": by_arxiv, "doi": ~by_arxiv, "title_search": F.lit(True)}
    steps = F.array(
        *(
            F.struct(
                F.lit(rank).alias("rank"), F.lit(branch).alias("branch"), F.lit(provider).alias("provider"), F.lit(kind).alias("kind"),
                F.when(allowed[branch], F.nullif(F.col(kind), F.lit(""))).alias("key"),
            )
            for rank, branch, provider, kind in STEPS
        )
    )
    asked = keyed.select("row_id", F.explode(F.filter(steps, lambda s: s["key"].isNotNull())).alias("s")).select("row_id", "s.*")
    best = (
        asked.join(registry_keys(sources), ["provider", "kind", "key"])
        .groupBy("row_id")
        .agg(F.min(F.struct("rank", "source_id", "branch")).alias("hit"))
        .select("row_id", "hit.source_id", "hit.branch")
    )
    return refs.select("row_id").join(best, "row_id", "left")


def retracted(sources: DataFrame) -> DataFrame:
    """(source_id, is_retracted): a record counts as retracted if it says so or an OpenAlex record of its DOI does;
    an unknown or missing flag leaves it as it is."""
    keyed = sources.select("source_id", "provider", F.coalesce("is_retracted", F.lit(False)).alias("own"), N.normalise_doi(F.col("doi")).alias("doi"))
    flags = keyed.filter((F.col("provider") == "openalex") & F.col("own") & F.col("doi").isNotNull()).select("doi", F.lit(True).alias("flag")).dropDuplicates()
    return keyed.join(flags, "doi", "left").select("source_id", (F.col("own") | F.coalesce("flag", F.lit(False))).alias("is_retracted"))


def signals(refs: DataFrame, sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """Title similarity, author overlap, year distance and three-valued DOI agreement of each resolved reference."""
    # Comparable values are made once per side, before the join and in projections of their own.
    s = sources.select(
        "source_id",
        N.sorted_words(N.normalise_text(F.col("title"))).alias("s_words"),
        N.surnames(F.col("authors")).alias("s_names"),
        F.col("year").alias("s_year"),
        N.normalise_doi(F.col("doi")).alias("s_doi"),
        "is_preprint",
    )
    r = refs.select(
        "row_id",
        N.sorted_words(N.normalise_text(F.col("title"))).alias("words"),
        N.surnames(F.col("authors")).alias("names"),
        "year",
        N.normalise_doi(F.col("doi")).alias("doi"),
        "arxiv_id",
    )
    joined = r.join(resolved.filter(F.col("source_id").isNotNull()), "row_id").join(s, "source_id")
    return joined.select(
        "row_id",
        "source_id",
        "branch",
        N.sorted_similarity(F.col("words"), F.col("s_words")).alias("title_similarity"),
        N.author_overlap(F.col("names"), F.col("s_names")).alias("author_overlap"),
        N.year_delta(F.col("year"), F.col("s_year")).alias("year_delta"),
        N.doi_match(F.col("doi"), F.col("s_doi")).alias("doi_match"),
        "is_preprint",
        N.looks_like_preprint(F.col("doi"), F.col("arxiv_id")).alias("printed_preprint"),
    )


def divergent_duplicates(refs: DataFrame) -> DataFrame:
    """(row_id, sibling): references of one ledger with the same comparable title and year, null years alike, that
    differ in DOI, arXiv id or set of surnames; the sibling is the first such row. Rows of a title are never paired:
    each title's distinct identities are counted with their first rows, and a row looks at the first two.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    identity = F.sha2(
        F.concat_ws("\x1f", empty(N.normalise_doi(F.col("doi"))), empty(F.trim("arxiv_id")), F.array_join(N.surnames(F.col("authors")), "\x1e")), 256
    )
    keyed = refs.filter(F.col("title").isNotNull() & (F.trim("title") != "")).select(
        "row_id", "ledger_id", N.normalise_text(F.col("title")).alias("title_key"), F.coalesce("year", F.lit(-1)).alias("year_key"), identity.alias("identity")
    )
    group = ["ledger_id", "title_key", "year_key"]
    first_of = keyed.groupBy(*group, "identity").agg(F.min("row_id").alias("first_row"))
    # The least two identities by first row: the least over all, then the least over all others.
    least = first_of.groupBy(*group).agg(F.min(F.struct("first_row", "identity")).alias("one"))
    second = (
        first_of.join(least, group)
        .filter(F.col("identity") != F.col("one.identity"))
        .groupBy(*group)
        .agg(F.first("one").alias("one"), F.min("first_row").alias("two"))
    )
    return keyed.join(second, group).select(
        "row_id", F.when(F.col("identity") == F.col("one.identity"), F.col("two")).otherwise(F.col("one.first_row")).alias("sibling")
    )


def exact_indicators(refs: DataFrame, claims: DataFrame, sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """(row_id, orphan, duplicate_entry, retracted, doi_mismatch): the indicators that need no similarity."""
    flags, told = _flags(refs, claims, sources, resolved)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    told = told.select("row_id", "gone", (F.col("doi_match") == F.lit(False)).alias("other_doi"))
    return flags.join(told, "row_id", "left").select(
        "row_id", yes("orphan").alias("orphan"), yes("twin").alias("duplicate_entry"), yes("gone").alias("retracted"), yes("other_doi").alias("doi_mismatch")
    )


def _flags(refs: DataFrame, claims: DataFrame, sources: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    lone = uncited(refs, claims).select("row_id", F.lit(True).alias("orphan"))
    twins = divergent_duplicates(refs).select("row_id", F.lit(True).alias("twin"))
    gone = retracted(sources).withColumnRenamed("is_retracted", "gone")
    return refs.select("row_id").join(lone, "row_id", "left").join(twins, "row_id", "left"), signals(refs, sources, resolved).join(gone, "source_id")


def indicators(
    refs: DataFrame, claims: DataFrame, sources: DataFrame, resolved: DataFrame, settings: Settings = Settings(), malformed: DataFrame | None = None
) -> DataFrame:
    """(row_id, indicators, notes): malformed, orphan, duplicate_entry, retracted, doi_mismatch, version_mismatch, in
    this order, joined by commas, and in words why. A null signal fires nothing. malformed: (row_id) of the references
    that extraction could not read; a reference without a title isn't one of them by that alone."""
    flags, s = _flags(refs, claims, sources, resolved)
    mixed = F.col("is_preprint").isNotNull() & (F.col("title_similarity") >= settings.title_strong) & (F.col("printed_preprint") != F.col("is_preprint"))
    told = s.select("row_id", "gone", (F.col("doi_match") == F.lit(False)).alias("other_doi"), mixed.alias("mixed"))
    flag = lambda c, name: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(name))
    joined = flags.join(told, "row_id", "left")
    if malformed is None:
        joined = joined.withColumn("unread", F.lit(False))
    else:
        joined = joined.join(malformed.select("row_id", F.lit(True).alias("unread")).dropDuplicates(), "row_id", "left")
    names = [("unread", "malformed"), ("orphan", "orphan"), ("twin", "duplicate_entry"), ("gone", "retracted"), ("other_doi", "doi_mismatch"), ("mixed", "version_mismatch")]
    why = [("unread", "the entry could not be read"), ("orphan", "no citation leads here"), ("twin", "same title and year as another entry, other details"),
           ("gone", "the record is retracted"), ("other_doi", "printed and registered DOI differ"), ("mixed", "preprint against published version")]
    return joined.select("row_id", F.concat_ws(",", *(flag(c, n) for c, n in names)).alias("indicators"), F.concat_ws("; ", *(flag(c, n) for c, n in why)).alias("notes"))


#: Fields that are shown side by side, as printed and as registered.
PANEL = ("title", "authors", "year", "doi", "venue", "arxiv_id")


def panel(refs: DataFrame, sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """(row_id, printed, found, provider, lookup, url): the same fields of a reference and its record, null where one has
    none, and where to look it up: the record's own address, an identifier of either, or a search for the title."""
    shown = lambda: F.struct(*((F.array_join(c, ", ") if c == "authors" else F.col(c).cast("string")).alias(c) for c in PANEL))
    found = sources.select("source_id", "provider", "url", shown().alias("found"))
    printed = refs.select("row_id", shown().alias("printed"))
    j = printed.join(resolved.select("row_id", "source_id"), "row_id").join(found, "source_id", "left")
    doi = N.normalise_doi(F.coalesce(F.nullif(F.col("found.doi"), F.lit("")), F.nullif(F.col("printed.doi"), F.lit(""))))
    arxiv = F.coalesce(F.nullif(F.col("found.arxiv_id"), F.lit("")), F.nullif(F.col("printed.arxiv_id"), F.lit("")))
    title = F.nullif(F.col("printed.title"), F.lit(""))
    ways = [
        ("record", F.nullif(F.col("url"), F.lit(""))), ("doi", F.concat(F.lit("https://doi.org/"), doi)), ("arxiv", F.concat(F.lit("https://arxiv.org/abs/"), arxiv)),
        ("title search", F.concat(F.lit("https://scholar.google.com/scholar?q="), F.url_encode(title))),
    ]
    first = first_match([(u.isNotNull(), F.struct(F.lit(k).alias("lookup"), u.alias("url"))) for k, u in ways], F.lit(None))
    return j.withColumn("way", first).select("row_id", "printed", "found", "provider", "way.lookup", "way.url")


def first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """An ordered decision table as one expression: the value of the first condition that holds; null doesn't hold."""
    out = None
    for when, value in rules:
        out = F.when(when, value) if out is None else out.when(when, value)
    return otherwise if out is None else out.otherwise(otherwise)
