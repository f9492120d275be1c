"""Registered queries over ledgers, references, claims, verdicts and registry records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.config import INDICATORS, STATUSES, Settings
from tracefold.functions import normalize as N
from tracefold.operators import constraints, counts, linkage, state
from tracefold.session import table, written
from tracefold.sources import files, payloads, replies

SETTINGS = Settings()
#: Length of each ledger's reviewer worklist.
TOP = 5

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL pieces: the same definitions in the other engine --------------------------------------------------

_LAST = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {o}) = 1"
_CURRENT = f"""
cur AS (SELECT * FROM bib_refs WHERE deleted_at IS NULL {_LAST.format(k='ledger_id, ref_id', o='arrived_at DESC, row_id DESC')}),
cla AS (SELECT * FROM ledger_claims WHERE deleted_at IS NULL {_LAST.format(k='ledger_id, claim_id', o='arrived_at DESC, row_id DESC')}),
ver AS (SELECT * FROM verdicts {_LAST.format(k='ledger_id, ref_id', o='judged_at DESC, verdict_id DESC')}),
cit AS (SELECT DISTINCT ledger_id, claim_id, ref_id FROM (SELECT ledger_id, claim_id, unnest(ref_ids) AS ref_id FROM cla) WHERE ref_id IS NOT NULL)
"""


def _doi(c: str) -> str:
    return f"regexp_replace(lower(trim(regexp_replace(trim({c}), '^(https?://(dx\\.)?doi\\.org/|doi:)', '', 'i'))), '[\\s;:,.]+$', '')"


def _text(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def _surnames(c: str) -> str:
    """Last comparable word before a comma or of the last word; all of a single word, and of the one before initials."""
    words = "regexp_split_to_array(trim(a), '\\s+')"
    tail = f"regexp_replace({words}[-1], '\\.+$', '')"
    initials = f"regexp_full_match({tail}, '\\p{{Lu}}{{1,3}}')"
    last = lambda x: f"string_split({_text(x)}, ' ')[-1]"
    comma = "split_part(trim(a), ',', 1)"
    key = f"CASE WHEN contains(a, ',') THEN {last(comma)} WHEN len({words}) = 1 THEN {_text('a')} WHEN {initials} THEN {_text(words + '[-2]')} ELSE {last(tail)} END"
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda a: {key}), lambda k: k IS NOT NULL AND k <> '')))"


# ---- State and cache ---------------------------------------------------------------------------------------


@query(f"WITH {_CURRENT} SELECT ledger_id, ref_id, row_id, arrived_at FROM cur")
def c00_current_references(spark: SparkSession, d: str) -> DataFrame:
    return state.current_references(table(spark, d, "bib_refs"), [])


@query("""
WITH last AS (SELECT * FROM crossref_raw QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY fetched_at DESC NULLS LAST, raw_id DESC) = 1),
now AS (SELECT max(fetched_at) AS t FROM crossref_raw)
SELECT cache_key, raw_id, fetched_at FROM last, now
WHERE fetched_at >= t - INTERVAL 30 DAY AND payload IS NOT NULL AND json_valid(payload) AND ltrim(payload, E' \\n\\t\\r') LIKE '{%'
""")
def c01_cache_get(spark: SparkSession, d: str) -> DataFrame:
    """Replies not older than 30 days before the last fetch."""
    raw = table(spark, d, "crossref_raw")
    now = raw.agg(F.max("fetched_at")).first()[0]
    return state.cache_get(raw, F.lit(now), 30 * 24.0).select("cache_key", "raw_id", "fetched_at")


@query("""
SELECT cache_key, count(*) AS stored, max(fetched_at) AS fetched_at,
       arg_max(raw_id, row(fetched_at, raw_id)) AS raw_id FROM crossref_raw GROUP BY cache_key
""")
def c03_cache_compaction(spark: SparkSession, d: str) -> DataFrame:
    return state.compacted(table(spark, d, "crossref_raw"))


# ---- Scalars -----------------------------------------------------------------------------------------------


@query(f"""
SELECT row_id, {_doi('doi')} AS doi_key, nullif(regexp_extract(doi, '10\\.48550/arxiv\\.(\\S+)', 1, 'i'), '') AS arxiv_in_doi,
       regexp_replace(trim(arxiv_id), 'v\\d+$', '', 'i') AS arxiv_key,
       (arxiv_id IS NOT NULL OR coalesce(starts_with({_doi('doi')}, '10.48550/'), false)) AS printed_preprint
FROM bib_refs
""")
def m01_identifiers(spark: SparkSession, d: str) -> DataFrame:
    doi = N.normalise_doi(F.col("doi"))
    return table(spark, d, "bib_refs").select(
        "row_id",
        doi.alias("doi_key"),
        N.arxiv_in_doi(F.col("doi")).alias("arxiv_in_doi"),
        N.strip_version(F.trim("arxiv_id")).alias("arxiv_key"),
        N.looks_like_preprint(doi, F.col("arxiv_id")).alias("printed_preprint"),
    )


@query(f"SELECT row_id, {_text('title')} AS title_key, array_to_string(list_sort(string_split({_text('title')}, ' ')), ' ') AS word_key FROM bib_refs")
def m02_title_keys(spark: SparkSession, d: str) -> DataFrame:
    key = N.normalise_text(F.col("title"))
    return table(spark, d, "bib_refs").select("row_id", key.alias("title_key"), N.sorted_words(key).alias("word_key"))


@query(f"SELECT source_id, array_to_string({_surnames('authors')}, '|') AS surnames FROM resolved_sources")
def m04_surnames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolved_sources").select("source_id", F.array_join(N.surnames(F.col("authors")), "|").alias("surnames"))


@query("""
SELECT row_id, TRY_CAST(nullif(regexp_extract(' ' || coalesce(raw_text, '') || ' ', '[^0-9](1[5-9][0-9][0-9]|2[01][0-9][0-9])[^0-9]', 1), '') AS INT) AS printed_year,
       regexp_replace(raw_text, '\\d+', '#', 'g') AS masked FROM bib_refs
""")
def m08_printed_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bib_refs").select("row_id", N.coerce_year(F.col("raw_text")).alias("printed_year"), N.mask_digits(F.col("raw_text")).alias("masked"))


@query("""
SELECT row_id, nullif(regexp_replace(regexp_extract(raw_text, '(10\\.\\d{4,9}/[^\\s"<>,;]+)', 1), '[.):\\]]+$', ''), '') AS doi,
  nullif(regexp_extract(raw_text, 'arxiv:\\s*(\\d{4}\\.\\d{4,5}(?:v\\d+)?)', 1, 'i'), '') AS arxiv_id FROM bib_refs
""")
def m19_text_identifiers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_text")
    return table(spark, d, "bib_refs").select("row_id", N.doi_in_text(raw).alias("doi"), N.arxiv_in_text(raw).alias("arxiv_id"))


@query("""
SELECT raw_id, sha256('{"params":{"key":"' || cache_key || '","rows":"1"},"schema_version":1,"url":"works"}') AS request_key FROM crossref_raw WHERE cache_key IS NOT NULL
""")
def m11_request_keys(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "crossref_raw").filter(F.col("cache_key").isNotNull())
    params = F.create_map(F.lit("rows"), F.lit("1"), F.lit("key"), F.col("cache_key"))
    return raw.select("raw_id", N.request_key(F.lit("works"), params, SETTINGS.cache_schema_version).alias("request_key"))


@query("""
WITH p AS (
  SELECT row_id, regexp_replace(lower(raw_text), '\\s+', '', 'g') AS entry,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(doi), '\\s+', '', 'g'),
      '^(https?://|(dx\\.)?doi\\.org/|www\\.|arxiv\\.org/(abs|pdf)/|doi:|arxiv:|urn:)+', ''), '^[./,;:]+', ''), '[./,;:]+$', '') AS bare
  FROM bib_refs WHERE doi IS NOT NULL)
SELECT row_id, bare <> '' AND (contains(coalesce(entry, ''), bare) OR contains(coalesce(entry, ''), regexp_replace(bare, 'v\\d+$', ''))) AS printed FROM p
""")
def pred_p05_printed_identifiers(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "bib_refs").filter(F.col("doi").isNotNull())
    return refs.select("row_id", N.is_printed(F.col("doi"), F.col("raw_text")).alias("printed"))


# ---- Citations and registry lookups ------------------------------------------------------------------------


@query(f"WITH {_CURRENT} SELECT ledger_id, ref_id, count(*) AS claims, min(claim_id) AS first_claim FROM cit GROUP BY ledger_id, ref_id")
def j06_citation_inversion(spark: SparkSession, d: str) -> DataFrame:
    return linkage.citing_claims(_claims(spark, d))


@query(f"WITH {_CURRENT} SELECT row_id, ledger_id, ref_id FROM cur ANTI JOIN cit USING (ledger_id, ref_id)")
def j05_uncited_references(spark: SparkSession, d: str) -> DataFrame:
    refs = state.current_references(table(spark, d, "bib_refs"), [])
    return linkage.uncited(refs, _claims(spark, d)).select("row_id", "ledger_id", "ref_id")


_RESOLVE = f"""
WITH {_CURRENT}, reg AS (
  SELECT provider, kind, key, min(source_id) AS source_id FROM (
    SELECT provider, source_id, 'arxiv' AS kind, regexp_replace(trim(arxiv_id), 'v\\d+$', '', 'i') AS key FROM resolved_sources
    UNION ALL SELECT provider, source_id, 'doi', {_doi('doi')} FROM resolved_sources
    UNION ALL SELECT provider, source_id, 'title', {_text('title')} FROM resolved_sources)
  WHERE key IS NOT NULL AND key <> '' GROUP BY provider, kind, key
), k AS (
  SELECT row_id, coalesce(regexp_replace(trim(arxiv_id), 'v\\d+$', '', 'i'), nullif(regexp_extract(doi, '10\\.48550/arxiv\\.(\\S+)', 1, 'i'), '')) AS arxiv,
         nullif({_doi('doi')}, '') AS doi, nullif({_text('title')}, '') AS title FROM cur
), asked AS (
  SELECT row_id, 1 AS rank, 'arxiv_id' AS branch, 'arxiv' AS provider, 'arxiv' AS kind, arxiv AS key FROM k WHERE arxiv IS NOT NULL
  UNION ALL SELECT row_id, 2, 'arxiv_id', 'openalex', 'doi', doi FROM k WHERE arxiv IS NOT NULL
  UNION ALL SELECT row_id, 3, 'doi', 'crossref', 'doi', doi FROM k WHERE arxiv IS NULL
  UNION ALL SELECT row_id, 4, 'doi', 'openalex', 'doi', doi FROM k WHERE arxiv IS NULL
  UNION ALL SELECT row_id, 5, 'title_search', 'crossref', 'title', title FROM k
  UNION ALL SELECT row_id, 6, 'title_search', 'openalex', 'title', title FROM k
), hits AS (
  SELECT row_id, min(struct_pack(rank := rank, source_id := source_id, branch := branch)) AS h
  FROM asked JOIN reg USING (provider, kind, key) GROUP BY row_id
), resolved AS (SELECT cur.row_id, h.source_id AS source_id, h.branch AS branch FROM cur LEFT JOIN hits USING (row_id))
"""


#: Columns of a reference that lookups and signals ask for.
ASKED = ["title", "authors", "year", "doi", "arxiv_id"]


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return state.current_claims(table(spark, d, "ledger_claims"), ["ref_ids"])


def _resolved(spark: SparkSession, d: str, columns: list[str] = ASKED) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs = state.current_references(table(spark, d, "bib_refs"), columns)
    sources = table(spark, d, "resolved_sources")
    return refs, sources, linkage.resolve(refs, sources)


@query(_RESOLVE + "SELECT row_id, source_id, branch FROM resolved")
def j01_resolver_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, ["title", "doi", "arxiv_id"])[2]


@query(f"""
WITH s AS (SELECT source_id, provider, coalesce(is_retracted, false) AS own, {_doi('doi')} AS doi FROM resolved_sources),
flags AS (SELECT DISTINCT doi FROM s WHERE provider = 'openalex' AND own AND doi IS NOT NULL)
SELECT source_id, own OR flags.doi IS NOT NULL AS is_retracted FROM s LEFT JOIN flags ON s.doi = flags.doi
""")
def j02_retraction_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return linkage.retracted(table(spark, d, "resolved_sources"))


_TWINS = f"""
keyed AS (
  SELECT row_id, ledger_id, {_text('title')} AS t, coalesce(year, -1) AS y,
         coalesce({_doi('doi')}, '') || '~' || coalesce(trim(arxiv_id), '') || '~' || array_to_string({_surnames('authors')}, '|') AS identity
  FROM cur WHERE title IS NOT NULL AND trim(title) <> ''
), twins AS (
  SELECT a.row_id, min(b.row_id) AS sibling FROM keyed a JOIN keyed b USING (ledger_id, t, y) WHERE a.identity <> b.identity GROUP BY a.row_id
)"""


@query(f"WITH {_CURRENT}, {_TWINS} SELECT row_id, sibling FROM twins")
def j04_divergent_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return linkage.divergent_duplicates(state.current_references(table(spark, d, "bib_refs"), ASKED))


_SIGNALS = f"""
, sig AS (
  SELECT r.row_id, r.source_id, r.branch,
    CASE WHEN len({_surnames('cur.authors')}) = 0 OR len({_surnames('s.authors')}) = 0 THEN 0.0
         ELSE round(len(list_intersect({_surnames('cur.authors')}, {_surnames('s.authors')}))
              / len(list_distinct(list_concat({_surnames('cur.authors')}, {_surnames('s.authors')}))), 4) END AS author_overlap,
    abs(cur.year - s.year) AS year_delta,
    CASE WHEN nullif({_doi('cur.doi')}, '') IS NOT NULL AND nullif({_doi('s.doi')}, '') IS NOT NULL
         THEN {_text(_doi('cur.doi'))} = {_text(_doi('s.doi'))} END AS doi_match
  FROM resolved r JOIN cur USING (row_id) JOIN resolved_sources s ON s.source_id = r.source_id
)"""


@query(_RESOLVE + _SIGNALS + "SELECT row_id, source_id, branch, author_overlap, year_delta, doi_match FROM sig")
def m05_match_signals(spark: SparkSession, d: str) -> DataFrame:
    return linkage.signals(*_resolved(spark, d)).select("row_id", "source_id", "branch", "author_overlap", "year_delta", "doi_match")


@query()
def m03_title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The Gestalt ratio has no SQL form; tests hold it against the standard library."""
    return linkage.signals(*_resolved(spark, d)).select("row_id", "source_id", "title_similarity")


@query()
def d01_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Uses the Gestalt ratio; its other parts have SQL of their own above."""
    refs, sources, resolved = _resolved(spark, d)
    refs = written(refs, "references")
    unread = refs.filter(F.coalesce("title", "doi", "arxiv_id").isNull() & (F.coalesce(F.size("authors"), F.lit(0)) < 1) & F.col("year").isNull())
    return linkage.indicators(refs, _claims(spark, d), sources, linkage.resolve(refs, sources), SETTINGS, unread.select("row_id"))


@query(_RESOLVE.rstrip() + ", " + _TWINS.strip() + _SIGNALS + f"""
, ret AS (SELECT s.source_id, s.own OR f.doi IS NOT NULL AS gone FROM (SELECT source_id, coalesce(is_retracted, false) AS own, {_doi('doi')} AS doi FROM resolved_sources) s
  LEFT JOIN (SELECT DISTINCT {_doi('doi')} AS doi FROM resolved_sources WHERE provider = 'openalex' AND is_retracted AND doi IS NOT NULL) f ON s.doi = f.doi)
SELECT cur.row_id, c.ref_id IS NULL AS orphan, twins.row_id IS NOT NULL AS duplicate_entry, coalesce(ret.gone, false) AS retracted, coalesce(sig.doi_match = false, false) AS doi_mismatch
FROM cur LEFT JOIN (SELECT DISTINCT ledger_id, ref_id FROM cit) c USING (ledger_id, ref_id) LEFT JOIN twins ON twins.row_id = cur.row_id
LEFT JOIN sig ON sig.row_id = cur.row_id LEFT JOIN ret ON ret.source_id = sig.source_id
""")
def d02_exact_indicators(spark: SparkSession, d: str) -> DataFrame:
    refs, sources, resolved = _resolved(spark, d)
    return linkage.exact_indicators(refs, _claims(spark, d), sources, resolved)


@query(f"""
WITH {_CURRENT} SELECT ledger_id, ref_id, CASE WHEN side = 'e' THEN 'expected only' ELSE 'observed only' END AS side FROM (
  SELECT ledger_id, ref_id, 'e' AS side FROM cur ANTI JOIN ver USING (ledger_id, ref_id)
  UNION ALL SELECT DISTINCT ledger_id, ref_id, 'o' FROM ver ANTI JOIN cur USING (ledger_id, ref_id))
""")
def j08_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    refs = state.current_references(table(spark, d, "bib_refs"), [])
    return counts.reconcile(refs, table(spark, d, "verdicts"), ["ledger_id", "ref_id"])


@query("""
WITH closed AS (SELECT ledger_id, ref_id, max(judged_at) AS t FROM verdicts WHERE status = 'verified' GROUP BY ALL)
SELECT v.verdict_id, v.ledger_id, v.ref_id FROM verdicts v LEFT JOIN closed c USING (ledger_id, ref_id)
WHERE v.status <> 'verified' AND (c.t IS NULL OR c.t <= v.judged_at)
""")
def j10_open_items(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verdicts")
    opens = counts.not_followed(v, F.col("status") != "verified", F.col("status") == "verified", ["ledger_id", "ref_id"], "judged_at")
    return opens.select("verdict_id", "ledger_id", "ref_id")


# ---- Counts, rankings, constraints -------------------------------------------------------------------------

_VOCABULARY = "(SELECT unnest([{}]) AS {})"
_STATUS = _VOCABULARY.format(", ".join(f"'{s}'" for s in STATUSES), "status")
_INDICATOR = _VOCABULARY.format(", ".join(f"'{s}'" for s in INDICATORS), "indicator")


@query(f"WITH {_CURRENT} SELECT l.ledger_id, s.status, count(ver.verdict_id) AS n FROM (SELECT DISTINCT ledger_id FROM ver) l CROSS JOIN {_STATUS} s LEFT JOIN ver ON ver.ledger_id = l.ledger_id AND ver.status = s.status GROUP BY ALL")
def a01_summary_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.summary_counts(state.current_verdicts(table(spark, d, "verdicts"), ["status"]))


@query(f"WITH {_CURRENT} SELECT l.ledger_id, i.indicator, count(ver.verdict_id) AS n FROM (SELECT DISTINCT ledger_id FROM ver) l CROSS JOIN {_INDICATOR} i LEFT JOIN ver ON ver.ledger_id = l.ledger_id AND list_contains(ver.indicators, i.indicator) GROUP BY ALL")
def a02_indicator_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.indicator_counts(state.current_verdicts(table(spark, d, "verdicts"), ["indicators"]))


@query(_RESOLVE + """
, known AS (SELECT DISTINCT cur.ledger_id, cur.ref_id FROM cur JOIN resolved USING (row_id) WHERE source_id IS NOT NULL),
said AS (SELECT ledger_id, count(*) AS claims FROM cla GROUP BY ledger_id),
per AS (SELECT ledger_id, count(*) AS total, count(*) FILTER (status <> 'verified') AS worth_checking, count(*) FILTER (status = 'verified') AS verified,
  count(known.ref_id) AS resolved, round(count(known.ref_id) / count(*), 4) AS coverage, count(DISTINCT judge_model) AS judges
  FROM ver LEFT JOIN known USING (ledger_id, ref_id) GROUP BY ledger_id)
SELECT per.*, coalesce(claims, 0) AS claims FROM per LEFT JOIN said USING (ledger_id)
""")
def a05_headline(spark: SparkSession, d: str) -> DataFrame:
    refs, _, resolved = _resolved(spark, d)
    known = refs.select("row_id", "ledger_id", "ref_id").join(resolved.filter(F.col("source_id").isNotNull()), "row_id")
    verdicts = state.current_verdicts(table(spark, d, "verdicts"), ["status", "judge_model"])
    return counts.headline(verdicts, known, state.current_claims(table(spark, d, "ledger_claims"), []))


@query(f"""
SELECT s.status, CAST(list_position(['conflict', 'needs_check', 'unresolvable', 'verified'], s.status) AS INT) AS position, count(v.verdict_id) AS n,
  round(count(v.verdict_id) / (SELECT count(*) FROM verdicts), 4) AS share FROM {_STATUS} s LEFT JOIN verdicts v USING (status) GROUP BY s.status
""")
def a06_status_shares(spark: SparkSession, d: str) -> DataFrame:
    return counts.status_shares(table(spark, d, "verdicts"))


@query("SELECT ledger_id, judge_model, min(verdict_id) AS first_seen, count(*) AS n FROM verdicts GROUP BY ledger_id, judge_model")
def a07_judge_models(spark: SparkSession, d: str) -> DataFrame:
    return counts.judge_models(table(spark, d, "verdicts"))


@query(f"""
WITH {_CURRENT}, told AS (SELECT ledger_id, ref_id, 'orphan' = ANY(coalesce(indicators, [])) AS said FROM ver),
scored AS (SELECT cur.ledger_id, told.said = (cit.ref_id IS NULL) AS matched FROM cur JOIN told USING (ledger_id, ref_id)
  LEFT JOIN (SELECT DISTINCT ledger_id, ref_id FROM cit) cit USING (ledger_id, ref_id))
SELECT ledger_id, count(*) AS rows, count(*) FILTER (matched) AS matched_rows, bool_and(matched) AS detected FROM scored GROUP BY ledger_id
""")
def a10_all_rows_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether the orphan indicator of every verdict of a ledger agrees with the citations."""
    refs = state.current_references(table(spark, d, "bib_refs"), [])
    verdicts = state.current_verdicts(table(spark, d, "verdicts"), ["indicators"])
    cited = linkage.citations(_claims(spark, d)).select("ledger_id", "ref_id", F.lit(True).alias("cited")).dropDuplicates()
    said = F.coalesce(F.array_contains("indicators", "orphan"), F.lit(False))
    scored = refs.join(verdicts.select("ledger_id", "ref_id", said.alias("said")), ["ledger_id", "ref_id"]).join(cited, ["ledger_id", "ref_id"], "left")
    return counts.all_rows_match(scored.withColumn("matched", F.col("said") == F.col("cited").isNull()), ["ledger_id"], "matched")


_PAIRS = f"""
WITH first_v AS (SELECT * FROM verdicts {_LAST.format(k='ledger_id, ref_id', o='judged_at, verdict_id')}), {_CURRENT},
pairs AS (SELECT f.status AS e, v.status AS o FROM first_v f JOIN ver v USING (ledger_id, ref_id))
"""


@query(_PAIRS + f"SELECT s.status, count(*) FILTER (e = s.status) AS expected, count(*) FILTER (o = s.status) AS observed, count(*) FILTER (e = s.status AND o = s.status) AS matched FROM {_STATUS} s CROSS JOIN pairs GROUP BY s.status")
def a12_status_confusion(spark: SparkSession, d: str) -> DataFrame:
    """First against last verdict of each reference."""
    v = table(spark, d, "verdicts").select("ledger_id", "ref_id", "status", "judged_at", "verdict_id")
    both = v.groupBy("ledger_id", "ref_id").agg(
        F.min_by("status", F.struct("judged_at", "verdict_id")).alias("expected"), F.max_by("status", F.struct("judged_at", "verdict_id")).alias("observed")
    )
    return counts.confusion(both, STATUSES, "expected", "observed")


@query(f"""
WITH {_CURRENT}, {_TWINS.strip()}, checks AS (SELECT a.verdict_id, list_sort(list_distinct(coalesce(a.indicators, []))) = list_sort(list_distinct(coalesce(b.indicators, []))) AS same
  FROM verdicts a JOIN ver b USING (ledger_id, ref_id))
SELECT verdict_id, same FROM checks
""")
def a15_same_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Whether each verdict has the same set of indicators as the current one of its reference."""
    v = table(spark, d, "verdicts")
    last = state.current_verdicts(v, ["indicators"]).select("ledger_id", "ref_id", F.col("indicators").alias("current"))
    return v.join(last, ["ledger_id", "ref_id"]).select("verdict_id", counts.same_set(F.col("indicators"), F.col("current")).alias("same"))


@query(f"""
WITH {_CURRENT} SELECT ledger_id, ref_id, verdict_id, status, priority, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY ledger_id ORDER BY priority DESC NULLS LAST, ref_id, verdict_id) AS INT) AS position FROM ver) WHERE position <= {TOP}
""")
def k01_worklist(spark: SparkSession, d: str) -> DataFrame:
    return counts.worklist(state.current_verdicts(table(spark, d, "verdicts"), ["status", "priority"]), TOP)


@query(f"""
WITH {_CURRENT} SELECT ver.verdict_id, coalesce(cur.title, cur.raw_text) AS shown, array_to_string(cur.authors, '; ') AS authors, ver.status,
  CASE WHEN cur.doi IS NOT NULL THEN 'https://doi.org/' || {_doi('cur.doi')} WHEN cur.arxiv_id IS NOT NULL THEN 'https://arxiv.org/abs/' || cur.arxiv_id END AS url
FROM ver JOIN cur USING (ledger_id, ref_id)
""")
def k03_row_view(spark: SparkSession, d: str) -> DataFrame:
    refs = state.current_references(table(spark, d, "bib_refs"), ["title", "raw_text", "authors", "doi", "arxiv_id"])
    v = state.current_verdicts(table(spark, d, "verdicts"), ["status"]).select("ledger_id", "ref_id", "verdict_id", "status")
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), N.normalise_doi(F.col("doi"))), F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id")))
    return v.join(refs, ["ledger_id", "ref_id"]).select(
        "verdict_id", F.coalesce("title", "raw_text").alias("shown"), F.array_join("authors", "; ").alias("authors"), "status", url.alias("url")
    )


_RULES = """
WITH broken AS (
  SELECT verdict_id, variant, CASE WHEN variant = 1 THEN 1 + coalesce(confidence, 0.5) ELSE confidence END AS confidence, CASE WHEN variant = 2 THEN -0.25 ELSE priority END AS priority,
    CASE WHEN variant = 3 THEN '' ELSE rationale END AS rationale, CASE WHEN variant = 4 THEN list_concat(coalesce(checks, []), ['a', 'b', 'c', 'd']) ELSE checks END AS checks,
    CASE WHEN variant = 5 THEN upper(status) ELSE status END AS status, CASE WHEN variant = 6 THEN list_concat(coalesce(indicators, []), ['other']) ELSE indicators END AS indicators,
    CASE WHEN variant = 7 THEN NULL ELSE ref_id END AS ref_id, ledger_id
  FROM verdicts CROSS JOIN (SELECT unnest(range(0, 8)) AS variant))
SELECT verdict_id, CAST(variant AS INT) AS variant, rule FROM (
  SELECT verdict_id, variant, unnest(list_filter([
    CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_bounds' END, CASE WHEN priority NOT BETWEEN 0 AND 1 THEN 'priority_bounds' END,
    CASE WHEN coalesce(length(rationale) < 1, true) THEN 'rationale_empty' END, CASE WHEN len(checks) > 3 THEN 'too_many_checks' END,
    CASE WHEN NOT coalesce(status IN ('verified', 'needs_check', 'conflict', 'unresolvable'), false) THEN 'unknown_status' END,
    CASE WHEN len(list_filter(indicators, lambda i: i NOT IN ('retracted', 'version_mismatch', 'doi_mismatch', 'duplicate_entry', 'orphan', 'malformed'))) > 0 THEN 'unknown_indicator' END,
    CASE WHEN ref_id IS NULL OR ledger_id IS NULL THEN 'no_reference' END], lambda r: r IS NOT NULL)) AS rule FROM broken)
"""


@query(_RULES)
def v01_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every verdict as it is and with each of seven faults, so that every rule has rows that break it."""
    v = table(spark, d, "verdicts").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(7))))
    fault = lambda k, c, value: F.when(F.col("variant") == k, value).otherwise(F.col(c)).alias(c)
    more = lambda c, *words: F.concat(F.coalesce(c, F.array().cast("array<string>")), F.array(*map(F.lit, words)))
    broken = v.select(
        "verdict_id", "variant", "ledger_id", fault(1, "confidence", 1 + F.coalesce("confidence", F.lit(0.5))), fault(2, "priority", F.lit(-0.25)), fault(3, "rationale", F.lit("")),
        fault(4, "checks", more("checks", "a", "b", "c", "d")), fault(5, "status", F.upper("status")), fault(6, "indicators", more("indicators", "other")), fault(7, "ref_id", F.lit(None)),
    )
    keyed = broken.withColumn("key", F.struct("verdict_id", "variant"))
    return constraints.violations(keyed, "key", constraints.verdict_rules(SETTINGS.max_checks)).select("key.verdict_id", "key.variant", "rule")


@query("SELECT ledger_id, ref_id, count(*) AS n FROM bib_refs WHERE deleted_at IS NULL GROUP BY ledger_id, ref_id HAVING count(*) > 1")
def v08_repeated_references(spark: SparkSession, d: str) -> DataFrame:
    return constraints.repeated_keys(state.usable(table(spark, d, "bib_refs")), ["ledger_id", "ref_id"])


_SCANNED = ("baseline", "gain", "by hand", "no record")


@query(f"""
SELECT verdict_id, term FROM (SELECT verdict_id, lower(concat_ws(chr(10), rationale, array_to_string(checks, chr(10)))) AS t FROM verdicts)
JOIN (SELECT unnest([{', '.join(repr(t) for t in _SCANNED)}]) AS term) ON contains(t, term)
""")
def pred_p03_term_scan(spark: SparkSession, d: str) -> DataFrame:
    texts = [F.col("rationale"), F.array_join("checks", "\n")]
    return constraints.banned_terms(table(spark, d, "verdicts"), "verdict_id", texts, _SCANNED)


@query("SELECT verdict_id, ledger_id, ref_id, status FROM verdicts QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY judged_at DESC, verdict_id DESC) = 1")
def a18_latest_per_ledger(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verdicts").select("verdict_id", "ledger_id", "ref_id", "status", "judged_at")
    return state.latest(v, ["ledger_id"], ["judged_at", "verdict_id"]).select("verdict_id", "ledger_id", "ref_id", "status")


@query(f"""
WITH {_CURRENT}, per AS (SELECT ledger_id, count(*) AS entries, count(*) FILTER (status IN ('verified', 'needs_check', 'conflict', 'unresolvable')) AS counted, count(DISTINCT ref_id) AS ids FROM ver GROUP BY ledger_id)
SELECT ledger_id, entries, counted, entries = counted AND entries = ids AS consistent FROM per
""")
def a04_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Whether the counts per status add up to the entries and every id occurs once."""
    v = state.current_verdicts(table(spark, d, "verdicts"), ["status"])
    per = v.groupBy("ledger_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("status").isin(*STATUSES)).alias("counted"), F.countDistinct("ref_id").alias("ids")
    )
    return per.select("ledger_id", "entries", "counted", ((F.col("entries") == F.col("counted")) & (F.col("entries") == F.col("ids"))).alias("consistent"))


@query(f"SELECT count(*) AS ids, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(*) FILTER (n <> 2) AS not_in_pairs FROM (SELECT {_doi('doi')} AS k, count(*) AS n FROM bib_refs WHERE doi IS NOT NULL GROUP BY ALL)")
def a17_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of ids that rows share, here printed identifiers."""
    return counts.shared_ids(table(spark, d, "bib_refs").select(N.normalise_doi(F.col("doi")).alias("k")), "k")


@query(f"""
WITH {_CURRENT}, n AS (SELECT ledger_id, ref_id, count(*) AS claims FROM cit GROUP BY ALL)
SELECT cur.row_id, CAST(to_json(struct_pack(ref_id := cur.ref_id, title := title, year := year, doi := doi, claims := coalesce(n.claims, 0))) AS VARCHAR) AS payload
FROM cur LEFT JOIN n USING (ledger_id, ref_id)
""")
def pred_p07_payload(spark: SparkSession, d: str) -> DataFrame:
    """What a judge is shown of each reference, nothing else, with the number of its citations."""
    refs = state.current_references(table(spark, d, "bib_refs"), ["title", "year", "doi"])
    cited = linkage.citing_claims(_claims(spark, d)).select("ledger_id", "ref_id", "claims")
    shown = F.struct("ref_id", "title", "year", "doi", F.coalesce("claims", F.lit(0)).alias("claims"))
    return refs.join(cited, ["ledger_id", "ref_id"], "left").select("row_id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("payload"))


@query("""
SELECT verdict_id, CASE WHEN confidence IS NULL THEN 'not comparable' ELSE printf('%.2f', confidence) END AS confidence_text,
  CASE WHEN length(t) > 60 THEN left(t, 59) || '…' ELSE t END AS short_rationale, CAST(round_even(priority * 100, 0) AS BIGINT) AS percent, CAST(round_even(floor(priority * 40) / 40 * 100, 0) AS BIGINT) AS half_percent
FROM (SELECT *, trim(regexp_replace(rationale, '\\s+', ' ', 'g')) AS t FROM verdicts)
""")
def pred_p10_row_text(spark: SparkSession, d: str) -> DataFrame:
    flat = F.trim(F.regexp_replace("rationale", r"\s+", " "))
    return table(spark, d, "verdicts").select(
        "verdict_id",
        F.when(F.col("confidence").isNull(), "not comparable").otherwise(F.format_string("%.2f", "confidence")).alias("confidence_text"),
        F.when(F.length(flat) > 60, F.concat(F.left(flat, F.lit(59)), F.lit("…"))).otherwise(flat).alias("short_rationale"),
        F.bround(F.col("priority") * 100).cast("long").alias("percent"),
        # Steps of 2.5 per cent: every other one lies half-way.
        F.bround(F.floor(F.col("priority") * 40) / 40 * 100).cast("long").alias("half_percent"),
    )


@query("""
WITH s AS (SELECT source_id, doi, list_distinct(list_filter(coalesce(authors, []), lambda v: v IS NOT NULL)) AS x FROM resolved_sources WHERE doi IS NOT NULL),
k AS (SELECT doi, arg_min(x, source_id) AS y FROM s GROUP BY doi)
SELECT source_id, len(list_intersect(x, y)) AS both, len(list_distinct(list_concat(x, y))) AS either, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS only_first
FROM s JOIN k USING (doi)
""")
def u01_author_sets(spark: SparkSession, d: str) -> DataFrame:
    """Author lists of each record against the first record of its printed identifier."""
    names = F.array_distinct(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda v: v.isNotNull()))
    s = table(spark, d, "resolved_sources").filter(F.col("doi").isNotNull()).select("source_id", "doi", names.alias("x"))
    first = s.groupBy("doi").agg(F.min_by("x", "source_id").alias("y"))
    both = s.join(first, "doi")
    return both.select(
        "source_id",
        F.size(F.array_intersect("x", "y")).cast("long").alias("both"),
        F.size(F.array_union("x", "y")).cast("long").alias("either"),
        F.size(F.array_except("x", "y")).cast("long").alias("only_first"),
    )


@query("""
SELECT row_id, sha256(concat_ws(chr(31), coalesce(raw_text, chr(0)), 'reader', '0.000', '2', '1')) AS key FROM bib_refs
""")
def m12_extraction_keys(spark: SparkSession, d: str) -> DataFrame:
    key = N.extraction_key(F.col("raw_text"), F.lit("reader"), F.lit(0.0), 2, SETTINGS.cache_schema_version)
    return table(spark, d, "bib_refs").select("row_id", key.alias("key"))


@query(_RESOLVE.rstrip() + f"""
SELECT r.row_id, cur.title AS printed_title, s.title AS found_title, array_to_string(cur.authors, ', ') AS printed_authors, array_to_string(s.authors, ', ') AS found_authors,
  CAST(cur.year AS VARCHAR) AS printed_year, CAST(s.year AS VARCHAR) AS found_year, s.provider,
  CASE WHEN nullif(s.url, '') IS NOT NULL THEN 'record' WHEN coalesce(nullif(s.doi, ''), nullif(cur.doi, '')) IS NOT NULL THEN 'doi'
    WHEN coalesce(nullif(s.arxiv_id, ''), nullif(cur.arxiv_id, '')) IS NOT NULL THEN 'arxiv' WHEN nullif(cur.title, '') IS NOT NULL THEN 'title search' END AS lookup,
  coalesce(nullif(s.url, ''), 'https://doi.org/' || {_doi("coalesce(nullif(s.doi, ''), nullif(cur.doi, ''))")}, 'https://arxiv.org/abs/' || coalesce(nullif(s.arxiv_id, ''), nullif(cur.arxiv_id, '')),
    'https://scholar.google.com/scholar?q=' || replace(replace(replace(url_encode(nullif(cur.title, '')), '%20', '+'), '%2A', '*'), '~', '%7E')) AS url
FROM resolved r JOIN cur USING (row_id) LEFT JOIN resolved_sources s ON s.source_id = r.source_id
""")
def pred_p08_panel(spark: SparkSession, d: str) -> DataFrame:
    """Each reference beside its record, and where to look it up."""
    p = linkage.panel(*_resolved(spark, d, [*ASKED, "venue"]))
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in ("title", "authors", "year") for side in ("printed", "found")]
    return p.select("row_id", *sides, "provider", "lookup", "url")


@query("""
WITH p AS (
  SELECT row_id, raw_text, doi, arxiv_id, regexp_replace(lower(coalesce(raw_text, '')), '\\s+', '', 'g') AS entry,
    list_transform([doi, arxiv_id], lambda v: regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(v), '\\s+', '', 'g'),
      '^(https?://|(dx\\.)?doi\\.org/|www\\.|arxiv\\.org/(abs|pdf)/|doi:|arxiv:|urn:)+', ''), '^[./,;:]+', ''), '[./,;:]+$', '')) AS bare FROM bib_refs),
q AS (SELECT *, bare[1] <> '' AND (contains(entry, bare[1]) OR contains(entry, regexp_replace(bare[1], 'v\\d+$', ''))) AS d_ok,
  bare[2] <> '' AND (contains(entry, bare[2]) OR contains(entry, regexp_replace(bare[2], 'v\\d+$', ''))) AS a_ok FROM p)
SELECT row_id, CASE WHEN d_ok THEN doi END AS doi, CASE WHEN a_ok THEN arxiv_id END AS arxiv_id,
  concat_ws(',', CASE WHEN doi IS NOT NULL AND NOT d_ok THEN 'doi' END, CASE WHEN arxiv_id IS NOT NULL AND NOT a_ok THEN 'arxiv_id' END) AS nulled FROM q
""")
def pred_p06_unprinted_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that stand in the printed entry; the others become null and are named."""
    kept = {c: N.printed_or_null(F.col(c), F.col("raw_text")) for c in ("doi", "arxiv_id")}
    nulled = [F.when(F.col(c).isNotNull() & k.isNull(), F.lit(c)) for c, k in kept.items()]
    return table(spark, d, "bib_refs").select("row_id", *(k.alias(c) for c, k in kept.items()), F.concat_ws(",", *nulled).alias("nulled"))


@query(_RESOLVE.rstrip() + f"""
, gone AS (SELECT s.source_id FROM (SELECT source_id, coalesce(is_retracted, false) AS own, {_doi('doi')} AS doi FROM resolved_sources) s
  LEFT JOIN (SELECT DISTINCT {_doi('doi')} AS doi FROM resolved_sources WHERE provider = 'openalex' AND is_retracted AND doi IS NOT NULL) f ON s.doi = f.doi WHERE own OR f.doi IS NOT NULL)
SELECT ver.verdict_id FROM ver JOIN cur USING (ledger_id, ref_id) JOIN resolved USING (row_id) JOIN gone USING (source_id) WHERE NOT list_contains(coalesce(ver.indicators, []), 'retracted')
""")
def v06_unflagged_retractions(spark: SparkSession, d: str) -> DataFrame:
    refs, sources, resolved = _resolved(spark, d, ["title", "doi", "arxiv_id"])
    v = state.current_verdicts(table(spark, d, "verdicts"), ["indicators"])
    entries = v.join(refs.select("ledger_id", "ref_id", "row_id"), ["ledger_id", "ref_id"]).join(resolved, "row_id").join(linkage.retracted(sources), "source_id")
    return constraints.unflagged_retractions(entries, "verdict_id")


@query(f"""
WITH {_CURRENT}, a AS (SELECT ledger_id, ref_id, row_number() OVER (PARTITION BY ledger_id ORDER BY ref_id) AS n FROM cur),
b AS (SELECT ledger_id, ref_id, row_number() OVER (PARTITION BY ledger_id ORDER BY ref_id) AS n FROM ver)
SELECT a.ledger_id, CAST(a.n AS INT) AS n, a.ref_id AS reference, b.ref_id AS verdict FROM a JOIN b USING (ledger_id, n) WHERE a.ref_id IS DISTINCT FROM b.ref_id
""")
def v07_misaligned_entries(spark: SparkSession, d: str) -> DataFrame:
    """References and verdicts of a ledger put together by their place alone, as a faulty writer would do."""
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy("ref_id")).alias("n")
    a = state.current_references(table(spark, d, "bib_refs"), []).select("ledger_id", F.col("ref_id").alias("reference"), place)
    b = state.current_verdicts(table(spark, d, "verdicts"), []).select("ledger_id", F.col("ref_id").alias("verdict"), place)
    return constraints.misaligned(a.join(b, ["ledger_id", "n"]), ["ledger_id", "n"], ["reference", "verdict"])


@query(f"""
WITH {_CURRENT}, o AS (SELECT DISTINCT ledger_id, ref_id FROM verdicts),
x AS (SELECT ledger_id, ref_id, cur.row_id IS NOT NULL AS b, o.ref_id IS NOT NULL AS a FROM (SELECT ledger_id, ref_id, row_id FROM cur) cur FULL OUTER JOIN o USING (ledger_id, ref_id))
SELECT ledger_id, count(*) FILTER (b) AS entries, count(*) FILTER (a AND b) AS kept, count(*) FILTER (a AND b) = count(*) FILTER (b) AND count(*) FILTER (NOT b) = 0 AS complete FROM x GROUP BY ledger_id
""")
def v09_dropped_entries(spark: SparkSession, d: str) -> DataFrame:
    """Whether judging left out none of a ledger's references and added none."""
    return constraints.dropped(state.current_references(table(spark, d, "bib_refs"), []), table(spark, d, "verdicts"), ["ledger_id", "ref_id"])


@query("""
WITH last AS (SELECT * FROM crossref_raw QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY fetched_at DESC NULLS LAST, raw_id DESC) = 1),
now AS (SELECT max(fetched_at) AS t FROM crossref_raw),
hit AS (SELECT cache_key FROM last, now WHERE fetched_at >= t - INTERVAL 30 DAY AND payload IS NOT NULL AND json_valid(payload) AND ltrim(payload, E' \\n\\t\\r') LIKE '{%')
SELECT DISTINCT cache_key FROM crossref_raw WHERE cache_key NOT IN (SELECT cache_key FROM hit WHERE cache_key IS NOT NULL)
""")
def c02_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Keys that have to be fetched again: no reply within 30 days of the last fetch, or none that is an object."""
    raw = table(spark, d, "crossref_raw").filter(F.col("cache_key").isNotNull())
    now = table(spark, d, "crossref_raw").agg(F.max("fetched_at")).first()[0]
    return state.cache_misses(raw, state.cache_get(raw, F.lit(now), 30 * 24.0))


@query("""
SELECT verdict_id, status, greatest(0.0, least(1.0, confidence * 2)) AS confidence, trim(rationale) AS rationale, CAST(least(3, len(list_filter(list_transform(coalesce(checks, []), lambda c: trim(c)), lambda c: c <> '')) * 2) AS INT) AS n_checks
FROM verdicts WHERE length(trim(rationale)) > 0 AND status IN ('verified', 'needs_check', 'conflict', 'unresolvable')
""")
def m16_verdict_replies(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts written into judging replies, with prose and another object around them, and read back: status in
    capitals, confidence out of bounds, checks twice."""
    v = table(spark, d, "verdicts")
    checks = F.coalesce("checks", F.array().cast("array<string>"))
    body = F.to_json(F.struct(F.upper("status").alias("status"), (F.col("confidence") * 2).alias("confidence"), F.concat(F.lit(" "), "rationale").alias("rationale"), F.concat(checks, checks).alias("checks")))
    reply = F.concat(F.lit('<think>{"status": "none"}</think> First {"draft": 1}, then:\n```json\n'), body, F.lit("\n```\nDone {so far."))
    read = v.select("verdict_id", replies.verdict_fields(reply, SETTINGS.max_checks).alias("f")).filter(F.col("f").isNotNull())
    return read.select("verdict_id", "f.status", "f.confidence", "f.rationale", F.size("f.checks").alias("n_checks"))


@query("""
SELECT row_id, nullif(trim(title), '') AS title, CAST(len(list_filter(list_transform(coalesce(authors, []), lambda a: trim(a)), lambda a: a <> '')) AS INT) AS n_authors,
  CASE WHEN year BETWEEN 1500 AND 2199 THEN year END AS year, nullif(trim(doi), '') AS doi FROM bib_refs
""")
def m15_reference_replies(spark: SparkSession, d: str) -> DataFrame:
    """References written into extraction replies between prose, and read back."""
    r = table(spark, d, "bib_refs")
    fields = F.struct("title", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.concat(F.lit("("), "year", F.lit(")")).alias("year"), "doi", "arxiv_id", "venue")
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(fields, {"ignoreNullFields": "false"}), F.lit("\n```\nAnything else?"))
    read = r.select("row_id", replies.reference_fields(reply).alias("f"))
    return read.select("row_id", "f.title", F.size("f.authors").alias("n_authors"), "f.year", "f.doi")


@query("SELECT source_id, title, CAST(coalesce(len(authors), 0) AS INT) AS n_authors, year, doi, coalesce(is_retracted, false) AS is_retracted, is_preprint FROM resolved_sources")
def s13_openalex_works(spark: SparkSession, d: str) -> DataFrame:
    """Records written as replies of that provider and read back."""
    s = table(spark, d, "resolved_sources")
    people = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.struct(F.struct(a.alias("display_name")).alias("author")))
    kind = F.when(F.col("is_preprint"), "preprint").when(~F.col("is_preprint"), "article")
    where = F.struct(F.struct(F.col("venue").alias("display_name"), F.when(~F.col("is_preprint"), "journal").alias("type")).alias("source"))
    reply = F.to_json(F.struct("doi", F.col("title").alias("display_name"), people.alias("authorships"), F.col("year").alias("publication_year"), "is_retracted", kind.alias("type"), where.alias("primary_location")))
    read = s.select("source_id", payloads.openalex_work(reply).alias("w"))
    return read.select("source_id", "w.title", F.coalesce(F.size("w.authors"), F.lit(0)).alias("n_authors"), "w.year", "w.doi", "w.is_retracted", "w.is_preprint")


_LABELS = f"""
WITH {_CURRENT}, lab AS (
  SELECT document_name AS document, regexp_replace(document_name, '\\.[^.]*$', '') AS file_stem, CASE WHEN n_pages IS NOT NULL THEN n_pages > 20 END AS control,
    CASE WHEN n_pages > 10 THEN 'CC0' ELSE 'other' END AS license, row_number() OVER (PARTITION BY v.ledger_id ORDER BY ref_id) - 1 AS pos, ref_id,
    indicators[1] AS defect_id, status AS expected_status, indicators AS expected_indicators, rationale AS defect, coalesce(len(indicators), 0) > 0 AS injected,
    judge_model AS verified_by, strftime(judged_at, '%Y-%m-%d') AS verified_on
  FROM ver v JOIN ledgers l ON v.ledger_id = l.ledger_id),
own AS (SELECT document, ref_id, unnest(list_filter([
    CASE WHEN file_stem <> regexp_replace(document, '\\.pdf$', '', 'i') THEN 'file_name' END, CASE WHEN control IS NULL THEN 'no_control_flag' END,
    CASE WHEN license <> 'CC0' THEN 'unknown_licence' END, CASE WHEN coalesce(TRY_CAST(regexp_extract(ref_id, '^R0*(\\d{{1,9}})$', 1) AS INT) <> pos + 1, true) THEN 'id_out_of_turn' END,
    CASE WHEN injected AND NOT (coalesce(defect_id, '') <> '' AND coalesce(defect, '') <> '') THEN 'injected_without_defect' END,
    CASE WHEN NOT injected AND (coalesce(defect_id, '') <> '' OR coalesce(defect, '') <> '') THEN 'defect_without_injection' END,
    CASE WHEN (coalesce(verified_by, '') <> '') <> (coalesce(verified_on, '') <> '') THEN 'half_verified' END,
    CASE WHEN coalesce(control, false) AND injected THEN 'injected_in_control' END], lambda r: r IS NOT NULL)) AS rule FROM lab),
twice AS (SELECT document, ref_id, 'repeated_id' AS rule FROM lab GROUP BY document, ref_id HAVING count(*) > 1),
spread AS (SELECT min(struct_pack(document := document, ref_id := ref_id)) AS k FROM lab WHERE coalesce(defect_id, '') <> '' GROUP BY defect_id HAVING count(DISTINCT document) > 1)
SELECT document, ref_id, rule FROM own UNION ALL SELECT * FROM twice UNION ALL SELECT k.document, k.ref_id, 'defect_in_several_documents' FROM spread
"""


@query(_LABELS)
def a16_label_rules(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts taken as labels of their documents, their indicators as planted defects."""
    v = state.current_verdicts(table(spark, d, "verdicts"), ["status", "indicators", "rationale", "judge_model"])
    name, pages = F.col("document_name"), F.col("n_pages")
    labels = v.join(table(spark, d, "ledgers"), "ledger_id").select(
        name.alias("document"), files.stem(name).alias("file_stem"), (pages > 20).alias("control"), F.when(pages > 10, "CC0").otherwise("other").alias("license"),
        (F.row_number().over(Window.partitionBy("ledger_id").orderBy("ref_id")) - 1).alias("pos"), "ref_id", F.try_element_at("indicators", F.lit(1)).alias("defect_id"),
        F.col("status").alias("expected_status"), F.col("indicators").alias("expected_indicators"), F.col("rationale").alias("defect"),
        (F.coalesce(F.size("indicators"), F.lit(0)) > 0).alias("injected"), F.col("judge_model").alias("verified_by"), F.date_format("judged_at", "yyyy-MM-dd").alias("verified_on"),
    )
    return constraints.label_violations(labels)


# ---- Sources and sinks -------------------------------------------------------------------------------------


@query("""
SELECT ledger_id, document_name, regexp_replace(document_name, '\\.[^.]*$', '') AS stem, 'out/' || regexp_replace(document_name, '\\.[^.]*$', '') || '_ledger.json' AS ledger_path,
  regexp_replace(document_name, '\\.pdf$', '', 'i') AS label_stem FROM ledgers
""")
def s02_document_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("document_name")
    return table(spark, d, "ledgers").select(
        "ledger_id", "document_name", files.stem(name).alias("stem"), files.ledger_path(name, "out").alias("ledger_path"), files.label_stem(name).alias("label_stem")
    )


@query(f"""
WITH {_CURRENT} SELECT ledger_id, ref_id, title, status, confidence, CAST(coalesce(len(checks), -1) AS INT) AS n_checks, priority
FROM (SELECT ver.*, cur.title FROM ver JOIN cur USING (ledger_id, ref_id))
""")
def s05_ledger_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as JSON lines and read back strictly."""
    from tracefold.session import ensure_checkpoint_dir
    import uuid

    refs = state.current_references(table(spark, d, "bib_refs"))
    entries = files.ledger_entries(refs, state.current_verdicts(table(spark, d, "verdicts")))
    path = f"{ensure_checkpoint_dir(spark)}/ledgers-{uuid.uuid4().hex}"
    files.write_ledgers(entries, path)
    back = files.read_ledgers(spark, path)
    return back.select(
        "ledger_id", "reference.ref_id", "reference.title", "verdict.status", "verdict.confidence", F.size("verdict.checks").alias("n_checks"), "priority"
    )


_TEXT_OR_FIRST = "coalesce(json_extract_string(w, '$.\"{0}\"[0]'), CASE WHEN json_type(w, '$.\"{0}\"') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract_string(w, '$.\"{0}\"') END)"
_NAMES = """list_filter(list_transform(CASE WHEN json_type(w, '$.author') = 'ARRAY' THEN CAST(json_extract(w, '$.author') AS JSON[]) ELSE [] END, lambda a:
  CASE WHEN json_extract_string(a, '$.family') IS NOT NULL THEN concat_ws(' ', json_extract_string(a, '$.given'), json_extract_string(a, '$.family')) ELSE json_extract_string(a, '$.name') END), lambda n: n IS NOT NULL)"""


@query(f"""
WITH m AS (SELECT raw_id, json_extract(payload, '$.message') AS m FROM (SELECT * FROM crossref_raw WHERE payload IS NOT NULL AND json_valid(payload)) WHERE json_type(payload, '$.message') = 'OBJECT'),
one AS (SELECT raw_id, 0 AS item_pos, m AS w FROM m WHERE json_extract(m, '$.items') IS NULL OR json_type(m, '$.items') = 'NULL'
  UNION ALL SELECT raw_id, unnest(range(CAST(json_array_length(m, '$.items') AS BIGINT))), unnest(CAST(json_extract(m, '$.items') AS JSON[])) FROM m WHERE json_type(m, '$.items') = 'ARRAY')
SELECT raw_id, CAST(item_pos AS INT) AS item_pos, json_extract_string(w, '$.DOI') AS doi, {_TEXT_OR_FIRST.format('title')} AS title, {_TEXT_OR_FIRST.format('container-title')} AS venue,
  array_to_string({_NAMES}, '; ') AS authors,
  coalesce({', '.join(f"""TRY_CAST(json_extract_string(w, '$."{f}"."date-parts"[0][0]') AS INT)""" for f in payloads.YEAR_FIELDS)}) AS year,
  CASE json_extract_string(w, '$.type') WHEN 'posted-content' THEN true WHEN 'journal-article' THEN false END AS is_preprint
FROM one WHERE json_type(w) = 'OBJECT'
""")
def s12_crossref_works(spark: SparkSession, d: str) -> DataFrame:
    return payloads.crossref_works(table(spark, d, "crossref_raw")).withColumn("authors", F.array_join("authors", "; "))
