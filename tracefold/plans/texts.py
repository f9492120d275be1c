"""Registered queries over passages: lines, bibliographies, sentences and citation markers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.config import Settings
from tracefold.functions import repair
from tracefold.operators import orphans, segment, state
from tracefold.session import table
from tracefold.streaming import arrivals

SETTINGS = Settings()

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NL = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"
_LINES = f"""
split AS (SELECT doc_id, ledger_id, section, text, regexp_split_to_array(coalesce(text, ''), {_NL}) AS p FROM documents),
arr AS (SELECT doc_id, ledger_id, section, text, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS ls FROM split),
lin AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM arr)
"""
_HEAD = "'^\\s*((\\d+|[ivxlcIVXLC]+)\\.?\\s*)?(references|bibliography|works cited|literature cited)\\.?\\s*$', 'i'"


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) FILTER (trim(line) = '') AS blank FROM lin GROUP BY doc_id")
def t01_lines(spark: SparkSession, d: str) -> DataFrame:
    n = segment.numbered_lines(table(spark, d, "documents"))
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"), F.count_if(F.trim("line") == "").alias("blank"))


@query(f"""
WITH {_LINES}, h AS (SELECT doc_id, max(line_no) AS h FROM lin WHERE regexp_matches(line, {_HEAD}) GROUP BY doc_id)
SELECT arr.doc_id, CAST(h.h AS INT) AS heading_line, md5(array_to_string(CASE WHEN h.h IS NULL THEN ls ELSE ls[:h.h - 1] END, chr(10))) AS body,
  CASE WHEN h.h IS NOT NULL THEN md5(array_to_string(ls[h.h + 1:], chr(10))) END AS bibliography FROM arr LEFT JOIN h USING (doc_id)
""")
def t03_bibliography_split(spark: SparkSession, d: str) -> DataFrame:
    s = segment.split_bibliography(table(spark, d, "documents").select("doc_id", "text"))
    return s.select("doc_id", "heading_line", F.md5("body_text").alias("body"), F.md5("references_text").alias("bibliography"))


@query(f"""
WITH {_LINES}, h AS (SELECT doc_id, max(line_no) FILTER (regexp_matches(line, {_HEAD})) AS h, min(line_no) FILTER (upper(regexp_replace(line, '^ +| +$', '', 'g')) = 'ABSTRACT') AS a FROM lin GROUP BY doc_id),
x AS (SELECT arr.doc_id, ls, coalesce(a, 1) AS a, h FROM arr LEFT JOIN h USING (doc_id))
SELECT doc_id, md5(array_to_string(ls[1:a - 1], chr(10))) AS front, md5(array_to_string(ls[a:coalesce(h, len(ls) + 1) - 1], chr(10))) AS body,
  CASE WHEN h IS NOT NULL THEN md5(array_to_string(ls[h + 1:], chr(10))) END AS bibliography FROM x
""")
def t18_front_body_references(spark: SparkSession, d: str) -> DataFrame:
    s = segment.front_body_references(table(spark, d, "documents").select("doc_id", "text"))
    return s.select("doc_id", F.md5("front").alias("front"), F.md5("body").alias("body"), F.md5("bibliography").alias("bibliography"))


@query("SELECT ledger_id, CASE WHEN n_pages > 0 THEN CAST(greatest(1, n_pages - greatest(1, CAST(floor(n_pages * 0.15) AS INT)) + 1) AS INT) END AS start_page FROM ledgers")
def t04_fallback_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledgers").select("ledger_id", segment.fallback_start(F.col("n_pages"), SETTINGS.fallback_share).alias("start_page"))


@query(f"""
WITH pg AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS page, len(p) AS total, unnest(p) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10) || chr(10)) AS p FROM documents)),
sp AS (SELECT doc_id, page, regexp_split_to_array(text, {_NL}) AS p FROM pg),
ar AS (SELECT doc_id, page, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS ls FROM sp),
ln AS (SELECT doc_id, page, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM ar),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, n) AS k FROM ln),
h AS (SELECT doc_id, max(k) AS h FROM nb WHERE regexp_matches(line, {_HEAD}) GROUP BY doc_id),
f AS (SELECT doc_id, any_value(total) AS total, max(page) FILTER (regexp_matches(text, '[^\\s\\x0b]')) AS full_page FROM pg GROUP BY doc_id),
st AS (SELECT f.doc_id, h.h, CASE WHEN full_page IS NULL THEN NULL WHEN h.h IS NOT NULL THEN nb.page ELSE least(total - greatest(1, CAST(floor(total * 0.15) AS INT)) + 1, full_page) END AS start
  FROM f LEFT JOIN h USING (doc_id) LEFT JOIN nb ON nb.doc_id = f.doc_id AND nb.k = h.h),
pa AS (SELECT nb.doc_id, page, n, line, CASE WHEN h IS NOT NULL THEN CASE WHEN k < h THEN 'b' WHEN k > h THEN 'r' END WHEN page < start THEN 'b' ELSE 'r' END AS part FROM nb JOIN st USING (doc_id) WHERE start IS NOT NULL),
ch AS (SELECT doc_id, part, page, string_agg(line, chr(10) ORDER BY n) AS c FROM pa WHERE part IS NOT NULL GROUP BY ALL),
tx AS (SELECT doc_id, string_agg(c, chr(10) || chr(10) ORDER BY page) FILTER (part = 'b') AS b, string_agg(c, chr(10) || chr(10) ORDER BY page) FILTER (part = 'r') AS r FROM ch GROUP BY doc_id)
SELECT st.doc_id, CAST(st.start AS INT) AS ref_start_page, md5(coalesce(b, '')) AS body, md5(coalesce(r, '')) AS bibliography FROM st LEFT JOIN tx USING (doc_id)
""")
def t02_page_split(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose blank lines part pages, split into body and bibliography."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n\n").alias("pages"))
    s = segment.split_pages(docs, "pages", SETTINGS.fallback_share)
    return s.select("doc_id", "ref_start_page", F.md5("body_text").alias("body"), F.md5("references_text").alias("bibliography"))


@query(f"""
WITH {_LINES}, m AS (SELECT *, regexp_replace(trim(line), '\\d+', '#', 'g') AS mask FROM lin WHERE NOT regexp_full_match(trim(line), '\\d{{1,4}}')),
often AS (SELECT doc_id, mask FROM m WHERE length(trim(line)) >= 30 GROUP BY doc_id, mask HAVING count(*) >= 3)
SELECT doc_id, count(*) AS kept FROM m ANTI JOIN often USING (doc_id, mask) GROUP BY doc_id
""")
def t07_page_furniture(spark: SparkSession, d: str) -> DataFrame:
    n = segment.numbered_lines(table(spark, d, "documents"))
    kept = segment.without_furniture(n, "doc_id", SETTINGS.furniture_min_length, SETTINGS.furniture_repeats)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query()
def t09_entries(spark: SparkSession, d: str) -> DataFrame:
    """A fold with a search in its last entry; tests hold it against a plain loop."""
    return segment.entries(segment.split_bibliography(table(spark, d, "documents").select("doc_id", "text")))


@query("""
WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])\\s+([A-Z(\\["''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sentence FROM f)
SELECT doc_id, count(*) AS sentences, CAST(max(length(sentence)) AS INT) AS longest FROM s WHERE sentence <> '' GROUP BY doc_id
""")
def t13_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.explode(segment.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.length("sentence")).alias("longest"))


def _numbers_sql(source: str, key: str) -> str:
    return f"""
g AS (SELECT {key}, unnest(regexp_extract_all({source}, '\\[(\\d[\\d\\s,;–—-]*)\\]', 1)) AS grp FROM src),
p AS (SELECT {key}, trim(regexp_replace(unnest(regexp_split_to_array(grp, '[,;]')), '\\s+', ' ', 'g')) AS part FROM g),
q AS (SELECT {key}, part, TRY_CAST(regexp_extract(part, '^(\\d{{1,3}}) ?[-–—] ?(\\d{{1,3}})$', 1) AS INT) AS a,
  TRY_CAST(regexp_extract(part, '^(\\d{{1,3}}) ?[-–—] ?(\\d{{1,3}})$', 2) AS INT) AS b FROM p),
num AS (SELECT DISTINCT {key}, unnest(CASE WHEN regexp_full_match(part, '\\d{{1,9}}') THEN [CAST(part AS INT)]
  WHEN a > 0 AND a <= b AND b - a < 100 THEN CAST(range(a, b + 1) AS INT[]) ELSE CAST([] AS INT[]) END) AS number FROM q)
"""


@query("WITH src AS (SELECT row_id, text FROM ledger_claims), " + _numbers_sql("text", "row_id") + "SELECT row_id, number FROM num")
def t15_citation_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger_claims").select("row_id", F.explode(segment.marker_numbers(F.col("text"))).alias("number"))


_CLAIMS = f"""
WITH {_LINES}, h AS (SELECT doc_id, max(line_no) AS h FROM lin WHERE regexp_matches(line, {_HEAD}) GROUP BY doc_id),
b AS (SELECT arr.doc_id, ledger_id, trim(regexp_replace(array_to_string(CASE WHEN h.h IS NULL THEN ls ELSE ls[:h.h - 1] END, chr(10)), '\\s+', ' ', 'g')) AS t
  FROM arr LEFT JOIN h USING (doc_id) WHERE ledger_id IS NOT NULL AND coalesce(section, '') <> 'references'),
s AS (SELECT doc_id, ledger_id, string_split(regexp_replace(t, '([.!?])\\s+([A-Z(\\["''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM b),
src AS (SELECT doc_id, ledger_id, unnest(range(1, len(ss) + 1)) AS sentence_no, unnest(ss) AS sentence FROM s),
{_numbers_sql('sentence', 'doc_id, ledger_id, sentence_no')},
refs AS (SELECT ledger_id, CAST(regexp_extract(ref_id, '^R0*(\\d{{1,9}})$', 1) AS INT) AS number, min(ref_id) AS ref_id FROM bib_refs
  WHERE deleted_at IS NULL AND regexp_full_match(ref_id, 'R0*\\d{{1,9}}') GROUP BY ALL)
"""


@query(_CLAIMS + "SELECT doc_id, CAST(sentence_no AS INT) AS sentence_no, number, ref_id FROM num JOIN refs USING (ledger_id, number)")
def t16_claims(spark: SparkSession, d: str) -> DataFrame:
    docs = segment.split_bibliography(table(spark, d, "documents").select("doc_id", "ledger_id", "section", "text"))
    return segment.claims(docs, state.usable(table(spark, d, "bib_refs")))


@query(_CLAIMS.rstrip() + """
, ids AS (SELECT doc_id, ledger_id, sentence_no, list_sort(list_distinct(list(ref_id))) AS ids FROM num JOIN refs USING (ledger_id, number) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_no) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM ids)
SELECT k.doc_id, 'C' || lpad(CAST(n AS VARCHAR), CASE WHEN total >= 100 THEN 3 ELSE 2 END, '0') AS claim_id, page, md5(sentence) AS text, array_to_string(ids, ',') AS ref_ids
FROM k JOIN src USING (doc_id, sentence_no) JOIN documents USING (doc_id)
""")
def t12_claim_records(spark: SparkSession, d: str) -> DataFrame:
    docs = segment.split_bibliography(table(spark, d, "documents").select("doc_id", "ledger_id", "section", "page", "text"))
    c = segment.claim_records(docs, state.usable(table(spark, d, "bib_refs")))
    return c.select("doc_id", "claim_id", "page", F.md5("text").alias("text"), F.array_join(F.array_sort("ref_ids"), ",").alias("ref_ids"))


@query("""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '(^|[^0-9.])([0-9]+(?:\\.[0-9]+)+ [A-Z])', '\\1' || chr(1) || '\\2', 'g'), '(• )', chr(1) || '\\1', 'g'), chr(1)),
  lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '') AS p FROM f)
SELECT doc_id, len(p) AS paragraphs, CAST(list_max(list_transform(p, lambda x: length(x))) AS INT) AS longest FROM s
""")
def t21_reflow(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", segment.reflow(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.array_max(F.transform("p", F.length)).alias("longest"))


@query(f"""
WITH {_LINES}, t AS (SELECT doc_id, lower(regexp_replace(ls[1], '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS head FROM arr),
x AS (SELECT doc_id, regexp_replace(line, '^ +| +$', '', 'g') AS line, regexp_replace(lower(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), '^\\d{{1,4}}', '') AS bare FROM lin)
SELECT doc_id, count(*) AS kept FROM x JOIN t USING (doc_id) WHERE NOT regexp_full_match(line, '\\d{{1,4}}') AND NOT coalesce(length(head) > 0 AND starts_with(bare, head), false) GROUP BY doc_id
""")
def t17_running_heads(spark: SparkSession, d: str) -> DataFrame:
    """Lines left when those that begin with a passage's first line, its title, are gone."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    titles = docs.select("doc_id", F.try_element_at(segment.lines(F.col("text")), F.lit(1)).alias("title"))
    return segment.without_running_heads(segment.numbered_lines(docs), titles).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""
WITH {_LINES} SELECT doc_id, median(length(trim(line))) AS median_length FROM lin WHERE trim(line) <> '' GROUP BY doc_id
""")
def a09_median_line(spark: SparkSession, d: str) -> DataFrame:
    n = segment.numbered_lines(table(spark, d, "documents")).filter(F.trim("line") != "")
    return n.groupBy("doc_id").agg(F.median(F.length(F.trim("line"))).alias("median_length"))


@query("""
WITH n AS (SELECT DISTINCT ledger_id, TRY_CAST(regexp_extract(ref_id, '^R0*(\\d{1,9})$', 1) AS INT) AS n FROM bib_refs),
k AS (SELECT ledger_id, n, row_number() OVER (PARTITION BY ledger_id ORDER BY n) AS r FROM n WHERE n > 0)
SELECT ledger_id, count(*) AS entries, CAST(coalesce(max(n) FILTER (n = r), 0) AS INT) AS contiguous FROM k GROUP BY ledger_id
""")
def t19_contiguous_numbers(spark: SparkSession, d: str) -> DataFrame:
    number = F.nullif(F.regexp_extract("ref_id", r"^R0*(\d{1,9})$", 1), F.lit("")).cast("int")
    return segment.contiguous_prefix(table(spark, d, "bib_refs").select("ledger_id", number.alias("n")), "ledger_id", "n")


@query("""
WITH b AS (SELECT row_id, text, regexp_extract_all(text, '\\[(\\d[\\d\\s,;–—-]*)\\]', 0) AS marks FROM ledger_claims WHERE text IS NOT NULL)
SELECT row_id, text, len(marks) AS brackets FROM b WHERE len(marks) = 0
UNION ALL
SELECT row_id, replace(text, marks[1], new) AS text, 1 AS brackets FROM (
  SELECT row_id, text, marks, '[' || array_to_string(list_transform(list_sort(list_distinct(list_transform(string_split(marks[1][2:-2], ','), lambda x: 100 + CAST(trim(x) AS INT)))), lambda n: CAST(n AS VARCHAR)), ', ') || ']' AS new
  FROM b WHERE len(marks) = 1 AND regexp_full_match(marks[1], '\\[\\d+(\\s*,\\s*\\d+)*\\]'))
""")
def t20_remapped_markers(spark: SparkSession, d: str) -> DataFrame:
    """Every bracket's numbers moved by a hundred. The SQL knows brackets of plain numbers, which these claims have."""
    c = table(spark, d, "ledger_claims").filter(F.col("text").isNotNull())
    moved = segment.remapped_markers(F.col("text"), lambda n: n + 100)
    brackets = F.size(F.regexp_extract_all("text", F.lit(segment.MARKER), F.lit(0))).cast("long")
    return c.select("row_id", moved.alias("text"), brackets.alias("brackets"))


_MARKED_SQL = f"regexp_replace(text, '\\[\\d[\\d\\s,;–—-]*\\]', '{repair.DELETED}', 'g')"
_TIDY_SQL = _MARKED_SQL
for _pattern, _new in repair._TIDY:
    _TIDY_SQL = f"regexp_replace({_TIDY_SQL}, '{_pattern}', '{_new.replace('$', chr(92))}', 'g')"


@query(f"SELECT row_id, CASE WHEN contains({_MARKED_SQL}, '{repair.DELETED}') THEN {_TIDY_SQL} ELSE text END AS text FROM ledger_claims")
def m18_tidied_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims without their citation brackets."""
    bare = F.regexp_replace("text", segment.MARKER, repair.DELETED)
    return table(spark, d, "ledger_claims").select("row_id", repair.tidy_punctuation(bare).alias("text"))


@query()
def m17_repaired_references(spark: SparkSession, d: str) -> DataFrame:
    """Look-ahead and composition have no SQL form; tests hold the three repairs to known answers."""
    raw = repair.compose_accents(F.col("raw_text"))
    return table(spark, d, "bib_refs").select("row_id", repair.repair_doi(repair.dehyphenate(raw)).alias("repaired"))


@query("""
SELECT source_table, CAST(date_trunc('day', arrived_at) AS TIMESTAMP) AS day, count(*) AS n, count(deleted_at) AS deleted FROM (
  SELECT 'bib_refs' AS source_table, arrived_at, deleted_at FROM bib_refs UNION ALL SELECT 'ledger_claims', arrived_at, deleted_at FROM ledger_claims) GROUP BY ALL
""")
def w01_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Both tables read as streams, written by a checkpointed query and counted per day of arrival."""
    parts = []
    for name in ("bib_refs", "ledger_claims"):
        rows = arrivals.run_available(arrivals.table_stream(spark, d, name).select("arrived_at", "deleted_at"), f"arrivals-{name}")
        parts.append(rows.withColumn("source_table", F.lit(name)))
    return parts[0].unionByName(parts[1]).groupBy("source_table", F.date_trunc("day", "arrived_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count("deleted_at").alias("deleted"))


@query("""
WITH named AS (
  SELECT 'ledger_claims' AS source_table, ledger_id, unnest(list_distinct(ref_ids)) AS target_key FROM ledger_claims WHERE deleted_at IS NULL
  UNION ALL SELECT 'bib_refs', ledger_id, unnest(list_distinct(cited_by_claims)) FROM bib_refs WHERE deleted_at IS NULL
), n AS (SELECT source_table, ledger_id, target_key, count(*) AS refs FROM named WHERE target_key IS NOT NULL GROUP BY ALL),
x AS (
  SELECT 'ledger_claims' AS source_table, ledger_id, ref_id AS target_key, count(*) AS inserted, count(*) FILTER (deleted_at IS NULL) AS existing FROM bib_refs GROUP BY ALL
  UNION ALL SELECT 'bib_refs', ledger_id, claim_id, count(*), count(*) FILTER (deleted_at IS NULL) FROM ledger_claims GROUP BY ALL
)
SELECT n.source_table, n.ledger_id, n.target_key, refs, coalesce(inserted, 0) AS inserted FROM n LEFT JOIN x USING (source_table, ledger_id, target_key) WHERE coalesce(existing, 0) = 0
""")
def w02_orphan_state(spark: SparkSession, d: str) -> DataFrame:
    """Keys without a usable record after the stream of changes has been folded batch by batch."""
    deltas = orphans.change_deltas(table(spark, d, "ledger_claims"), table(spark, d, "bib_refs"))
    feed = spark.readStream.schema(deltas.schema).option("maxFilesPerTrigger", 4).parquet(arrivals.in_slices(deltas, "happened_at", 4, "orphan-changes"))
    state_now = orphans.key_state(arrivals.run_fold(feed))
    return state_now.filter((F.col("refs") > 0) & (F.col("existing") == 0)).select("source_table", "ledger_id", "target_key", "refs", "inserted")
