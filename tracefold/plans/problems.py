"""Queries of the general problems: orphan references and shredded replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.operators import orphans, shred
from tracefold.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "ledger_claims"), table(spark, d, "bib_refs"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "ledger_claims"), table(spark, d, "bib_refs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.work_leaves(shred.shred(table(spark, d, "crossref_raw")))


def p3_works(spark: SparkSession, d: str) -> DataFrame:
    return shred.work_table(shred.shred(table(spark, d, "crossref_raw"))).drop("work_node")


def p3_authors(spark: SparkSession, d: str) -> DataFrame:
    return shred.author_table(shred.shred(table(spark, d, "crossref_raw"))).drop("work_node")


def p3_references(spark: SparkSession, d: str) -> DataFrame:
    return shred.reference_table(shred.shred(table(spark, d, "crossref_raw"))).drop("work_node")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_works, p3_authors, p3_references)}

_ORPHANS = """
WITH naming AS (
  SELECT 'ledger_claims' AS source_table, row_id, ledger_id, arrived_at, unnest(list_distinct(ref_ids)) AS target_key
  FROM ledger_claims WHERE deleted_at IS NULL
  UNION ALL
  SELECT 'bib_refs', row_id, ledger_id, arrived_at, unnest(list_distinct(cited_by_claims))
  FROM bib_refs WHERE deleted_at IS NULL
), existing AS (
  SELECT 'ledger_claims' AS source_table, ledger_id, ref_id AS target_key,
         count(*) FILTER (deleted_at IS NULL) AS live, min(arrived_at) FILTER (deleted_at IS NULL) AS first_live
  FROM bib_refs GROUP BY ALL
  UNION ALL
  SELECT 'bib_refs', ledger_id, claim_id, count(*) FILTER (deleted_at IS NULL), min(arrived_at) FILTER (deleted_at IS NULL)
  FROM ledger_claims GROUP BY ALL
), cases AS (
  SELECT n.source_table, n.row_id, n.target_key,
         CASE WHEN e.live IS NULL THEN 'missing' WHEN e.live = 0 THEN 'deleted'
              WHEN e.first_live > n.arrived_at THEN 'late' END AS kind,
         strftime(n.arrived_at, '%Y-%m') AS period
  FROM naming n LEFT JOIN existing e
    ON n.source_table = e.source_table AND n.ledger_id = e.ledger_id AND n.target_key = e.target_key
  WHERE n.target_key IS NOT NULL
)
"""

#: The works of all replies; items are taken where they are objects, and a message's own fields where it has no items.
_WORKS = """
WITH replies AS (
  SELECT raw_id, CAST(payload AS JSON) AS j FROM crossref_raw
  WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'
), messages AS (
  SELECT raw_id, CASE
    WHEN NOT list_contains(json_keys(j), 'message') THEN j
    WHEN json_type(j, '$.message') = 'OBJECT' THEN json_extract(j, '$.message')
    WHEN json_type(j, '$.message') = 'VARCHAR' AND json_valid(json_extract_string(j, '$.message'))
      THEN CAST(json_extract_string(j, '$.message') AS JSON) END AS m,
    list_contains(json_keys(j), 'message') AS wrapped
  FROM replies
), works AS (
  SELECT raw_id, 0 AS item_pos, m AS w FROM messages
  WHERE json_type(m) = 'OBJECT' AND NOT (wrapped AND list_contains(json_keys(m), 'items'))
  UNION ALL
  SELECT raw_id, CAST(unnest(range(CAST(json_array_length(m, '$.items') AS BIGINT))) AS INT), unnest(CAST(json_extract(m, '$.items') AS JSON[]))
  FROM messages WHERE json_type(m) = 'OBJECT' AND wrapped AND json_type(m, '$.items') = 'ARRAY'
)
"""


def _value(of: str, label: str) -> str:
    """A scalar under a label as text."""
    path = f"$.\"{label}\""
    return f"CASE WHEN json_type({of}, '{path}') NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN json_extract_string({of}, '{path}') END"


def _listed(label: str, columns: dict[str, str]) -> str:
    return _WORKS + f"""
, lists AS (SELECT raw_id, item_pos, json_extract(w, '$.{label}') AS l FROM works WHERE json_type(w) = 'OBJECT' AND json_type(w, '$.{label}') IN ('ARRAY', 'OBJECT')),
each AS (SELECT raw_id, item_pos, CASE WHEN json_type(l) = 'ARRAY' THEN CAST(l AS JSON[]) ELSE [l] END AS es FROM lists),
one AS (SELECT raw_id, item_pos, CAST(unnest(range(len(es))) AS INT) AS pos, unnest(es) AS e FROM each)
SELECT raw_id, item_pos, pos, {", ".join(f"{_value('e', k)} AS {v}" for k, v in columns.items())}
FROM one WHERE json_type(e) = 'OBJECT'"""


SQL = {
    "p1_found": _ORPHANS + "SELECT source_table, row_id, target_key, kind, period FROM cases WHERE kind IS NOT NULL",
    "p1_report": _ORPHANS
    + "SELECT source_table, period, kind, count(*) AS n FROM cases WHERE kind IS NOT NULL GROUP BY source_table, period, kind",
    "p3_found": """
WITH replies AS (
  SELECT raw_id, CAST(payload AS JSON) AS j FROM crossref_raw
  WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'
), messages AS (
  SELECT raw_id, CASE
    WHEN NOT list_contains(json_keys(j), 'message') THEN j
    WHEN json_type(j, '$.message') = 'OBJECT' THEN json_extract(j, '$.message')
    WHEN json_type(j, '$.message') = 'VARCHAR' AND json_valid(json_extract_string(j, '$.message'))
      THEN CAST(json_extract_string(j, '$.message') AS JSON) END AS m,
    list_contains(json_keys(j), 'message') AS wrapped
  FROM replies
), works AS (
  SELECT raw_id, 0 AS item_pos, m AS w FROM messages
  WHERE json_type(m) = 'OBJECT' AND NOT (wrapped AND list_contains(json_keys(m), 'items'))
  UNION ALL
  SELECT raw_id, CAST(unnest(range(CAST(json_array_length(m, '$.items') AS BIGINT))) AS INT), unnest(CAST(json_extract(m, '$.items') AS JSON[]))
  FROM messages WHERE json_type(m) = 'OBJECT' AND wrapped AND json_type(m, '$.items') = 'ARRAY'
), lists AS (
  SELECT raw_id, item_pos, 'indexed.date-parts' AS field, json_extract(w, '$.indexed."date-parts"') AS l FROM works
  UNION ALL SELECT raw_id, item_pos, 'license.URL', json_extract(w, '$.license') FROM works
  UNION ALL SELECT raw_id, item_pos, 'content-domain.domain', json_extract(w, '$."content-domain".domain') FROM works
), wrapped AS (
  SELECT raw_id, item_pos, field, CASE
    WHEN field = 'indexed.date-parts' AND NOT (json_type(l) = 'ARRAY'
      AND len(list_filter(CAST(l AS JSON[]), lambda x: json_type(x) = 'ARRAY')) > 0) THEN [l]
    WHEN json_type(l) = 'ARRAY' THEN CAST(l AS JSON[]) ELSE [l] END AS outside
  FROM lists WHERE l IS NOT NULL AND json_type(l) <> 'NULL'
), outer_places AS (
  SELECT raw_id, item_pos, field, unnest(range(len(outside))) AS pos1, unnest(outside) AS e FROM wrapped
), inner_places AS (
  SELECT raw_id, item_pos, field, pos1, CASE
    WHEN field = 'license.URL' THEN [json_extract(e, '$.URL')]
    WHEN json_type(e) = 'ARRAY' THEN CAST(e AS JSON[]) ELSE [e] END AS inside
  FROM outer_places
), leaves AS (
  SELECT raw_id, item_pos, field, pos1, unnest(range(len(inside))) AS pos2, unnest(inside) AS v FROM inner_places
)
SELECT raw_id, CAST(item_pos AS INT) AS item_pos, field, CAST(pos1 AS INT) AS pos1, CAST(pos2 AS INT) AS pos2,
       json_extract_string(v, '$') AS value
FROM leaves WHERE v IS NOT NULL AND json_type(v) NOT IN ('NULL', 'OBJECT', 'ARRAY')
""",
    "p3_works": _WORKS
    + "SELECT raw_id, item_pos, "
    + ", ".join(f"{_value('w', k)} AS {v}" for k, v in {"DOI": "doi", "type": "type", "publisher": "publisher", "issue": "issue", "volume": "volume"}.items())
    + " FROM works WHERE json_type(w) = 'OBJECT'",
    "p3_authors": _listed("author", {"given": "given", "family": "family", "name": "name", "sequence": "sequence"}),
    "p3_references": _listed("reference", {"key": "key", "DOI": "doi", "year": "year", "unstructured": "unstructured"}),
}
