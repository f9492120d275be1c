"""Nested JSON replies into flat tables with parent-child links, by way of an adjacency table.

The adjacency table has one row per JSON node: the reply, the node, its parent, the label under which the
parent holds it (an element of a list has the list's), its ordinal in a list, its kind and, of scalars, the text. Entity tables come from joins of
object nodes with their children. Node numbers count in document order within a reply, so (reply, node) is a
key and every join runs on (reply, parent); the replies are spread by id, and a reply never needs another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.session import written

NODE_SCHEMA = "raw_id long, node int, parent int, label string, ordinal int, kind string, scalar string"
_ARROW = pa.schema(
    [
        ("raw_id", pa.int64()),
        ("node", pa.int32()),
        ("parent", pa.int32()),
        ("label", pa.string()),
        ("ordinal", pa.int32()),
        ("kind", pa.string()),
        ("scalar", pa.string()),
    ]
)
#: Nodes per Arrow batch.
BATCH_NODES = 50_000


def _refuse(word: str) -> None:
    raise ValueError(word)


def _parse(text: str) -> object:
    """Strict JSON; numbers stay as they are printed, marked by a one-tuple."""
    return json.loads(text, parse_int=lambda x: (x,), parse_float=lambda x: (x,), parse_constant=_refuse)


def _text(value: object) -> str | None:
    if value is None:
        return None
    if value is True or value is False:
        return "true" if value else "false"
    text = value[0] if isinstance(value, tuple) else value
    return text.encode("utf-8", "replace").decode() if isinstance(text, str) else None


def nodes_of(payload: str | None, embedded: str = "message") -> list[tuple]:
    """The nodes of one reply; none unless it is a valid JSON object. A string under `embedded` at the top that
    is itself a JSON object is entered like one."""
    if not payload:
        return []
    try:
        root = _parse(payload)
        if not isinstance(root, dict):
            return []
        if isinstance(root.get(embedded), str):
            try:
                inner = _parse(root[embedded])
            except (ValueError, RecursionError):
                inner = None
            if isinstance(inner, dict):
                root[embedded] = inner
    except (ValueError, RecursionError):
        return []
    out: list[tuple] = []
    stack = [(None, None, None, root)]
    while stack:
        parent, label, ordinal, value = stack.pop()
        node = len(out)
        if isinstance(value, dict):
            out.append((node, parent, label, ordinal, "object", None))
            stack += [(node, k.encode("utf-8", "replace").decode(), None, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            out.append((node, parent, label, ordinal, "array", None))
            stack += [(node, label, i, v) for i, v in reversed(list(enumerate(value)))]
        else:
            out.append((node, parent, label, ordinal, "null" if value is None else "scalar", _text(value)))
    return out


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in it:
        for raw_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += [(raw_id, *n) for n in nodes_of(payload)]
            if len(rows) >= BATCH_NODES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def adjacency(raw: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """The adjacency table of all replies. Null, empty, invalid and non-object payloads give no node."""
    return (
        raw.select(F.col(key).cast("long").alias("raw_id"), F.col(payload).alias("payload"))
        .filter(F.col("payload").isNotNull())
        .mapInArrow(_batches, NODE_SCHEMA)
    )


def _side(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """The nodes under the labels, lists' elements among them, as children by reply and parent: what a step reads and
    shuffles."""
    return nodes.filter(F.col("label").isin(labels)).select(
        "raw_id", F.col("parent").alias("at"), F.col("node").alias("child"), F.col("label").alias("c_label"), F.col("ordinal").alias("c_ordinal"),
        F.col("kind").alias("c_kind"), F.col("scalar").alias("c_scalar"),
    )


def _step(frontier: DataFrame, nodes: DataFrame, labels: list[str], go: Column, want: Column, keep: bool = False) -> DataFrame:
    """Takes the rows of the frontier for which `go` holds to their children under the label `want`, or to the elements
    of a list where `want` is null; the other rows stay where they are. Rows without such a child are let go unless
    `keep`. `labels` are all that can be met. `ordinal` is the child's place, null for rows that stayed. One chain of joins
    comes of it, no branch."""
    f = frontier.withColumns({"go": F.coalesce(go, F.lit(False)), "want": want.cast("string")}).alias("f")
    held = F.col("c.c_ordinal").isNull() & (F.col("c.c_label") == F.col("f.want"))
    wanted = F.col("f.go") & F.when(F.col("f.want").isNull(), F.col("c.c_ordinal").isNotNull()).otherwise(held)
    on = (F.col("f.raw_id") == F.col("c.raw_id")) & (F.col("f.at") == F.col("c.at")) & wanted
    rest = [c for c in frontier.columns if c not in ("raw_id", "at", "kind", "scalar", "ordinal")]
    joined = f.join(_side(nodes, labels).alias("c"), on, "left")
    if not keep:
        joined = joined.filter(F.col("c.child").isNotNull() | ~F.col("f.go"))
    moved = lambda new, old: F.when(F.col("f.go"), F.col(new)).otherwise(F.col(old)).alias(old.removeprefix("f."))
    return joined.select(
        "f.raw_id", F.coalesce("c.child", "f.at").alias("at"), moved("c.c_kind", "f.kind"), moved("c.c_scalar", "f.scalar"), F.col("c.c_ordinal").alias("ordinal"),
        *(F.col(f"f.{c}").alias(c) for c in rest),
    )


def works(nodes: DataFrame) -> DataFrame:
    """(raw_id, item_pos, at, kind, scalar): the work is the message, or each element of its items, or the whole reply
    where there is no message. A null or other non-object work holds nothing."""
    always, kind = F.lit(True), F.col("kind")
    roots = nodes.filter(F.col("parent").isNull()).select("raw_id", F.col("node").alias("at"), "kind", "scalar")
    top = _step(roots, nodes, ["message"], always, F.lit("message"), keep=True).withColumn("wrapped", kind.isNotNull()).filter(~F.col("wrapped") | (kind == "object"))
    # Only a message can hold items.
    items = _step(top, nodes, ["items"], F.col("wrapped"), F.lit("items"), keep=True)
    each = _step(items, nodes, ["items"], kind == "array", F.lit(None)).filter(kind.isNull() | (kind == "object"))
    return each.select("raw_id", F.coalesce("ordinal", F.lit(0)).alias("item_pos"), "at", F.lit("object").alias("kind"), F.lit(None).cast("string").alias("scalar"))


def _elements(lists: DataFrame, nodes: DataFrame, label: str, place: str) -> DataFrame:
    """The elements of list nodes with their place; a single value in place of a list is its only element."""
    return _step(lists, nodes, [label], F.col("kind") == "array", F.lit(None)).withColumn(place, F.coalesce("ordinal", F.lit(0)))


#: The lists of a work whose leaves are told: under which label of which part they are.
_LISTS = {"indexed": "date-parts", "content-domain": "domain", "license": "URL"}


def work_leaves(nodes: DataFrame) -> DataFrame:
    """The non-null leaves of `indexed.date-parts`, `license.URL` and `content-domain.domain` of each work, with
    their places. A flat date-parts list has outer place 0.

    The three kinds of leaves go down together, one join per level; only licences are lists above their label.
    """
    part, kind = F.col("part"), F.col("kind")
    licence = part == "license"
    label = F.element_at(F.create_map(*(F.lit(x) for kv in _LISTS.items() for x in kv)), part)
    parts = works(nodes).withColumn("part", F.explode(F.array(*(F.lit(k) for k in _LISTS))))
    held = _step(parts, nodes, list(_LISTS), F.lit(True), part).filter(F.when(licence, kind.isin("object", "array")).otherwise(kind == "object"))
    # Elements of licence lists, and what other parts hold under their label; then the licences' URL, and the others'
    # elements; then elements of lists within, which domains don't have.
    first = _step(held, nodes, ["license", "date-parts", "domain"], ~licence | (kind == "array"), F.when(~licence, label)).withColumn("pos1", F.when(licence, F.coalesce("ordinal", F.lit(0))))
    second = _step(first.filter(~licence | (kind == "object")), nodes, ["URL", "date-parts", "domain"], licence | (kind == "array"), F.when(licence, label)).withColumn(
        "pos1", F.when(licence, F.col("pos1")).otherwise(F.coalesce("ordinal", F.lit(0)))
    )
    # Scalars beside lists count as lists of one; scalars alone are a flat list.
    mixed = F.max(kind == "array").over(Window.partitionBy("raw_id", "item_pos", "part"))
    second = second.withColumn("flat", (part == "indexed") & ~mixed)
    third = _step(second, nodes, ["URL", "date-parts"], (kind == "array") & (part != "content-domain"), F.lit(None))
    inner = F.coalesce(F.col("ordinal"), F.when(F.col("flat"), F.col("pos1")).otherwise(0))
    return third.filter(kind == "scalar").select(
        "raw_id", "item_pos", F.concat_ws(".", part, label).alias("field"), F.when(F.col("flat"), 0).otherwise(F.col("pos1")).alias("pos1"),
        inner.alias("pos2"), F.col("scalar").alias("value"),
    )


def entity_table(nodes: DataFrame, owners: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pivots the scalar children of owner nodes (raw_id, at, kind, scalar, any columns to keep) into one row per owner.
    columns: JSON label to column name. Owners without any of them keep a row of nulls."""
    keep = [c for c in owners.columns if c not in ("raw_id", "at", "kind", "scalar")]
    wanted = owners.withColumn("owner", F.col("at")).withColumn("label", F.explode(F.array(*(F.lit(k) for k in columns))))
    kids = _step(wanted, nodes, list(columns), F.lit(True), F.col("label"), keep=True)
    value = F.when(F.col("kind") == "scalar", F.col("scalar"))
    return kids.groupBy("raw_id", F.col("owner").alias("at"), *keep).agg(*(F.max(F.when(F.col("label") == k, value)).alias(v) for k, v in columns.items()))


def shred(raw: DataFrame) -> DataFrame:
    """Adjacency table of the replies, written once to the shared folder for the joins that follow."""
    return written(adjacency(raw), "adjacency")


def work_table(nodes: DataFrame) -> DataFrame:
    """One row per work: its reply, place, node, identifier, kind and publisher."""
    return entity_table(
        nodes, works(nodes), {"DOI": "doi", "type": "type", "publisher": "publisher", "issue": "issue", "volume": "volume"}
    ).withColumnRenamed("at", "work_node")


def _listed(nodes: DataFrame, label: str) -> DataFrame:
    """The objects listed under a label of each work, with their place."""
    lists = _step(works(nodes).withColumn("work_node", F.col("at")), nodes, [label], F.lit(True), F.lit(label))
    return _elements(lists, nodes, label, "pos").filter(F.col("kind") == "object").drop("ordinal")


def author_table(nodes: DataFrame) -> DataFrame:
    """One row per author object of a work, with its place in the list and the link to its work."""
    return entity_table(nodes, _listed(nodes, "author"), {"given": "given", "family": "family", "name": "name", "sequence": "sequence"}).drop("at")


def reference_table(nodes: DataFrame) -> DataFrame:
    """One row per cited reference of a work, with its place in the list and the link to its work."""
    return entity_table(nodes, _listed(nodes, "reference"), {"key": "key", "DOI": "doi", "year": "year", "unstructured": "unstructured"}).drop("at")
