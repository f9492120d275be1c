"""Records equal but for white space, letter case, punctuation and the order of their fields.

Each record becomes a multiset of (field name, normalised value) pairs. Every pair is hashed by itself, and a record's
fingerprint is the sum of its pairs' hashes under two seeds, so neither the order of the fields nor that of parts
without a label matters and nothing is sorted. Records are grouped by the two sums alone, which costs two numbers per
record; the values of records that share their sums with another are then compared with those of the group's first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.skew import SHARE, spread_join
from tracefold.llm.reference_parts import LABELLED, VenueFinder, letters, parts_of
from tracefold.session import written

#: Venue names are shipped to every task; a table beyond this bound isn't one of venues.
MAX_VENUES = 20_000
#: Sums of hashes are taken modulo a power of two, so that no number of pairs overflows.
_MASK = (1 << 62) - 1
#: Letters of the pieces by which texts that may begin anywhere are hashed.
PIECE = 8


def venue_names(venues: DataFrame) -> list[str]:
    rows = venues.select("name", "abbreviation").limit(MAX_VENUES + 1).collect()
    if len(rows) > MAX_VENUES:
        raise ValueError(f"more than {MAX_VENUES} venues")
    return [x for r in rows for x in r if x]


def reference_fields(refs: DataFrame, venues: list[str], key: str = "row_id") -> DataFrame:
    """(row_id, title_key, texts, ring, year, ...) of each reference. texts are the parts without a label, in the order
    they are printed; `ring` tells that nothing says where its one text begins."""
    names = ["row_id", "title_key", "texts", "ring", *LABELLED]
    kinds = {"row_id": pa.int64(), "texts": pa.list_(pa.string()), "ring": pa.bool_()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = VenueFinder(venues)
        for batch in it:
            rows = []
            for row_id, raw, title, authors in zip(*(c.to_pylist() for c in batch.columns)):
                found, *rest = parts_of(raw, title, authors, finder)
                # With no title, nothing tells for certain where the authors end.
                ring = title is None and len(found) < 3
                rows.append((row_id, None if title is None else letters(title), ["".join(found)] if ring else found, ring, *rest))
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return refs.select(F.col(key).cast("long").alias("row_id"), "raw_text", "title", "authors").mapInArrow(
        run, "row_id long, title_key string, texts array<string>, ring boolean, " + ", ".join(f"`{n}` string" for n in LABELLED)
    )


def _hash(*values: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*values), 4)


def multiset_hash(pairs: dict[str, Column], seed: str = "") -> Column:
    """Sum of the hashes of (name, value) pairs: commutative. An array counts as one pair per element."""
    total = None
    for name, value in pairs.items():
        # A null value is a pair of its own, other than the empty one.
        h = _hash(F.lit(seed + name), value.isNull(), F.coalesce(value, F.lit("")))
        total = h if total is None else (total + h).bitwiseAND(F.lit(_MASK))
    return total


def elements_hash(values: Column, name: str) -> Column:
    """Sum of the hashes of an array's elements, whatever their order."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: (acc + _hash(F.lit(name), v)).bitwiseAND(F.lit(_MASK)))


def ring_hash(text: Column, name: str) -> Column:
    """Sum of the hashes of the pieces of a text whose end meets its beginning: the same wherever it begins."""
    ring = F.concat(text, F.substring(F.repeat(text, PIECE), 1, PIECE))
    at = F.sequence(F.lit(1), F.length(text))
    pieces = F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: (acc + _hash(F.lit(name), F.substring(ring, i, F.lit(PIECE)))).bitwiseAND(F.lit(_MASK)))
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(pieces) + F.length(text)


def fingerprinted(fields: DataFrame) -> DataFrame:
    def total(seed: str) -> Column:
        pairs = {n: F.col(n) for n in ("title_key", *LABELLED)}
        texts = F.when(F.col("ring"), ring_hash(F.col("texts")[0], seed + "ring")).otherwise(elements_hash(F.col("texts"), seed + "text"))
        return (multiset_hash(pairs, seed) + texts.bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MASK))

    return fields.withColumns({"print_a": total(""), "print_b": total("b/")})


PRINTS = ["print_a", "print_b"]
VALUES = ["title_key", "texts", "ring", *LABELLED]


def _same_texts(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements, each as often."""
    often = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: often(a, x) == often(b, x))


def _equal(r: str, s: str) -> Column:
    """Whether the values of two records are the same: fields by name, texts without order, rings from any beginning."""
    mine, first = (lambda n: F.col(f"{r}{n}")), (lambda n: F.col(f"{s}{n}"))
    a, b = mine("texts"), first("texts")
    turned = (F.length(a[0]) == F.length(b[0])) & F.contains(F.concat(a[0], a[0]), b[0])
    on = (mine("ring") == first("ring")) & F.when(mine("ring"), turned).otherwise(_same_texts(a, b))
    for n in ("title_key", *LABELLED):
        on = on & mine(n).eqNullSafe(first(n))
    return on


def copies_of(fields: DataFrame, share: int = SHARE) -> DataFrame:
    """(first_row_id, row_id) of every record that isn't the first of its set. `fields`, with prints, is read twice:
    store it first."""
    sets = fields.groupBy(*PRINTS).agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("n"))
    sets = written(sets.filter(F.col("n") > 1).withColumn("members", F.col("n")), "sets")
    members = written(spread_join(fields, sets, PRINTS, "n", "row_id", share), "members-of-sets")
    first = members.filter(F.col("row_id") == F.col("first_row_id")).dropDuplicates(PRINTS)
    first = first.select(*PRINTS, F.col("members").alias("n"), *(F.col(v).alias(f"first_{v}") for v in VALUES))
    others = members.filter(F.col("row_id") != F.col("first_row_id")).drop("members")
    same = spread_join(others, first, PRINTS, "n", "row_id", share).filter(_equal("", "first_"))
    return same.select("first_row_id", "row_id").distinct()


def printed_fields(refs: DataFrame, venues: DataFrame) -> DataFrame:
    return written(fingerprinted(reference_fields(refs, venue_names(venues))), "reference-fields")


def reference_copies(refs: DataFrame, venues: DataFrame) -> DataFrame:
    """(first_row_id, row_id): rows whose raw_text has the same parts and whose titles agree or are both null.

    Parts are told by their labels and shapes, the venue by the table of venues, the title and the authors by the
    row's own columns; with no title to tell, author list and title count as one ring of letters. Null and empty
    raw_text are equal; a null title differs from an empty one. Row ids are taken as given: rows with the same id
    are one. Texts of any length are read whole.
    """
    return copies_of(printed_fields(refs, venues))


def reference_records(refs: DataFrame, venues: DataFrame) -> DataFrame:
    """One row per distinct printed reference: first_row_id and number of copies, itself among them."""
    fields = printed_fields(refs, venues)
    copies = written(copies_of(fields), "copies")
    counts = copies.groupBy("first_row_id").agg(F.count(F.lit(1)).alias("more"))
    firsts = fields.select("row_id").distinct().join(copies.select("row_id"), "row_id", "left_anti").withColumnRenamed("row_id", "first_row_id")
    return firsts.join(counts, "first_row_id", "left").select("first_row_id", (1 + F.coalesce("more", F.lit(0))).alias("copies"))
