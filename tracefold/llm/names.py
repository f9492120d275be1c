"""Variant spellings of the names of persons and organisations.

Distinct strings are parsed into family, given names and initials with the help of where their words stand in
all names. Families become vectors of character n-grams weighted by rarity; pairs of similar families come from
a sparse cosine join over an inverted index that only looks at the rarest n-grams of each vector, which is
exact for the threshold: every pair that reaches it counts, and no top-n is cut off. The cosine is a factor of
the similarity of two spellings; edit distance, given names, middle initials and the works they share are the
others. Spellings are grouped by average-linkage clustering, run as rounds of merging all pairs of clusters that
are each other's nearest: the dendrogram of average linkage, found by joins and sums only. A spelling that names
two authors, as works tell, also joins the second one's cluster if its mean similarity there reaches the threshold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.session import discard, written, written_in_lots

#: Least cosine of two families, least average similarity of two clusters.
FAMILY_COSINE = 0.4
LINKAGE = 0.5
#: A word found in at least this share of all names may be a given name; so there are at most the mean number
#: of words divided by it.
FREQUENT = 0.0005
#: Edges that one task can hold: rounds over no more than these run there.
LOCAL_EDGES = 200_000
#: Means of similarities are compared in whole units of one in so many.
UNITS = 1_000_000_000
_MASK = (1 << 64) - 1
#: Rows of one key that are paired with the others of that key in one task.
PART = 1024
#: Pairs of families met by an n-gram whose shuffle files are on disk at one time, and pairs of names.
LOT_PAIRS = 4_000_000
#: What families at the least cosine are worth, and what is left of it if more than slips part them.
LEAST_ALIKE = 0.8
UNLIKE = 0.1

# Short forms of given names, particles, decorations, words of organisations.
NICKNAMES = {
    n: full
    for full, ns in {
        "agnieszka": "aga", "alexander": "alex sasha", "andreas": "andi", "anna": "anya", "antonio": "tono toni", "bartholomew": "bart",
        "charlotte": "lottie", "christopher": "kit chris", "daniel": "dan", "dmitri": "dima", "dolores": "lola", "edward": "ed eddie",
        "ekaterina": "katya", "elizabeth": "liz beth betty", "francisco": "paco", "frederick": "fred", "friederike": "rike",
        "gabriela": "gabi", "guillaume": "guille", "henrietta": "etta", "isabella": "bella", "james": "jim", "jennifer": "jenny",
        "joanna": "jo", "johannes": "hannes", "john": "jack", "jose": "pepe", "katherine": "kate kathy", "leonard": "len",
        "margaret": "maggie peggy", "matthias": "matze", "maximilian": "max", "michael": "mike", "nicholas": "nick",
        "penelope": "penny", "richard": "dick rich", "robert": "bob rob", "rosalind": "roz", "samuel": "sam", "susanna": "sue susie",
        "theodore": "ted theo", "thomas": "tom", "tomasz": "tomek", "ulrike": "ulli", "vladimir": "volodya vova",
        "wilhelmina": "mina", "william": "bill will", "yevgenia": "zhenya",
    }.items()
    for n in ns.split()
}
PARTICLES = frozenset("da de del della der di do dos du la le van von den ten ter al el bin ibn st mac".split())
_GLUED = PARTICLES | {a + b for a in PARTICLES for b in PARTICLES}
_FULL = frozenset(NICKNAMES.values())
_DECORATION = re.compile(r"[,\s]+(?:ph\.?\s?d|m\.?d|jr|sr|iii|ii|msc|dr|prof)\b\.?|^(?:dr|prof|mr|mrs|ms)\.?\s+|[*†‡§¹²³]|<[^>]*>", re.I)
ORGANISATION = {
    "institute": "institute", "inst": "institute", "laboratory": "laboratory", "lab": "laboratory", "society": "society", "soc": "society",
    "foundation": "foundation", "found": "foundation", "fdn": "foundation", "centre": "centre", "center": "centre", "ctr": "centre", "collaboration": "collaboration",
    "collab": "collaboration", "consortium": "consortium", "university": "university", "univ": "university", "department": "department",
    "dept": "department", "agency": "agency", "network": "network", "council": "council", "committee": "committee", "association": "association",
}
_FILL = frozenset("the for f of and group on".split())
_ACRONYM = re.compile(r"\(([A-Z]{2,8})\)")


def bare(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L"))
    return "".join([c for c in t if not unicodedata.combining(c)])


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\s.]+", text) if w]


def _clean(word: str) -> str:
    return "".join(filter(str.isalnum, word)).casefold()


def _one_slip(a: str, b: str) -> bool:
    """Whether one letter more, less or other, or two neighbours swapped, make a of b."""
    if abs(len(a) - len(b)) > 1 or len(b) < 5:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2][::-1] == b[i : i + 2] and a[i + 2 :] == b[i + 2 :])


def roles(name: str) -> list[tuple[str, int]]:
    """(word, 1 after a comma, -1 before it): where the words of "Family, Given" stand."""
    text = _DECORATION.sub("", bare(name)).strip(" ,")
    left, comma, right = text.partition(",")
    if not comma or any(_clean(w) in ORGANISATION for w in _words(text)):
        return []
    return [(_clean(w), -1) for w in _words(left)] + [(_clean(w), 1) for w in _words(right)]


def parse_name(name: str, given: frozenset[str] = frozenset()) -> tuple[str, str, str, str, str]:
    """(kind, family, first, middle initials, rest): kind p for persons, o for organisations, a for a bare
    acronym. first is a given name in its full form or one letter; rest holds an organisation's other words."""
    text = _DECORATION.sub("", bare(name)).strip(" ,")
    if re.fullmatch(r"[A-Z]{3,8}", text):
        return "a", text.casefold(), "", "", ""
    plain = [_clean(w) for w in _words(_ACRONYM.sub(" ", text))]
    kinds = [ORGANISATION[w] for w in plain if w in ORGANISATION]
    if kinds:
        others = [w for w in plain if w not in ORGANISATION and w not in _FILL and w]
        return "o", others[0] if others else "", "", "", " ".join([kinds[0], *others[1:]])
    text = re.sub(r"\b[Aa][Ll]-(?=\w)", "", text)
    left, comma, right = text.partition(",")

    def strip(ws: list[str]) -> list[str]:
        return [w for w in ws if _clean(w) and _clean(w) not in PARTICLES]

    if comma:
        fam, rest = strip(_words(left)), strip(_words(right))
        family = "".join(map(_clean, fam))
        upper = left.isupper()
    else:
        ws = strip(_words(text))
        if not ws:
            return "p", "", "", "", ""
        full = [w for w in ws if len(_clean(w)) > 1]
        upper = text.isupper()
        tail = ws[-1]
        if len(ws) > 1 and tail.isupper() and (len(tail) == 1 or (len(tail) <= 3 and not upper)):
            at = len(ws) - 2
        elif len(ws) > 1 and len(_clean(ws[0])) == 1:
            at = len(ws) - 1
        else:
            unlike = [w for w in full if _clean(w) not in given and _clean(w) not in NICKNAMES and _clean(w) not in _FULL]
            if len(unlike) > 1:
                unlike = [w for w in unlike if not any(_one_slip(_clean(w), g) for g in given)] or unlike
            pick = unlike or full[-1:] or ws[-1:]
            best = max(pick, key=lambda w: (len(_clean(w)), ws.index(w)))
            at = len(ws) - 1 - ws[::-1].index(best)
        family, rest = _clean(ws[at]), ws[:at] + ws[at + 1 :]
    parts: list[str] = []
    for w in rest:
        c = _clean(w)
        # Initials printed together: "TE", "JHK".
        parts += list(c) if len(c) <= 3 and w.isupper() and len(c) > 1 and not (upper and len(c) == 3) else [c]
    first = NICKNAMES.get(parts[0], parts[0]) if parts else ""
    return "p", family, first, "".join(p[0] for p in parts[1:]), ""


def distinct_names(sources: DataFrame) -> DataFrame:
    """Each distinct string with its id; null, blank and "et al." are no names."""
    n = sources.select(F.explode("authors").alias("name")).filter(
        F.col("name").isNotNull() & (F.trim("name") != "") & ~F.lower(F.trim("name")).rlike(r"^et\.? al\.?$")
    )
    return n.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).withColumn("id", F.xxhash64("name"))


def given_names(names: DataFrame) -> frozenset[str]:
    """Frequent words that stand after the comma more often than before it. At most mean words / FREQUENT rows
    come to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [r for n in batch.column(0).to_pylist() for r in roles(n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["word", "side"])

    n = max(1, names.count())
    counts = names.select("name").mapInArrow(run, "word string, side int").groupBy("word").agg(
        F.sum(F.when(F.col("side") > 0, 1).otherwise(0)).alias("after"), F.sum(F.when(F.col("side") < 0, 1).otherwise(0)).alias("before")
    )
    rows = counts.filter((F.length("word") > 1) & (F.col("after") > F.col("before")) & (F.col("after") >= F.greatest(F.lit(3), F.lit(FREQUENT * n)))).collect()
    return frozenset(r.word for r in rows)


PARSED = "id long, name string, kind string, family string, first string, middle string, rest string, known boolean"


def parsed_names(names: DataFrame, given: frozenset[str]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = list(zip(*(parse_name(n, given) for n in batch.column(1).to_pylist()))) or [()] * 5
            known = pa.array([f in given or f in _FULL for f in parts[2]], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(p, pa.string()) for p in parts), known],
                names=["id", "name", "kind", "family", "first", "middle", "rest", "known"],
            )

    return (
        names.select("id", "name")
        .mapInArrow(run, PARSED)
        .withColumn("node", F.xxhash64("kind", "family", "first", "middle", "rest"))
    )


def _glued(long: Column, short: Column) -> Column:
    """Whether a family is another one with a particle or two printed to it."""
    return long.endswith(short) & F.substring(long, F.lit(1), F.length(long) - F.length(short)).isin(*sorted(_GLUED))


def within_keys(left: DataFrame, right: DataFrame, keys: list[str], part: int) -> DataFrame:
    """left joined with right on keys, null keys with none: a key with more than `part` rows of right is spread over
    as many tasks as it has parts, each of which has all of the key's left rows."""
    sizes = right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    lots = F.pmod(F.xxhash64(*right.columns, F.lit("lot")), "parts").cast("int")
    a = left.join(sizes, keys).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    b = right.join(sizes, keys).withColumn("lot", lots).drop("parts")
    return a.join(b, [*keys, "lot"]).drop("lot")


def in_lots(df: DataFrame, key: str, lots: int) -> list[DataFrame]:
    """df in as many parts by the hash of `key`."""
    of = F.pmod(F.xxhash64(key, F.lit("lot")), F.lit(lots))
    return [df.filter(of == i) for i in range(lots)] if lots > 1 else [df]


def lot_count(left: DataFrame, right: DataFrame, keys: list[str]) -> int:
    """Lots of left in which LOT_PAIRS of its pairs with right by these keys are met on the mean."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    pairs = count(left, "n").join(count(right, "m"), keys).agg(F.sum(F.col("n") * F.col("m")).alias("pairs")).first().pairs
    return math.ceil(max(1, pairs or 0) / LOT_PAIRS)


def family_links(families: DataFrame, least: float = FAMILY_COSINE, part: int = PART) -> DataFrame:
    """(fa, fb, cosine), each pair in both orders: families whose n-gram vectors have at least this cosine. The join is
    exact: of two vectors with that cosine, the n-grams that hold all but `least` squared of each one's length share
    one. Of the pairs so met, those go on whose shared n-grams, with all that may be left, can reach the cosine."""
    padded = F.concat(F.lit("^"), F.col("family"), F.lit("$"))
    grams = families.filter(F.length("family") > 0).select(
        "family", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("family")), lambda i: F.substring(padded, i, F.lit(3))))).alias("gram")
    )
    n = families.count()
    rarity = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    weighted = grams.join(rarity, "gram").withColumn("w", F.log(1 + F.lit(float(n)) / F.col("df")))
    vector = (
        weighted.groupBy("family")
        .agg(F.array_sort(F.collect_list(F.struct("df", "gram", "w"))).alias("grams"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        .select(
            F.xxhash64("family").alias("id"), "family", "norm",
            F.transform("grams", lambda g: F.struct(g["gram"].alias("gram"), (g["w"] / F.col("norm")).alias("w"))).alias("v"),
            F.transform("grams", lambda g: F.struct(F.xxhash64(g["gram"]).alias("gram"), (g["w"] * g["w"]).alias("square"))).alias("squares"),
        )
    )
    vector = written(vector, "family-vectors")
    # What is left after the prefix has a length below `least`, and with any unit vector a cosine below it.
    before = F.transform("v", lambda _, i: F.aggregate(F.slice("v", F.lit(1), i), F.lit(0.0), lambda acc, g: acc + g["w"] * g["w"]))
    inside = F.size(F.filter(before, lambda b: 1 - b >= least * least))
    left = F.aggregate(F.slice("v", inside + 1, F.size("v")), F.lit(0.0), lambda acc, g: acc + g["w"] * g["w"])
    prefix = vector.select("id", left.alias("left"), "norm", F.explode(F.slice("v", F.lit(1), inside)).alias("g"))
    prefix = written(prefix.select(F.xxhash64("g.gram").alias("gram"), "id", F.col("g.w").alias("w"), "left", "norm"), "family-prefixes")
    # Few bytes, many comparisons: a number of partitions that isn't merged by size keeps all cores at work.
    spark = families.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    side = lambda p, k: p.select("gram", *(F.col(c).alias(k if c == "id" else c + k) for c in ("id", "w", "left", "norm")))
    # Shared n-grams outside of either prefix lie behind the prefix that ends first. They weigh the same in both vectors
    # but for the norms, so they add at most what that prefix leaves of its vector's square, in the other's measure.
    reach = F.sum(F.col("wa") * F.col("wb")) + F.max(F.greatest(F.col("lefta") * F.col("norma") / F.col("normb"), F.col("leftb") * F.col("normb") / F.col("norma")))
    # An n-gram weighs the same in both vectors but for their lengths.
    dot = F.aggregate(F.array_intersect("sa", "sb"), F.lit(0.0), lambda acc, g: acc + g["square"])
    own = lambda v, k: v.select(F.col("id").alias(k), F.col("family").alias(f"f{k}"), F.col("norm").alias(f"n{k}"), F.col("squares").alias(f"s{k}"))

    def of_lot(first: DataFrame, vectors: DataFrame) -> DataFrame:
        met = within_keys(side(first, "a").repartition(parts, "gram"), side(prefix, "b").repartition(parts, "gram"), ["gram"], part).filter(F.col("a") < F.col("b"))
        pairs = met.groupBy("a", "b").agg(reach.alias("reach")).filter(F.col("reach") >= least - 1e-9).select("a", "b")
        return pairs.join(own(vectors, "a"), "a").join(own(vector, "b"), "b").select("fa", "fb", F.least(F.lit(1.0), dot / (F.col("na") * F.col("nb"))).alias("cosine"))

    lots = lot_count(prefix, prefix, ["gram"])
    scored = written_in_lots((of_lot(f, v) for f, v in zip(in_lots(prefix, "id", lots), in_lots(vector, "id", lots))), "family-cosines")
    discard(vector, prefix)
    scored = scored.filter(F.col("cosine") >= least)
    back = scored.select(F.col("fb").alias("fa"), F.col("fa").alias("fb"), "cosine")
    return scored.unionByName(back)


def works_of_nodes(sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """(node, work): the works that name a node, over works that at least two records describe: records with the same
    title of four words or more, half of which, at least, agree in an author's first letters. A title such as "letter
    to the editor", whose records agree in no author, names no work, however few or many they are."""
    key = F.trim(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", " "))
    records = sources.select("source_id", key.alias("work"), "authors").filter(F.size(F.split("work", " ")) >= 4)
    told = records.groupBy("work").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    named = (
        records.join(told.select("work"), "work", "left_semi")
        .select("source_id", F.xxhash64("work").alias("work"), F.explode("authors").alias("name"))
        .select("source_id", "work", F.xxhash64("name").alias("id"))
        .join(parsed.select("id", "node", F.substring("family", 1, 3).alias("start")), "id")
    )
    named = written(named.select("source_id", "work", "node", "start"), "named-works")
    agreed = named.groupBy("work", "start").agg(F.count_distinct("source_id").alias("of")).groupBy("work").agg(F.max("of").alias("most"))
    with_authors = named.groupBy("work").agg(F.count_distinct("source_id").alias("n"))
    works = agreed.join(with_authors, "work").filter(F.col("most") * 2 >= F.col("n")).select("work")
    entries = written(named.select("work", "node").distinct().join(works, "work", "left_semi"), "name-works")
    discard(named)
    return entries


def together(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(a, b, together): how many works name both nodes of each pair. Of each pair, the node with fewer works looks for
    them, so a work or node of any size costs its own pairs only."""
    counts = entries.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    sized = pairs.select("a", "b").join(counts.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    fewer = F.col("na") <= F.col("nb")
    looking = sized.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    shared = looking.join(entries, "node").select("a", "b", "work", F.col("other").alias("node")).join(entries, ["node", "work"], "left_semi")
    return shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))


def node_similarities(nodes: DataFrame, links: DataFrame, entries: DataFrame, part: int = PART) -> DataFrame:
    """(a, b, similarity, together) with a < b of all compatible nodes of the same or linked families."""
    near = links.unionByName(nodes.select(F.col("family").alias("fa"), F.col("family").alias("fb")).distinct().withColumn("cosine", F.lit(1.0)))
    info = nodes.withColumn("initial", F.substring("first", 1, 1)).drop("size")
    keys = ["family_y", "initial", "kind"]
    side = lambda k: info.select("initial", "kind", *(F.col(c).alias(f"{c}_{k}") for c in info.columns if c not in ("initial", "kind")))
    x = side("x").join(near.select(F.col("fa").alias("family_x"), F.col("fb").alias("family_y"), "cosine"), "family_x")
    x = written(x, "near-names")
    met = (within_keys(lot, side("y"), keys, part).filter(F.col("node_x") < F.col("node_y")) for lot in in_lots(x, "node_x", lot_count(x, side("y"), keys)))
    pairs = written_in_lots((_compared(m).filter(F.col("alone") + F.col("support") > 0) for m in met), "name-pairs")
    discard(x)
    both = together(pairs, entries)
    pairs = pairs.join(both, ["a", "b"], "left").fillna({"together": 0})
    similarity = F.least(F.lit(1.0), F.col("alone") + F.when(F.col("together") > 0, F.col("support")).otherwise(0.0))
    return pairs.select("a", "b", similarity.alias("similarity"), "together").filter(F.col("similarity") > 0)


def _compared(pairs: DataFrame) -> DataFrame:
    """(a, b, alone, support): the similarity of two nodes by themselves and what shared works add to it."""
    fx, fy, mx, my = (F.col(c) for c in ("first_x", "first_y", "middle_x", "middle_y"))
    full_x, full_y = F.length(fx) > 1, F.length(fy) > 1
    edit = F.levenshtein(fx, fy)
    typo = (edit <= 1) & (F.least(F.length(fx), F.length(fy)) >= 3) | (edit <= 2) & (F.least(F.length(fx), F.length(fy)) >= 6)
    # Two names that many people bear, such as Carl and Carla, are no slips of each other.
    typo = typo & ~(F.col("known_x") & F.col("known_y"))
    swapped = (edit == 2) & ~(F.col("known_x") & F.col("known_y")) & (F.array_sort(F.split(fx, "")) == F.array_sort(F.split(fy, "")))
    given = (
        F.when((F.length(fx) == 0) | (F.length(fy) == 0), 0.0)
        .when(full_x & full_y, F.when(fx == fy, 1.0).when(typo | swapped, 0.9).otherwise(0.0))
        .when(full_x | full_y, 0.65)
        .otherwise(F.when(fx == fy, 0.95).otherwise(0.0))
    )
    one_middle = (F.length(mx) == 0) != (F.length(my) == 0)
    middle = F.when(one_middle, 0.85).when((mx == my) | mx.startswith(my) | my.startswith(mx), 1.0).otherwise(0.0)
    # The cosine from its threshold to 1; families that more than a few slips part keep UNLIKE of it.
    fam_x, fam_y = F.col("family_x"), F.col("family_y")
    far = F.levenshtein(fam_x, fam_y)
    slips = (
        (far <= F.greatest(F.lit(2), F.least(F.lit(3), F.least(F.length(fam_x), F.length(fam_y)) / 3.5)))
        | ((far <= 4) & (F.array_sort(F.split(fam_x, "")) == F.array_sort(F.split(fam_y, ""))))  # letters swapped only
        | _glued(fam_x, fam_y)
        | _glued(fam_y, fam_x)
    )
    alike = F.lit(LEAST_ALIKE) + (1 - LEAST_ALIKE) * (F.col("cosine") - FAMILY_COSINE) / (1 - FAMILY_COSINE)
    alike = F.when(fam_x == fam_y, 1.0).otherwise(alike * F.when(slips, 1.0).otherwise(UNLIKE))
    person = alike * given * middle
    rx, ry = F.col("rest_x"), F.col("rest_y")
    rest = F.levenshtein(rx, ry)
    organisation = F.when(F.split(rx, " ")[0] != F.split(ry, " ")[0], 0.0).otherwise(
        F.when(rest <= F.greatest(F.lit(2), F.length(rx) / 10), alike * F.when(rest == 0, 1.0).otherwise(0.9)).otherwise(0.0)
    )
    return pairs.select(
        F.col("node_x").alias("a"), F.col("node_y").alias("b"),
        F.when(F.col("kind") == "p", person).when(F.col("kind") == "o", organisation).otherwise(0.0).alias("alone"),
        F.when((F.col("kind") == "p") & (given * middle > 0), 0.3).otherwise(0.0).alias("support"),
    )


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _draw(a: int, b: int) -> int:
    """xxhash64(a, b) of Spark."""
    seed = xxhash.xxh64_intdigest((a & _MASK).to_bytes(8, "little"), 42)
    return _signed(xxhash.xxh64_intdigest((b & _MASK).to_bytes(8, "little"), seed))


def merge_rounds(edges: list[tuple[int, int, float, float, float]], least: int) -> list[tuple[int, int]]:
    """(gone, into) of all rounds of average_linkage over (a, b, total, na, nb), in order. Only the neighbours of
    merged clusters look for their nearest again."""
    size: dict[int, float] = {}
    total: dict[int, dict[int, float]] = {}
    for a, b, t, na, nb in edges:
        size[a], size[b] = na, nb
        total.setdefault(a, {})[b] = t
        total.setdefault(b, {})[a] = t
    draw = lru_cache(1 << 20)(_draw)

    def nearest(x: int) -> tuple[int, int, int, int] | None:
        near = ((math.floor(t / (size[x] * size[y]) * UNITS + 0.5), min(x, y), max(x, y)) for y, t in total[x].items())
        return max(((m, draw(a, b), -a, -b) for m, a, b in near if m >= least), default=None)

    best = {x: nearest(x) for x in total}
    merges: list[tuple[int, int]] = []
    looked = set(best)
    while True:
        mutual = {c for x in looked if x in best and (c := best[x]) and best[-c[2]] == best[-c[3]]}
        if not mutual:
            return merges
        looked = set()
        for _, _, a, b in mutual:
            a, b = -a, -b
            merges.append((b, a))
            for y, t in total.pop(b).items():
                total[y].pop(b)
                if y != a:
                    total[a][y] = total[y][a] = total[a].get(y, 0.0) + t
            size[a] += size.pop(b)
            best.pop(b)
            looked |= {a, *total[a]}
        looked &= best.keys()
        for x in looked:
            best[x] = nearest(x)
        # A cluster that kept its nearest may have become the nearest of one that looked again.
        looked |= {y for x in looked if (c := best[x]) for y in (-c[2], -c[3])}


def _finished(state: DataFrame, least: int) -> DataFrame:
    """(gone, into): the rounds that are left, in one task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [e for batch in it for e in zip(*(c.to_pylist() for c in batch.columns))]
        merges = merge_rounds(edges, least)
        into = dict(merges)
        # Each node's last cluster.
        for gone, at in reversed(merges):
            into[gone] = into.get(at, at)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.int64()), pa.array(list(into.values()), pa.int64())], names=["gone", "into"])

    return state.select("a", "b", "total", "na", "nb").coalesce(1).mapInArrow(run, "gone long, into long")


def average_linkage(nodes: DataFrame, edges: DataFrame, least: float = LINKAGE, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, cluster): average-linkage clusters. nodes: (node, size); edges: (a, b, similarity) with a < b, pairs
    without an edge have similarity 0. Each round merges every pair of clusters that are each other's nearest
    above the threshold; such merges don't disturb each other in average linkage. Ties go by a hash of the pair, so
    that of a group of tied clusters about a quarter merges per round. Rounds go on until no such pair is left;
    each has one at least as long as any mean reaches the threshold.

    A cluster without a mean at the threshold never merges again, as means only fall, and its edges are let go.
    From `local` edges left on, one task goes on by the same rounds.
    """
    size = nodes.select("node", F.col("size").cast("double").alias("size"))
    state = edges.join(size.select(F.col("node").alias("a"), F.col("size").alias("na")), "a").join(
        size.select(F.col("node").alias("b"), F.col("size").alias("nb")), "b"
    ).select("a", "b", (F.col("similarity") * F.col("na") * F.col("nb")).alias("total"), "na", "nb")
    floor = math.floor(least * UNITS + 0.5)
    state = written(state, "linkage")
    into = nodes.select("node", F.col("node").alias("cluster"))
    moves: list[DataFrame] = []

    def moved_into(into: DataFrame, moves: list[DataFrame]) -> DataFrame:
        for m in moves:
            into = into.join(m.withColumnRenamed("gone", "cluster"), "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"))
        return into

    while True:
        # Whole numbers, so that equal means are equal whatever the order of the sums.
        near = state.withColumn("mean", F.floor(F.col("total") / (F.col("na") * F.col("nb")) * F.lit(float(UNITS)) + 0.5)).filter(F.col("mean") >= floor)
        choice = F.struct(F.col("mean"), F.xxhash64("a", "b").alias("draw"), F.col("a"), F.col("b"))
        best = written(
            near.select(F.col("a").alias("node"), choice.alias("c"))
            .unionByName(near.select(F.col("b").alias("node"), choice.alias("c")))
            .groupBy("node")
            .agg(F.max("c").alias("c")),
            "nearest",
        )
        live = state.join(best.select(F.col("node").alias("a")), "a", "left_semi").join(best.select(F.col("node").alias("b")), "b", "left_semi")
        last, state = state, written(live, "linkage")
        discard(last)
        if state.count() <= local:
            moves.append(written(_finished(state, floor), "merges"))
            discard(best, state)
            break
        mutual = best.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 2)
        merge = written(mutual.select(F.col("c.a").alias("into"), F.col("c.b").alias("gone")), "merges")
        discard(best)
        if merge.isEmpty():
            discard(state)
            break
        moves.append(merge)
        if len(moves) == 10:
            into, moves = written(moved_into(into, moves), "clusters-so-far"), []
        moved = lambda side: merge.select(F.col("gone").alias(side), F.col("into").alias(f"{side}_into"))
        named = state.join(moved("a"), "a", "left").join(moved("b"), "b", "left").select(
            F.coalesce("a_into", "a").alias("x"), F.coalesce("b_into", "b").alias("y"), "total", "na", "nb", "a", "b"
        )
        # Sizes of the merged clusters: the sum of both, read from any edge that still names them.
        sizes = written(
            state.select(F.col("a").alias("node"), F.col("na").alias("n")).unionByName(state.select(F.col("b").alias("node"), F.col("nb").alias("n"))).distinct()
            .join(moved("node"), "node", "left").groupBy(F.coalesce("node_into", "node").alias("node")).agg(F.sum("n").alias("n")),
            "sizes",
        )
        merged = (
            named.filter(F.col("x") != F.col("y"))
            .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .agg(F.sum("total").alias("total"))
            .join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
            .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
            .select("a", "b", "total", "na", "nb")
        )
        last, state = state, written(merged, "linkage")
        discard(last, sizes)
    return moved_into(into, moves)


def second_clusters(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, least: float) -> DataFrame:
    """(node, cluster) of nodes that name more than one author: a node that shares a work with a spelling at the
    threshold, yet lies in another cluster, also belongs to that one's cluster if its mean similarity with it, as
    average linkage takes it, reaches the threshold."""
    other = clusters.select(F.col("node").alias("b"), F.col("cluster").alias("at"))
    size = nodes.select("node", F.col("size").cast("double").alias("size"))
    whole = clusters.join(size, "node").groupBy(F.col("cluster").alias("at")).agg(F.sum("size").alias("whole"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "together"))
    near = (
        both.join(clusters.select(F.col("node").alias("a"), "cluster"), "a")
        .join(other, "b")
        .filter(F.col("cluster") != F.col("at"))
        .join(size.select(F.col("node").alias("b"), "size"), "b")
        .groupBy("a", "at")
        .agg(F.sum(F.col("similarity") * F.col("size")).alias("total"), F.max((F.col("together") > 0) & (F.col("similarity") >= least)).alias("told"))
        .filter("told")
    )
    return near.join(whole, "at").filter(F.col("total") / F.col("whole") >= least).select(F.col("a").alias("node"), F.col("at").alias("cluster"))


def name_memberships(sources: DataFrame, least: float = LINKAGE) -> tuple[DataFrame, DataFrame]:
    """(parsed names with node and cluster, further (node, cluster) of nodes that name several authors)."""
    names = written(distinct_names(sources), "names")
    parsed = written(parsed_names(names, given_names(names)), "parsed-names")
    nodes = parsed.groupBy("node", "kind", "family", "first", "middle", "rest", "known").agg(F.count(F.lit(1)).alias("size"))
    nodes = written(nodes, "name-nodes")
    links = family_links(nodes.select("family").distinct())
    entries = works_of_nodes(sources, parsed)
    edges = written(node_similarities(nodes, links, entries), "name-edges")
    clusters = written(average_linkage(nodes, edges.select("a", "b", "similarity"), least), "name-clusters")
    return parsed.join(clusters, "node"), second_clusters(nodes, edges, clusters, least)


def variant_pairs(sources: DataFrame, least: float = LINKAGE) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code points: different strings of one cluster.

    Strings are taken exactly as stored; null, blank and "et al." are no names, null author lists have none, and a
    string occurs once however often it is used. A string used for two authors is linked to the spellings of both
    if the works tell so. Names of any length are read whole.
    """
    members, second = name_memberships(sources, least)
    m = written(members.select("name", "node", "cluster"), "name-members")
    every = written(m.select("name", "cluster").unionByName(m.select("name", "node").join(second, "node").select("name", "cluster")), "name-memberships")
    a, b = every.select(F.col("name").alias("name_a"), "cluster"), every.select(F.col("name").alias("name_b"), "cluster")
    return a.join(b, "cluster").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()


def name_clusters(sources: DataFrame, least: float = LINKAGE) -> DataFrame:
    """(name, first_name, spellings): one row per distinct string with the least spelling of its cluster and the
    cluster's size."""
    members, _ = name_memberships(sources, least)
    m = written(members.select("name", "cluster"), "name-members")
    info = m.groupBy("cluster").agg(F.min("name").alias("first_name"), F.count(F.lit(1)).alias("spellings"))
    return m.join(info, "cluster").select("name", "first_name", "spellings")
