"""Text into lines, sentences, bibliography entries and citation markers, as expressions of one row.

A document's lines are an array of its row, so segmenting needs no shuffle; only the repeat counts of page furniture
group lines, by document and masked line. The split into entries, whose markers are found one after the other, is
a small function over Arrow batches.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.functions.normalize import mask_digits

# Line ends that count as such anywhere, headings, markers.
NEWLINE = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
HEADING = r"(?i)^\s*((\d+|[ivxlc]+)\.?\s*)?(references|bibliography|works cited|literature cited)\.?\s*$"
BRACKETED = r"^\s*\[(\d{1,3})\]\s+\S"
NUMBERED = r"^\s*(\d{1,3})[.)]\s+\S"
MARKER = r"\[(\d[\d\s,;–—-]*)\]"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z(\[\"'])"


def lines(text: Column) -> Column:
    """Array of lines; a line end at the very end opens no further line; null gives none."""
    parts = F.split(F.coalesce(text, F.lit("")), NEWLINE)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def last_heading(ls: Column) -> Column:
    """Place of the last heading line, counted from 1; null without one."""
    places = F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(HEADING), i + 1)), lambda p: p.isNotNull())
    return F.array_max(places)


def split_bibliography(docs: DataFrame) -> DataFrame:
    """Adds heading_line, body_text and references_text: the lines before and after the last heading, which is in
    neither. Without a heading everything is body and references_text is null."""
    d = docs.withColumn("_lines", lines(F.col("text")))
    d = d.withColumn("heading_line", last_heading(F.col("_lines")))
    n, h = F.size("_lines"), F.col("heading_line")
    body = F.slice("_lines", F.lit(1), F.coalesce(h - 1, n))
    refs = F.slice("_lines", F.coalesce(h, F.lit(0)) + 1, n)
    return d.withColumns({"body_text": F.array_join(body, "\n"), "references_text": F.when(h.isNotNull(), F.array_join(refs, "\n"))}).drop("_lines")


def front_body_references(docs: DataFrame) -> DataFrame:
    """Adds front, body and bibliography: the lines before the first that says ABSTRACT, from there to the last heading,
    and after it. Without that line the front is empty, without a heading the body goes on to the end."""
    d = docs.withColumn("_lines", lines(F.col("text"))).withColumn("_h", last_heading(F.col("_lines")))
    places = F.filter(F.transform("_lines", lambda x, i: F.when(F.upper(F.trim(x)) == "ABSTRACT", i + 1)), lambda p: p.isNotNull())
    d = d.withColumn("_a", F.array_min(places))
    n, start = F.size("_lines"), F.coalesce(F.col("_a"), F.lit(1))
    end = F.coalesce(F.col("_h"), n + 1)
    part = lambda a, b: F.array_join(F.slice("_lines", a, F.greatest(F.lit(0), b)), "\n")
    return d.withColumns(
        {"front": part(F.lit(1), start - 1), "body": part(start, end - start), "bibliography": F.when(F.col("_h").isNotNull(), part(end + 1, n - end))}
    ).drop("_lines", "_h", "_a")


def fallback_start(n_pages: Column, share: float) -> Column:
    """First page of the tail that stands in for a bibliography without a heading; null without pages."""
    tail = F.greatest(F.lit(1), F.floor(n_pages * F.lit(share)).cast("int"))
    return F.when(n_pages > 0, F.greatest(F.lit(1), n_pages - tail + 1))


def page_text(pages: Column) -> Column:
    """All pages as one text, a blank line between them."""
    return F.array_join(pages, "\n\n")


def _joined(ls: Column) -> Column:
    """Lines (page, line) as text: line ends within a page, a blank line between pages; pages without lines add none."""
    before = lambda x, i: F.when(i == 0, "").when(x["page"] == F.element_at(ls, i)["page"], "\n").otherwise("\n\n")
    return F.array_join(F.transform(ls, lambda x, i: F.concat(before(x, i), x["line"])), "")


def split_pages(docs: DataFrame, pages: str = "pages", share: float = 0.15) -> DataFrame:
    """Adds body_text, references_text, ref_start_page and notes to documents given as arrays of pages, within the row.

    The last heading line splits, and is in neither part. Without one, the last `share` of the pages, one at least, is
    the bibliography, widened backwards until it holds text. A document without any text has two empty parts and no
    page. Null arrays count as empty."""
    own = F.coalesce(pages, F.array().cast("array<string>"))
    d = docs.withColumn("_pages", F.transform(own, lambda p: F.coalesce(p, F.lit(""))))
    with_page = F.transform("_pages", lambda p, i: F.transform(lines(p), lambda x: F.struct((i + 1).alias("page"), x.alias("line"))))
    d = d.withColumn("_ls", F.flatten(with_page))
    heads = F.filter(F.transform("_ls", lambda x, i: F.when(x["line"].rlike(HEADING), i + 1)), lambda p: p.isNotNull())
    full = F.filter(F.transform("_pages", lambda p, i: F.when(p.rlike(r"\S"), i + 1)), lambda p: p.isNotNull())
    d = d.withColumns({"_heads": heads, "_last": F.array_max(full), "_total": F.size("_pages")})
    d = d.withColumn("_h", F.array_max("_heads"))
    tail = F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(share)).cast("int"))
    wanted = F.col("_total") - tail + 1
    blank, h, n = F.col("_last").isNull(), F.col("_h"), F.size("_ls")
    fallen = F.least(wanted, F.col("_last"))
    d = d.withColumn("ref_start_page", F.when(blank, F.lit(None).cast("int")).when(h.isNotNull(), F.try_element_at("_ls", h)["page"]).otherwise(fallen))
    start = F.col("ref_start_page")
    body = F.when(h.isNotNull(), F.slice("_ls", F.lit(1), h - 1)).otherwise(F.filter("_ls", lambda x: x["page"] < start))
    refs = F.when(h.isNotNull(), F.slice("_ls", h + 1, n)).otherwise(F.filter("_ls", lambda x: x["page"] >= start))
    d = d.withColumns({"_body": body, "_refs": refs})
    text = lambda c: F.when(blank, "").otherwise(_joined(F.col(c)))
    d = d.withColumns({"body_text": text("_body"), "references_text": text("_refs")})
    empty = ~F.col("references_text").rlike(r"\S")
    notes = [
        (blank, "no text on any page"), (~blank & (F.size("_heads") > 1), "several headings, split at the last"), (~blank & h.isNotNull() & empty, "nothing behind the heading"),
        (~blank & h.isNull(), "no heading, last pages taken"), (~blank & h.isNull() & (fallen < wanted), "last pages blank, widened"), (~blank & h.isNull() & (F.col("_total") == 1), "a single page, all of it taken"),
    ]
    d = d.withColumn("notes", F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in notes))))
    return d.drop("_pages", "_ls", "_heads", "_last", "_total", "_h", "_body", "_refs")


def bibliography_pages(pages: Column, start: Column) -> Column:
    """The pages from the bibliography's first on; none without one."""
    return F.when(start.isNull(), F.array().cast("array<string>")).otherwise(F.slice(pages, start, F.size(pages)))


def numbered_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line), line numbers from 1."""
    return docs.select(key, F.posexplode(lines(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def without_furniture(numbered: DataFrame, key: str = "doc_id", least: int = 30, repeats: int = 3) -> DataFrame:
    """Lines without page numbers of one to four digits and without long lines whose form, digits masked, occurs
    `repeats` times or more in the document. Blank lines stay."""
    bare = F.trim("line")
    n = numbered.filter(~bare.rlike(r"^\d{1,4}$")).withColumn("mask", mask_digits(bare))
    often = (
        n.filter(F.length(bare) >= least).groupBy(key, "mask").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= repeats).select(key, "mask", F.lit(True).alias("often"))
    )
    return n.join(often, [key, "mask"], "left").filter(F.col("often").isNull()).drop("mask", "often")


def _last_entry(span: list[str]) -> list[str]:
    """The lines of the last entry: up to a blank run that no line of 30 letters or more follows, and up to a tail
    whose lines have a median length under 5."""
    kept = len(span)
    for i, line in enumerate(span):
        if not line.strip():
            follows = next((x for x in span[i:] if x.strip()), "")
            if len(follows.strip()) < 30:
                kept = i
                break
    sizes: list[int] = []
    cut = kept
    for k in range(kept - 1, 0, -1):
        if n := len(span[k].strip()):
            insort(sizes, n)
        if sizes and (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2 < 5:
            cut = k
    return span[:cut]


def _rejoin(pieces: list[str]) -> str:
    """Lines as one text: a hyphen at a line's end goes, unless a digit stands before it; no blank follows either."""
    out = ""
    for p in filter(None, map(str.strip, pieces)):
        if out.endswith("-"):
            out = out + p if out[-2:-1].isdigit() else out[:-1] + p
        else:
            out = f"{out} {p}" if out else p
    return out


def split_entries(text: str | None) -> tuple[str, list[str]]:
    """(style, entries): by the first marker style of which the numbers 1, 2, ... are found in turn, twice or more; a
    line with another number belongs to the entry before it. Without markers, blank lines part the entries."""
    ls = re.split(NEWLINE, text or "")
    for style, pattern in (("bracketed", BRACKETED), ("numbered", NUMBERED)):
        starts: list[int] = []
        for i, line in enumerate(ls):
            m = re.match(pattern, line)
            if m and int(m.group(1)) == len(starts) + 1:
                starts.append(i)
        if len(starts) >= 2:
            spans = [ls[a:b] for a, b in zip(starts, [*starts[1:], len(ls)])]
            spans[-1] = _last_entry(spans[-1])
            return style, [e for e in map(_rejoin, spans) if e]
    blocks = re.split(r"\n\s*\n", "\n".join(ls))
    return "blank-line", [e for e in (_rejoin(b.split("\n")) for b in blocks) if e]


def entries(bibliographies: DataFrame, key: str = "doc_id", text: str = "references_text") -> DataFrame:
    """(key, style, position, ref_id, raw_text): the entries of each bibliography. A null bibliography has none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [split_entries(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string()))], names=["key", "style", "raw"]
            )

    split = bibliographies.filter(F.col(text).isNotNull()).select(F.col(key).cast("long"), text).mapInArrow(run, "key long, style string, raw array<string>")
    return split.select(F.col("key").alias(key), "style", F.size("raw").alias("total"), F.posexplode("raw").alias("at", "raw_text")).select(
        key, "style", (F.col("at") + 1).alias("position"), numbered_id("R", F.col("at") + 1, F.col("total")).alias("ref_id"), "raw_text"
    )


def numbered_id(letter: str, position: Column, total: Column) -> Column:
    """R01 ... R99, or R001 ... in a document of a hundred or more."""
    return F.when(total >= 100, F.format_string(letter + "%03d", position)).otherwise(F.format_string(letter + "%02d", position))


def sentences(text: Column) -> Column:
    """White space collapsed, then cut where a sentence mark, a blank and an opening meet."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.split(flat, SENTENCE_END), lambda s: s != "")


def marker_numbers(text: Column) -> Column:
    """Distinct reference numbers cited in a text, in first-seen order: "1, 3-5" is 1, 3, 4, 5. A range that runs
    backwards, starts at 0, has more than three digits or spans a hundred or more gives nothing, nor do numbers with
    blanks alone between them."""
    dash = "[-–—]"
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda g: F.split(g, "[,;]")))

    def numbers(part: Column) -> Column:
        p = F.trim(F.regexp_replace(part, r"\s+", " "))
        a = F.regexp_extract(p, rf"^(\d{{1,3}}) ?{dash} ?(\d{{1,3}})$", 1)
        b = F.regexp_extract(p, rf"^(\d{{1,3}}) ?{dash} ?(\d{{1,3}})$", 2)
        none = F.array().cast("array<int>")
        low, high = F.nullif(a, F.lit("")).cast("int"), F.nullif(b, F.lit("")).cast("int")
        good = (low > 0) & (low <= high) & (high - low < 100)
        return (
            F.when(p.rlike(r"^\d{1,9}$"), F.array(F.when(p.rlike(r"^\d{1,9}$"), p.cast("int"))))
            .when(good, F.sequence(F.when(good, low).otherwise(1), F.when(good, high).otherwise(1)))
            .otherwise(none)
        )

    return F.array_distinct(F.flatten(F.transform(parts, numbers)))


def claims(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, number, ref_id): sentences of a ledger's passages that cite a reference of the ledger by
    its number. A number without a reference is ignored; passages of a bibliography make no claims."""
    s = (
        docs.filter(F.col("ledger_id").isNotNull() & ~F.coalesce(F.col("section") == "references", F.lit(False)))
        .select("doc_id", "ledger_id", F.posexplode(sentences(F.col("body_text"))).alias("at", "sentence"))
        .select("doc_id", "ledger_id", (F.col("at") + 1).alias("sentence_no"), F.explode(marker_numbers(F.col("sentence"))).alias("number"))
    )
    return s.join(reference_numbers(refs), ["ledger_id", "number"]).select("doc_id", "sentence_no", "number", "ref_id")


def claim_records(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, ledger_id, claim_id, page, text, ref_ids): one row per sentence of a passage's body that cites references
    of its ledger, with the distinct ids in first-seen order. Claims are numbered C01 ... within the passage, or C001 ...
    where there are a hundred or more."""
    s = docs.filter(F.col("ledger_id").isNotNull() & ~F.coalesce(F.col("section") == "references", F.lit(False))).select(
        "doc_id", "ledger_id", "page", F.posexplode(sentences(F.col("body_text"))).alias("at", "text")
    )
    asked = s.select("doc_id", "ledger_id", "at", F.posexplode(marker_numbers(F.col("text"))).alias("pos", "number"))
    cited = asked.join(reference_numbers(refs), ["ledger_id", "number"])
    # A sentence's own ids: as many as it prints.
    ids = cited.groupBy("doc_id", "at").agg(F.array_sort(F.collect_list(F.struct("pos", "ref_id"))).alias("ids"))
    found = s.join(ids, ["doc_id", "at"])
    own = Window.partitionBy("doc_id")
    numbered = found.withColumns({"n": F.row_number().over(own.orderBy("at")), "total": F.count(F.lit(1)).over(own)})
    return numbered.select(
        "doc_id", "ledger_id", numbered_id("C", F.col("n"), F.col("total")).alias("claim_id"), "page", "text",
        F.array_distinct(F.transform("ids", lambda x: x["ref_id"])).alias("ref_ids"),
    )


def reference_numbers(refs: DataFrame) -> DataFrame:
    """(ledger_id, number, ref_id): the reference that a printed number means."""
    numbered = refs.select("ledger_id", "ref_id", F.nullif(F.regexp_extract("ref_id", r"^R0*(\d{1,9})$", 1), F.lit("")).cast("int").alias("number"))
    return numbered.filter(F.col("number").isNotNull()).groupBy("ledger_id", "number").agg(F.min("ref_id").alias("ref_id"))


def reflow(text: Column) -> Column:
    """Paragraphs of a text that lost its breaks: cut before dotted section numbers with a capital behind, and bullets."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.split(flat, r"(?<![\d.])(?=\d+(?:\.\d+)+ [A-Z])|(?=• )")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def remapped_markers(text: Column, new_number) -> Column:
    """The text with the numbers of every citation bracket replaced by new_number(number), sorted and without
    repeats; numbers that become null are dropped, and a bracket that loses all of them disappears."""
    marks = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))

    def renewed(mark: Column) -> Column:
        numbers = F.transform(marker_numbers(mark), lambda n: new_number(n))
        kept = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))
        return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(F.transform(kept, lambda n: n.cast("string")), ", "), F.lit("]"))).otherwise("")

    pieces = F.split(text, MARKER)
    return F.array_join(F.zip_with(pieces, F.transform(marks, renewed), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def contiguous_prefix(numbered: DataFrame, key: str, number: str) -> DataFrame:
    """(key, entries, contiguous): how many distinct numbers a key has, and up to which they run from 1 without a gap.
    The first gap is found by an anti-join of each number with its successor: nothing is sorted or listed."""
    n = numbered.select(key, F.col(number).alias("n")).filter(F.col("n") > 0).dropDuplicates()
    ends = n.join(n.select(key, (F.col("n") - 1).alias("n")), [key, "n"], "left_anti").groupBy(key).agg(F.min("n").alias("end"))
    total = n.groupBy(key).agg(F.count(F.lit(1)).alias("entries"), F.min("n").alias("first"))
    return total.join(ends, key).select(key, "entries", F.when(F.col("first") == 1, F.col("end")).otherwise(0).cast("int").alias("contiguous"))


def without_running_heads(numbered: DataFrame, titles: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that aren't the document's title, or begin with it, with or without a page number around it, nor a bare
    number. titles: (key, title), one row per document; without a title only bare numbers go."""
    squash = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    t = titles.select(key, squash(F.col("title")).alias("head"))
    line = squash(F.col("line"))
    is_head = (F.length("head") > 0) & F.startswith(F.regexp_replace(line, r"^\d{1,4}", ""), F.col("head"))
    return numbered.join(t, key, "left").filter(~F.trim("line").rlike(r"^\d{1,4}$") & ~F.coalesce(is_head, F.lit(False))).drop("head")
