"""Token ids of a corpus under a public byte-level BPE vocabulary.

The rank file is local and only its path is shipped; each Python worker reads it once. Texts are pre-split
where no pre-token of the pattern can cross, so a piece of any length costs bounded memory, and the pieces'
ids joined are the ids of the whole text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Folder of the public vocabularies; a parameter of every function here.
TOKENIZER_DIR = os.environ.get("TRACEFOLD_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern published with the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in pieces of about so many characters.
PIECE_CHARS = 20_000
#: Before a single blank between two non-blanks; every alternative of the pattern ends there at the latest.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cuts at the first safe boundary after every `size` characters; without one the text stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode(text: str | None, path: str) -> list[int]:
    """Ids of a text. Null and empty texts have no ids. Lone surrogates are read as U+FFFD."""
    if not text:
        return []
    enc, ids = encoder(path), []
    for piece in pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def decode(ids: list[int], path: str) -> str:
    """Joins the raw bytes of all ids before decoding, since a character may be cut between two ids."""
    return b"".join(encoder(path).decode_tokens_bytes(list(ids))).decode("utf-8", "replace")


def _encoded(path: str, lengths: bool):
    out = pa.int32() if lengths else pa.list_(pa.int32())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column, keys = batch.column(batch.num_columns - 1), batch.columns[:-1]
            ids = [encode(t, path) for t in column.to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            if lengths:
                made = pa.array(sizes)
            else:
                flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if len(ids) else np.empty(0, np.int32)
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*keys, made.cast(out)], names=[*batch.schema.names[:-1], "made"])

    return run


def _path(folder: str, file: str) -> str:
    return os.path.join(folder, file)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, file: str = RANK_FILE) -> DataFrame:
    """(key, ids): one row per row of docs. Null and empty texts have an empty list, never null. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key), F.col(text))
        .mapInArrow(_encoded(_path(folder, file), False), f"`{key}` {kind}, made array<int>")
        .withColumnRenamed("made", "ids")
    )


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, file: str = RANK_FILE) -> DataFrame:
    """(key, n_tokens), as token_ids but without the ids."""
    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key), F.col(text))
        .mapInArrow(_encoded(_path(folder, file), True), f"`{key}` {kind}, made int")
        .withColumnRenamed("made", "n_tokens")
    )


def decoded_text(ids: Column, folder: str = TOKENIZER_DIR, file: str = RANK_FILE) -> Column:
    """The text of a list of ids; null for null."""
    path = _path(folder, file)

    @F.pandas_udf(StringType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else decode(x, path))

    return run(ids)
