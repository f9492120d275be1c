import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import tokens

PATH = os.path.join(tokens.TOKENIZER_DIR, tokens.RANK_FILE)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_and_defined_cases(spark):
    texts = ["Hello world", "", None, "a" * 100_000, "x " * 50_000, " \n\t  ", "日本 𝕏 é\u0000", "<|endoftext|>", "Hello world"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: list(r.ids) for r in tokens.token_ids(df).collect()}
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert rows[1] == rows[2] == [] and rows[0] == rows[8]
    assert counts == {k: len(v) for k, v in rows.items()}
    whole = tokens.encoder(PATH)
    assert all(rows[i] == whole.encode_ordinary(t) for i, t in enumerate(texts) if t)
    ids = tokens.token_ids(df)
    back = {r.doc_id: r.t for r in ids.select("doc_id", tokens.decoded_text(ids["ids"]).alias("t")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert tokens.token_ids(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200), st.integers(1, 40))
def test_pieces_do_not_change_ids(text, size):
    cut = tokens.pieces(text, size)
    assert "".join(cut) == text
    whole = tokens.encoder(PATH)
    assert [i for p in cut for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text)


def test_same_ids_as_another_library(other):
    for t in ("It's 12 o'clock.", "  two  spaces\n\nnew", "naïve — “quoted” 中文", "x" * 3000):
        assert tokens.encode(t, PATH) == other.encode(t, add_special_tokens=False).ids
