from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tracefold.functions import normalize as N


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if k in ('a', 'b') else 'string'}" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize("doi", ["10.1/X", "https://doi.org/10.1/X", "HTTP://DX.DOI.ORG/10.1/x", "doi:10.1/X", " 10.1/x; "])
def test_doi_forms(spark, doi):
    assert one(spark, N.normalise_doi(F.col("d")), d=doi) == "10.1/x"


def test_null_stays_null(spark):
    assert one(spark, N.normalise_doi(F.col("d")), d=None) is None
    assert one(spark, N.normalise_text(F.col("d")), d=None) == ""
    assert one(spark, N.doi_match(F.col("d"), F.col("e")), d=None, e="10.1/x") is None
    assert one(spark, N.doi_match(F.col("d"), F.col("e")), d="", e="10.1/x") is None
    assert one(spark, N.doi_match(F.col("d"), F.col("e")), d="10.1/x", e="10.1.x") is True


@pytest.mark.parametrize("text,expected", [("Naïve  Ünïcode—Tests", "naive unicode tests"), ("ﬁne ß", "fine ss"), ("β-decay", "decay"), ("中文", ""), ("a" * 5000, "a" * 5000)])
def test_text_keys(spark, text, expected):
    assert one(spark, N.normalise_text(F.col("t")), t=text) == expected


@pytest.mark.parametrize("a,b,expected", [("deep learning", "Learning, deep!", 1.0), ("", "x", 0.0), (None, None, 0.0), ("Café au lait", "cafe AU LAIT", 1.0)])
def test_title_similarity_known(spark, a, b, expected):
    assert one(spark, N.title_similarity(N.normalise_text(F.col("p")), N.normalise_text(F.col("q"))), p=a, q=b) == expected


def test_title_similarity_equals_the_standard_library(spark):
    pairs = [("tide", "diet x"), ("a method for wards", "the method of warts"), ("x" * 220 + "ab", "x" * 219 + "cab"), ("one two", "two three four")]
    df = spark.createDataFrame(pairs, "p string, q string")
    got = [r.x for r in df.select(N.title_similarity(N.normalise_text(F.col("p")), N.normalise_text(F.col("q"))).alias("x")).collect()]
    key = lambda t: " ".join(sorted(t.split()))
    assert got == [round(SequenceMatcher(None, key(a), key(b)).ratio(), 4) for a, b in pairs]


@pytest.mark.parametrize("name,family", [("Ada Lovelace", "lovelace"), ("Lovelace, Ada", "lovelace"), ("Lovelace AB", "lovelace"), ("Plato", "plato"), ("Søren Åkesson", "akesson"), ("van Dyck, A.", "dyck"), ("Garcia-Lopez, Ana", "lopez"), ("Paul Erdős", "erdos"), ("Şahin", "sahin"), ("Jimmy Lei Ba", "ba"), ("Collins F.S.", "s"), ("Collins FS.", "collins"), ("Ana Garcia-Lopez", "lopez"), ("Garcia-Lopez AB", "garcia lopez"), ("Țepeș-Ionescu", "tepes ionescu"), ("  Lovelace, Ada ", "lovelace"), ("Ada Lovelace ", "lovelace")])
def test_surnames(spark, name, family):
    assert one(spark, N.surnames(F.col("a")), a=[name, None, "", "  "]) == [family]


def test_author_overlap(spark):
    overlap = N.author_overlap(N.surnames(F.col("a")), N.surnames(F.col("b")))
    assert one(spark, overlap, a=["Ada Lovelace"], b=["Lovelace, Ada", "Lovelace A"]) == 1.0
    assert one(spark, overlap, a=["Ann Bell", "Cy Dane"], b=["Xi Bell"]) == 0.5
    assert one(spark, overlap, a=None, b=["Xi Bell"]) == 0.0


@pytest.mark.parametrize("text,year", [("in 1999.", 1999), ("12345 1500", 1500), ("2200", None), (None, None), ("no", None)])
def test_years(spark, text, year):
    assert one(spark, N.coerce_year(F.col("t")), t=text) == year


def test_identifiers(spark):
    assert one(spark, N.arxiv_in_doi(F.col("t")), t="10.48550/ARXIV.1234.5678") == "1234.5678"
    assert one(spark, N.strip_version(F.col("t")), t="1234.5678v12") == "1234.5678"
    assert one(spark, N.is_printed(F.col("i"), F.col("t")), i="https://doi.org/10.1/AB.", t="Title. doi: 10.1/a b") is True
    assert one(spark, N.is_printed(F.col("i"), F.col("t")), i="arXiv:1234.5678v2", t="arXiv 1234.5678") is True
    assert one(spark, N.is_printed(F.col("i"), F.col("t")), i="10.1/zz", t=None) is False
    assert one(spark, N.looks_like_preprint(F.col("i"), F.col("t")), i=None, t=None) is False


def test_request_keys_ignore_the_order_of_parameters(spark):
    a = one(spark, N.request_key(F.lit("u"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("t")), 1), t="2")
    b = one(spark, N.request_key(F.lit("u"), F.create_map(F.lit("b"), F.col("t"), F.lit("a"), F.lit("1")), 1), t="2")
    c = one(spark, N.request_key(F.lit("u"), F.create_map(F.lit("b"), F.col("t"), F.lit("a"), F.lit("1")), 2), t="2")
    assert a == b != c
