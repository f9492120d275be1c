"""Repairs of text that came out of a printed page."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stands where a citation bracket was deleted; repairs touch nothing that isn't beside one.
DELETED = "\x02"
# Words that a deleted citation leaves dangling, and what may follow a hyphen that stays.
_PARTICIPLES = "proposed|presented|described|developed|reported|introduced|studied|discussed|found|given"
_CONNECTORS = r"in|into|from|of|with|by|see|cf\."
_SUSPENDED = "and|or|nor|to|based|free|like|type|specific|dependent|driven"
#: Spacing accents and the marks they stand for.
_SPACING = {"\u00b4": "\u0301", "\u02c7": "\u030c", "\u00a8": "\u0308", "\u02d8": "\u0306", "\u02dc": "\u0303"}
#: (pattern, replacement) in order: a deleted citation with the words that led to it, then marks without their text.
_TIDY = (
    (rf"(?i)\b(in|see)\s*{DELETED}\s*and\s+(the\s+references\s+therein)", "$1 $2"),
    (rf"(?i)\s*\b(?:{_PARTICIPLES})\s+(?:{_CONNECTORS})\s*{DELETED}\s*([.,;:])", "$1"),
    (rf"(?i)\s*\b(?:{_CONNECTORS})\s*{DELETED}\s*([.,;:])", "$1"),
    (rf"(?i)\s*{DELETED}\s+for\s+(references\b)", " $1"),
    (rf"(?i)\(\s*(?:see\s*)?{DELETED}\s*[,;]?\s*\)", ""),
    (rf"[ \t]*{DELETED}", ""),
    (r"\s+([.,;:)])", "$1"),
    (r"\(\s*[,;]?\s*\)", ""),
    (r"\[\s*\]", ""),
    (r"[ \t]{2,}", " "),
    (r"[ \t]+\n", "\n"),
)


def dehyphenate(text: Column) -> Column:
    """Joins words cut by a hyphen and white space; a hyphen before a word such as "and" or "based" stays."""
    return F.regexp_replace(text, rf"(?<=[a-z])-\s+(?!(?:{_SUSPENDED})\b)(?=[a-z])", "")


def repair_doi(text: Column) -> Column:
    """Takes blanks out of a printed DOI: after its label, behind its slash, and behind a dot within it that a digit and
    three letters or digits follow."""
    a = F.regexp_replace(text, r"(?i)\bdoi:\s+", "doi:")
    b = F.regexp_replace(a, r"(10\.\d{4,9}/)\s+(?=[A-Za-z0-9])", "$1")
    return F.regexp_replace(b, r"(10\.\d{4,9}/\S*?)\.\s+(?=\d[A-Za-z0-9]{3,}\b)", "$1.")


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def compose_accents(text: Column) -> Column:
    """Letters and their separate marks, spacing ones among them, as one letter; plain texts don't leave the JVM."""
    for spacing, mark in _SPACING.items():
        text = F.regexp_replace(text, f"([A-Za-z]){spacing}", f"$1{mark}")
    marked = text.rlike(r"\p{M}")
    return F.when(marked, _composed(F.when(marked, text))).otherwise(text)


def tidy_punctuation(text: Column) -> Column:
    """What deleted citations, each left as DELETED, leave behind; a text without any stays as it is."""
    out = text
    for pattern, replacement in _TIDY:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(F.contains(text, F.lit(DELETED)), out).otherwise(text)
