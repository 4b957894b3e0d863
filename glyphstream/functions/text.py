"""Text as column expressions. Unicode normalisation has no built-in and runs in Arrow batches, on texts that are not ASCII only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """NFKC."""
    return F.when(text.rlike(r"\A\p{ASCII}*\z"), text).otherwise(F.pandas_udf(_nfkc, "string")(text))


_SPACE = r"(?U)[\s\x1C-\x1F]+"


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def display_text(text: Column) -> Column:
    return collapse(compatible(text))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def metric_text(text: Column) -> Column:
    """NFKC without any white space."""
    return bare(compatible(text))


def similarity(left: Column, right: Column) -> Column:
    """1 less the edit distance over the longer length; two empty texts are alike, a null one gives null."""
    longest = F.greatest(F.length(left), F.length(right), F.lit(1))
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.levenshtein(left, right) / longest))


def prefix_related(left: Column, right: Column) -> Column:
    a, b = bare(left), bare(right)
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.startswith(a, b) | F.startswith(b, a))


def effective(normalized: Column, raw: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(normalized, F.lit("")), F.nullif(raw, F.lit("")), F.lit("")))


def chosen(left: Column, right: Column, left_confidence: Column, right_confidence: Column) -> Column:
    """Of texts that begin alike the longer (the right one of equals), else that of higher confidence (the left one of equals)."""
    return F.when(prefix_related(left, right), F.when(F.length(left) > F.length(right), left).otherwise(right)).otherwise(F.when(left_confidence >= right_confidence, left).otherwise(right))
