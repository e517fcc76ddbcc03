"""Likeness of words by their matching runs. No built-in function has this measure, so batches go to Python."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Share of matched letters, of both words together, from which words are alike (fixed value).
ALIKE = 0.9


def _alike(left: str, right: str) -> bool:
    longest = len(left) + len(right)
    if longest == 0 or 2 * min(len(left), len(right)) < ALIKE * longest:
        return longest == 0
    if any(ch.isdigit() for ch in left + right):
        return False
    return SequenceMatcher(None, left, right).ratio() >= ALIKE


@F.pandas_udf(BooleanType())
def _alike_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else _alike(a, b) for a, b in zip(left, right, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _first_alike_batch(texts: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or n is None else next((name for name in n if any(_alike(w, name) for w in t.split())), None) for t, n in zip(texts, names, strict=True)], dtype=object)


def is_similar(left: Column | str, right: Column | str) -> Column:
    """Whether two words share nine tenths of their letters in matching runs; never with digits, null for null."""
    return _alike_batch(left, right)


def first_alike(words: Column | str, names: Column | str) -> Column:
    """The first of an array of names that a word of a text is alike to; null without one."""
    return _first_alike_batch(words, names)
