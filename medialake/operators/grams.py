"""Search for parts of texts through stored postings of three-letter grams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions.text import text
from medialake.operators.filters import search

#: Letters of a gram.
LETTERS = 3
#: Grams of a question that are looked up, the rarest ones; the texts themselves decide in the end.
LOOKED_UP = 3


def _grams(c: Column) -> Column:
    """The distinct grams of a text in lower case."""
    lower = F.lower(c)
    last = F.length(lower) - LETTERS
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(lower, i + 1, F.lit(LETTERS))))).otherwise(F.array().cast("array<string>"))


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``gram, key`` for every gram of the columns, each once a row of ``df``."""
    grams = F.array_distinct(F.flatten(F.array(*[_grams(text(c)) for c in columns])))
    return df.select(F.col(key).alias("key"), F.explode(grams).alias("gram")).select("gram", "key")


def store_postings(df: DataFrame, key: str, columns: list[str], path: str) -> DataFrame:
    """Writes the postings sorted by gram, in ranges, so that a lookup reads the row groups of its grams only."""
    rows = postings(df, key, columns)
    rows.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def grams_of(query: str) -> list[str]:
    """Grams that every match of a query has: those of its parts between wildcards."""
    parts = re.split("[%_]", query.lower())
    return sorted({p[i : i + LETTERS] for p in parts for i in range(len(p) - LETTERS + 1)})


def search_postings(df: DataFrame, key: str, columns: list[str], query: str, stored: DataFrame) -> DataFrame:
    """What :func:`filters.search` finds, through ``stored`` postings of the same columns.

    The rarest grams of the query are intersected, and the rows left are tested
    in full. A query without a gram (one or two letters) can only be scanned for.
    """
    asked = grams_of(query)
    if not asked:
        return search(df, columns, query)
    counts = {r.gram: r.n for r in stored.where(F.col("gram").isin(asked)).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    if len(counts) < len(asked):
        return df.limit(0)  # a gram that no text has
    rarest = sorted(asked, key=lambda g: (counts[g], g))[:LOOKED_UP]
    ids = stored.where(F.col("gram").isin(rarest)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= len(rarest)).select("key")
    return search(df.join(ids, df[key] == ids["key"], "left_semi"), columns, query)
