"""Map, filter and reduce scans. Built-in maps are column expressions; user functions run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(kv: DataFrame, part: str) -> DataFrame:
    """Rows whose value holds part; part is no pattern."""
    return kv.filter(F.instr("value", part) > 0)


def starts_with(kv: DataFrame, part: str) -> DataFrame:
    return kv.filter(F.col("value").startswith(part))


def word_counts(kv: DataFrame) -> DataFrame:
    """Words (letters) of values in lower case, with counts: map emits words, reduce counts them."""
    words = kv.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def ngram_counts(kv: DataFrame, n: int = 2) -> DataFrame:
    """n-grams of words between single blanks, with counts."""
    w = F.filter(F.split("value", " "), lambda x: x != "")
    grams = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return kv.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def map_reduce(kv: DataFrame, mapper: Callable[[str, str], Iterator[tuple[str, str]]], reducer: Column) -> DataFrame:
    """A user's mapper over rows, reduced by an aggregate of `value` per emitted key.

    mapper(key, value) yields (key, value) pairs. reducer is a Spark aggregate,
    so partial sums are made before the shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for k, v in zip(pdf.key, pdf.value, strict=True) for x in mapper(k, v)], columns=["key", "value"])

    return kv.select("key", "value").mapInPandas(run, "key string, value string").groupBy("key").agg(reducer)


def map_partitions(kv: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A local scan: fn takes and yields pandas batches of one partition."""
    return kv.mapInPandas(fn, schema)


def extension(kv: DataFrame, fn: Callable[[pd.Series, pd.Series], pd.Series], result: str = "string") -> DataFrame:
    """kv with `out`, a registered function of key and value, vectorised."""
    udf = F.pandas_udf(fn, result)
    return kv.withColumn("out", udf("key", "value"))
