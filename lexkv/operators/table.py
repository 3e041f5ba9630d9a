"""Reads of a key-value table: point and batched gets, ordered range lists, counts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexkv.functions.keys import prefix_successor

Key = str | bytes | None


@dataclass(frozen=True)
class RangeQuery:
    """A list or count request. start is inclusive, end exclusive, in both directions.

    Unset bounds are None or empty; limit None is unlimited and 0 is empty; skip
    drops the first row if its key is start; offset drops so many rows.
    """

    prefix: Key = None
    start: Key = None
    end: Key = None
    limit: int | None = None
    reverse: bool = False
    skip: bool = False
    offset: int = 0

    def is_empty(self) -> bool:
        """Whether the bounds prove that no key can match."""
        lo, hi = (self.end, self.start) if self.reverse else (self.start, self.end)
        if self.limit == 0 or lo and hi and (lo > hi or lo == hi and not self.reverse and self.start) or (self.start and self.start == self.end):
            return True
        if self.prefix:
            after = prefix_successor(self.prefix)
            if lo and after is not None and lo >= after:
                return True
            if hi and (hi < self.prefix or hi == self.prefix and not self.reverse):
                return True
        return False

    def condition(self, key: Column) -> Column | None:
        """The bounds as plain comparisons, which reach the scan's statistics."""
        tests = []
        if self.start:
            tests.append(key <= F.lit(self.start) if self.reverse else key >= F.lit(self.start))
            if self.skip:
                tests.append(key != F.lit(self.start))
        if self.end:
            tests.append(key > F.lit(self.end) if self.reverse else key < F.lit(self.end))
        if self.prefix:
            tests.append(key.startswith(F.lit(self.prefix)))
            tests.append(key >= F.lit(self.prefix))
            if (after := prefix_successor(self.prefix)) is not None:
                tests.append(key < F.lit(after))
        out = None
        for t in tests:
            out = t if out is None else out & t
        return out

    def rows(self, kv: DataFrame) -> DataFrame:
        """Matching rows without order."""
        if self.is_empty():
            return kv.limit(0)
        c = self.condition(F.col("key"))
        return kv if c is None else kv.filter(c)

    def after(self, last: Key, page: int) -> RangeQuery:
        """The next page's request: it starts behind the last key seen."""
        return replace(self, start=last, skip=True, limit=page, offset=0)


def list_key_values(kv: DataFrame, q: RangeQuery = RangeQuery()) -> DataFrame:
    """Rows in key order; with a limit this plans as a top-k, not a full sort."""
    out = q.rows(kv).orderBy(F.desc("key") if q.reverse else F.asc("key"))
    if q.offset:
        out = out.offset(q.offset)
    return out if q.limit is None else out.limit(q.limit)


def list_keys(kv: DataFrame, q: RangeQuery = RangeQuery()) -> DataFrame:
    return list_key_values(kv.select("key"), q)


def count(kv: DataFrame, q: RangeQuery = RangeQuery()) -> DataFrame:
    """Number of committed keys in range; takes no limit and no pending writes."""
    return replace(q, limit=None, offset=0).rows(kv.select("key")).agg(F.count("*").alias("n"))


def get(kv: DataFrame, key: Key) -> DataFrame:
    if not key:
        raise ValueError("a key may not be empty")
    return kv.filter(F.col("key") == F.lit(key))


def get_default(kv: DataFrame, key: Key, default: str) -> DataFrame:
    """One row (key, value): the stored value or the default."""
    asked = kv.sparkSession.range(1).select(F.lit(key).alias("key"))
    return asked.join(get(kv, key), "key", "left").select("key", F.coalesce("value", F.lit(default)).alias("value"))


def multi_get(keys: DataFrame, kv: DataFrame) -> DataFrame:
    """For each asked key its value and status, OK or FAILED."""
    found = kv.select("key", "value", F.lit(True).alias("hit"))
    return keys.select("key").join(found, "key", "left").select("key", "value", F.when(F.col("hit"), "OK").otherwise("FAILED").alias("status"))


def misses(keys: DataFrame, kv: DataFrame) -> DataFrame:
    return keys.select("key").join(kv, "key", "left_anti")


def pages(kv: DataFrame, q: RangeQuery = RangeQuery(), page: int = 100):
    """Key-ordered pages as DataFrames, each starting behind the last key of the one before.

    One job a page, as an interactive reader asks for them; for whole results
    list_key_values is a single plan.
    """
    left = q.limit
    while left is None or left > 0:
        part = list_key_values(kv, replace(q, limit=page if left is None else min(page, left)))
        last = part.agg(F.min("key") if q.reverse else F.max("key"), F.count("*")).first()
        if not last[1]:
            return
        yield part
        left = None if left is None else left - last[1]
        q = q.after(last[0], page)
