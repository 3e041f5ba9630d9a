"""Secondary-index tables, joins over them, and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexkv.functions.keys import field_key
from lexkv.operators.table import RangeQuery


def derived(rows: DataFrame, field: Column, key: Column) -> DataFrame:
    """An index table of rows: field|key -> key. Derived, so it cannot drift."""
    return rows.select(field_key(field, key).alias("key"), key.alias("value"))


def lookup(index: DataFrame, base: DataFrame) -> DataFrame:
    """Rows that index entries point to: (index_key, key, value)."""
    i = index.select(F.col("key").alias("index_key"), F.col("value").alias("key"))
    return i.join(base.select("key", "value"), "key").select("index_key", "key", "value")


def scan_fetch(index: DataFrame, base: DataFrame, q: RangeQuery) -> DataFrame:
    """Scan an index by range or prefix, then fetch the rows."""
    return lookup(q.rows(index), base)


def violations(expected: DataFrame, index: DataFrame) -> DataFrame:
    """Entries missing from an index, left over in it, or with another value."""
    a, b = expected.select("key", F.col("value").alias("expected")), index.select("key", F.col("value").alias("found"))
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "key", "full_outer")
    fault = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("expected").eqNullSafe(F.col("found")), "different")
    return j.select("key", "expected", "found", fault.alias("fault")).filter("fault is not null")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tables compared both ways: key, both values, and what differs."""
    return violations(left, right).select("key", F.col("expected").alias("left_value"), F.col("found").alias("right_value"), F.when(F.col("fault") == "missing", "left only").when(F.col("fault") == "extra", "right only").otherwise("different").alias("difference"))


def replica_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of two routed replicas by shard, and whether they agree."""
    n = [x.groupBy("shard_id").agg(F.count("*").alias(c)) for x, c in ((a, "n_a"), (b, "n_b"))]
    return n[0].join(n[1], "shard_id", "full_outer").select("shard_id", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).withColumn("same", F.col("n_a") == F.col("n_b"))


def inserted_misses(kv: DataFrame, asked: DataFrame) -> DataFrame:
    """kv with those asked rows (key, value) whose key it lacks."""
    return kv.unionByName(asked.join(kv, "key", "left_anti").select(*kv.columns))


def fan_out(events: DataFrame, followers: DataFrame, size: int = 100_000) -> DataFrame:
    """Each event (key, value) once for every follower of its key: followers are distinct rows (key, follower).

    A key of over `size` followers is dealt out by a hash of the follower, so no task holds all of them.
    """
    hot = followers.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("_n")).filter("_n > 1")
    n = F.coalesce("_n", F.lit(1))
    f = followers.join(F.broadcast(hot), "key", "left").withColumn("_slice", F.pmod(F.xxhash64("follower"), n).cast("int")).drop("_n")
    e = events.join(F.broadcast(hot), "key", "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    return e.join(f, ["key", "_slice"]).select("follower", "key", "value")
