"""Tables and logs in Parquet: sorted files, snapshots, compaction, export, checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexkv.operators import log as log_ops


def write_sorted(df: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """Range-partitioned by key and sorted inside: bounds on key prune files and row groups; a Bloom filter serves point gets."""
    parts = df.repartitionByRange(files, "key") if files else df.repartitionByRange("key")
    parts.sortWithinPartitions("key").write.mode(mode).option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bulk_load(df: DataFrame, path: str) -> None:
    """Append rows without order; compact later."""
    df.write.mode("append").parquet(path)


def append_log(commands: DataFrame, path: str) -> None:
    commands.write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """Log commands behind a persisted position."""
    return spark.read.parquet(path).filter(F.col("seq") > after)


def exported(*chunks: DataFrame) -> DataFrame:
    """Everything the chunks hold, tombstones and old versions included."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


def compact(spark: SparkSession, sources: list[str], target: str, first_key: str = "", last_key: str = "") -> None:
    """Fold all chunks of a shard into one sorted table, cut to the shard's range, tombstones dropped."""
    rows = exported(*[spark.read.parquet(p) for p in sources])
    if first_key:
        rows = rows.filter(F.col("key") >= first_key)
    if last_key:
        rows = rows.filter(F.col("key") < last_key)
    write_sorted(log_ops.state(rows), target)


def compaction_due(n_chunks: int, was_split: bool, most: int = 10) -> bool:
    return was_split or n_chunks > most


def snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write a version; a version is written once and never changed."""
    path = f"{root}/version={version}"
    write_sorted(df, path)
    return path


def read_snapshot(spark: SparkSession, root: str, at_least: int | None = None) -> DataFrame:
    """The newest version; fails if it is older than what the reader has seen."""
    df = spark.read.parquet(root)
    top = df.agg(F.max("version")).first()[0]
    if top is None or at_least is not None and top < at_least:
        raise ValueError(f"no snapshot of version {at_least} or later")
    return df.filter(F.col("version") == top).drop("version")


def log_as_sql(log: DataFrame, table: str) -> DataFrame:
    """Each set and delete as an SQL statement."""

    def quoted(c: str):
        return F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))

    insert = F.concat(F.lit(f"INSERT INTO {table} VALUES ("), quoted("key"), F.lit(", "), quoted("value"), F.lit(");"))
    delete = F.concat(F.lit(f"DELETE FROM {table} WHERE key = "), quoted("key"), F.lit(";"))
    return log.filter(F.col("op").isin("S", "D")).select("seq", F.when(F.col("op") == "S", insert).otherwise(delete).alias("statement"))


def order_faults(chunk: DataFrame, group: str) -> DataFrame:
    """Rows of a file (group) whose key is not above the one before it, by place."""
    w = Window.partitionBy(group).orderBy("place")
    return chunk.withColumn("before", F.lag("key").over(w)).filter("before >= key").select(group, "place", "before", "key")


def retained(log: DataFrame, keep_bytes: int, ranges: int = 100_000) -> DataFrame:
    """The newest commands whose total size stays within keep_bytes.

    Sizes are summed by ranges of positions first, at most `ranges` of them, and
    only ranges that can hold the cut or lie behind it are ordered inside.
    """
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    span = log.agg(F.greatest(F.lit(4096), F.ceil((F.max("seq") - F.min("seq") + 1) / (ranges - 1))).alias("_width"))
    rows = log.withColumn("_size", size.cast("long")).join(F.broadcast(span)).withColumn("_range", F.floor(F.col("seq") / F.col("_width")))
    sums = rows.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    newer = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_newer")).filter(F.col("_newer") < keep_bytes)
    inside = Window.partitionBy("_range").orderBy(F.desc("seq"))
    rows = rows.join(F.broadcast(sums.limit(ranges)), "_range").withColumn("_total", F.col("_newer") + F.sum("_size").over(inside))
    return rows.filter(F.col("_total") <= keep_bytes).select(*log.columns)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's spark.checkpoint.dir; below the warehouse where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def compaction_order(chunks: DataFrame, most: int = 10) -> DataFrame:
    """Shards due for compaction, largest first, from rows (shard_id, chunk, bytes, was_split)."""
    due = chunks.groupBy("shard_id").agg(F.count("*").alias("n_chunks"), F.sum("bytes").alias("bytes"), F.coalesce(F.bool_or("was_split"), F.lit(False)).alias("was_split"))
    return due.filter(F.col("was_split") | (F.col("n_chunks") > most)).orderBy(F.desc("bytes"), "shard_id")
