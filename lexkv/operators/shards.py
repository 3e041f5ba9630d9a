"""Range shards: rows (shard_id, table_id, first_key, last_key); an empty bound is open."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLIT_BYTES = 500_000_000
#: Shards that an array in the plan may hold; beyond it routing is a join by bands of keys.
ARRAY_SHARDS = 10_000


def contains(key: Column, first: Column, last: Column) -> Column:
    return (key >= first) & ((last == "") | (key < last))


def route(kv: DataFrame, bounds: list[tuple[str, int]]) -> DataFrame:
    """kv with shard_id, by looking the key up in sorted (first_key, shard_id): no join and no shuffle.

    Shards tile the key space, so the last first_key not above the key decides.
    """
    bounds = sorted(bounds)
    if len(bounds) > ARRAY_SHARDS:
        raise ValueError(f"over {ARRAY_SHARDS} shards: use route_join")
    firsts, ids = F.array(*[F.lit(b) for b, _ in bounds]), F.array(*[F.lit(i).cast("long") for _, i in bounds])
    return kv.withColumn("shard_id", F.element_at(ids, F.size(F.filter(firsts, lambda b: b <= F.col("key")))))


def route_join(kv: DataFrame, shards: DataFrame) -> DataFrame:
    """The same as a range join, for catalogs that are not known while planning or too large for an array.

    Up to ARRAY_SHARDS shards are broadcast. Beyond, the key space is cut into
    bands at about every sqrt(n)-th first_key, picked by hash; keys meet the
    shards that reach into their band.
    """
    s = shards.select("shard_id", "first_key", "last_key")
    inside = contains(F.col("key"), F.col("first_key"), F.col("last_key"))
    if s.limit(ARRAY_SHARDS + 1).count() <= ARRAY_SHARDS:
        return kv.join(F.broadcast(s), inside).drop("first_key", "last_key")
    picked = F.pmod(F.xxhash64("first_key"), F.lit(isqrt(s.count()))) == 0
    cuts = F.array(F.lit(""), *[F.lit(r.first_key) for r in s.filter(picked).select("first_key").distinct().collect()])

    def band(key: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c <= key))

    last = F.when(F.col("last_key") == "", F.size(cuts)).otherwise(band(F.col("last_key")))
    s = s.withColumn("_shard_band", F.explode(F.sequence(band(F.col("first_key")), last)))
    return kv.withColumn("_band", band(F.col("key"))).join(s, (F.col("_band") == F.col("_shard_band")) & inside).drop("_band", "_shard_band", "first_key", "last_key")


def bounds_of(shards: DataFrame) -> list[tuple[str, int]]:
    """Catalog rows for route(); a catalog of over ARRAY_SHARDS shards is refused."""
    rows = shards.select("first_key", "shard_id").limit(ARRAY_SHARDS + 1).collect()
    if len(rows) > ARRAY_SHARDS:
        raise ValueError(f"over {ARRAY_SHARDS} shards")
    return [(r.first_key, r.shard_id) for r in rows]


def stats(routed: DataFrame) -> DataFrame:
    """Keys, bytes, least and greatest key of each shard."""
    size = F.octet_length("key") + F.octet_length("value")
    return routed.groupBy("shard_id").agg(F.count("*").alias("n_keys"), F.sum(size.cast("long")).alias("shard_size"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def midpoints(routed: DataFrame) -> DataFrame:
    """Split key of each shard: its key at place floor(n / 2), counted from 0; shards of one key have none.

    Keys are counted by ranges first, so only the range that holds the middle is sorted: no task sorts a shard.
    """
    cut = routed.select("shard_id", "key")
    n = cut.groupBy("shard_id").agg(F.count("*").alias("n"))
    prefix = cut.groupBy("shard_id", F.col("key").substr(1, 19).alias("range")).agg(F.count("*").alias("in_range"))
    w = Window.partitionBy("shard_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    prefix = prefix.withColumn("ahead", F.coalesce(F.sum("in_range").over(w), F.lit(0))).join(n, "shard_id")
    hit = prefix.filter("ahead <= floor(n / 2) and floor(n / 2) < ahead + in_range and n > 1")
    inside = cut.withColumn("range", F.col("key").substr(1, 19)).join(hit, ["shard_id", "range"])
    place = F.row_number().over(Window.partitionBy("shard_id", "range").orderBy("key"))
    return inside.withColumn("place", place + F.col("ahead") - 1).filter("place = floor(n / 2)").select("shard_id", F.col("key").alias("split_key"))


def split(shards: DataFrame, shard_id: int, key: str, new_id: int) -> DataFrame:
    """The catalog after a split: the parent keeps [first, key), the child gets [key, last)."""
    row = shards.filter(F.col("shard_id") == shard_id).first()
    if row is None or not row.first_key < key or row.last_key and not key < row.last_key:
        raise ValueError("a split key must lie inside its shard")
    mine = F.col("shard_id") == shard_id
    parent = shards.withColumn("last_key", F.when(mine, F.lit(key)).otherwise(F.col("last_key")))
    child = shards.filter(mine).withColumn("shard_id", F.lit(new_id).cast("long")).withColumn("first_key", F.lit(key))
    return parent.unionByName(child)


def to_split(stats: DataFrame, shards: DataFrame, tables: DataFrame, limit: int = SPLIT_BYTES, busy: DataFrame | None = None) -> DataFrame:
    """Shards due for an automatic split: too large, with a midpoint, table not frozen, not migrating (busy: their shard_id)."""
    frozen = tables.filter("is_frozen").select("table_id")
    due = shards.join(stats, "shard_id").filter(F.col("shard_size") > limit).join(frozen, "table_id", "left_anti").filter("min_key < max_key")
    if busy is not None:
        due = due.join(busy, "shard_id", "left_anti")
    return due.select("shard_id", "shard_size")


def next_split(due: DataFrame, midpoints: DataFrame, shards: DataFrame) -> DataFrame:
    """The one split to make now, the largest shard first: (shard_id, split_key). A key at which a shard already begins is no split."""
    keys = due.join(midpoints, "shard_id").join(shards.select(F.col("first_key").alias("split_key")), "split_key", "left_anti")
    return keys.orderBy(F.desc("shard_size"), "shard_id").limit(1).select("shard_id", "split_key")


def tiling_faults(shards: DataFrame) -> DataFrame:
    """Rows where a table's shards leave a gap or overlap; none if they tile the key space."""
    w = Window.partitionBy("table_id").orderBy("first_key", "shard_id")
    s = shards.withColumn("next_first", F.lead("first_key").over(w)).withColumn("place", F.row_number().over(w))
    bad = (F.coalesce("next_first", F.lit("")) != F.col("last_key")) | ((F.col("place") == 1) & (F.col("first_key") != ""))
    return s.filter(bad).select("table_id", "shard_id", "first_key", "last_key", "next_first")


def migrated(log: DataFrame, shards: DataFrame, shard_id: int, new_id: int, quorum_id: int) -> tuple[DataFrame, DataFrame]:
    """A shard's log rows, tombstones included, under a new id, and the catalog that points to it."""
    copy = log.filter(F.col("shard_id") == shard_id).withColumn("shard_id", F.lit(new_id).cast("long"))
    mine = F.col("shard_id") == shard_id
    moved = shards.withColumn("quorum_id", F.when(mine, F.lit(quorum_id).cast("long")).otherwise(F.col("quorum_id"))) if "quorum_id" in shards.columns else shards
    return copy, moved.withColumn("shard_id", F.when(mine, F.lit(new_id).cast("long")).otherwise(F.col("shard_id")))


def live_shards(shards: DataFrame, tables: DataFrame) -> DataFrame:
    return shards.join(tables, "table_id", "left_semi")
