"""Registered queries over batches, shards, written tables and the catalog, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexkv.functions import keys as K
from lexkv.operators import indexes, log, shards
from lexkv.operators import table as T
from lexkv.operators.catalog import Catalog
from lexkv.operators.table import RangeQuery
from lexkv.plans import tables as V
from lexkv.plans.queries import LAST, OVER, PENDING, ROUTED, k, pending, query, routed, shard_frame
from lexkv.sources import storage


# batches
@query(f", {PENDING} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM (SELECT seq, op, key, value FROM event_log WHERE op IN ('S', 'D') UNION ALL SELECT 1000000000, op, key, value FROM pending)) WHERE rn = 1 AND op = 'S'", "event_log")
def submit_batch(spark, d):
    """The state behind a batch that was submitted: its last write of each key comes after all that is committed."""
    return log.state(log.submitted(V.event_log(spark, d).select("seq", "op", "key", "value"), pending(spark, d)))


@query(f", {PENDING}, {OVER} SELECT count(*) FILTER (starts_with(key, '{k(0)[:18]}')) AS seen, (SELECT count(*) FROM customer_kv WHERE starts_with(key, '{k(0)[:18]}')) AS committed FROM overlaid", "customer_kv")
def count_ignores_pending(spark, d):
    """A count sees committed rows only, a list sees the client's own pending writes."""
    kv, q = V.customer_kv(spark, d), RangeQuery(prefix=k(0)[:18])
    seen = log.overlay_list(kv, pending(spark, d), q).agg(F.count("*").alias("seen"))
    return seen.join(F.broadcast(T.count(kv, q).withColumnRenamed("n", "committed")))


# shards
@query("SELECT CASE WHEN shard_id = 3 THEN 9 ELSE shard_id END AS shard_id, CASE WHEN shard_id = 3 THEN 2 ELSE 1 END AS quorum_id, op, count(*) AS n FROM (SELECT key, shard_id, unnest(CASE WHEN value = 'P' THEN ['S', 'D'] ELSE ['S'] END) AS op FROM " + ROUTED + ") GROUP BY ALL", "orders_kv")
def shard_migrate(spark, d):
    """A shard moves to another quorum under a new id with its tombstones: no row is lost or doubled."""
    ops = F.when(F.col("value") == "P", F.array(F.lit("S"), F.lit("D"))).otherwise(F.array(F.lit("S")))
    rows = routed(spark, d).select("key", "shard_id", F.explode(ops).alias("op"))
    copy, frame = shards.migrated(rows, shard_frame(spark).withColumn("quorum_id", F.lit(1).cast("long")), 3, 9, 2)
    every = rows.filter("shard_id <> 3").unionByName(copy).groupBy("shard_id", "op").agg(F.count("*").alias("n"))
    return every.join(F.broadcast(frame.select("shard_id", "quorum_id")), "shard_id")  # shards of one catalog


@query("SELECT shard_id, first_key FROM (VALUES (1::BIGINT, '', 1), (2, '" + k(400) + "', 1)) t(shard_id, first_key, table_id)")
def shards_of_live_tables(spark, d):
    frame = shard_frame(spark).withColumn("table_id", F.when(F.col("shard_id") > 2, 7).otherwise(1).cast("long"))
    return shards.live_shards(frame, spark.createDataFrame([(1,)], "table_id long")).select("shard_id", "first_key")


@query(f"SELECT coalesce(a.shard_id, b.shard_id) AS shard_id, coalesce(a.key, b.key) AS key, a.value AS left_value, b.value AS right_value FROM {ROUTED} a FULL JOIN (SELECT shard_id, key, CASE WHEN value = 'F' THEN 'G' ELSE value END AS value FROM {ROUTED} WHERE value <> 'P') b ON a.shard_id = b.shard_id AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value", "orders_kv")
def replica_rows(spark, d):
    """Two replicas compared by shard, key and value."""
    a = routed(spark, d)
    b = a.filter("value <> 'P'").withColumn("value", F.when(F.col("value") == "F", "G").otherwise(F.col("value")))
    both = a.withColumnRenamed("value", "left_value").join(b.withColumnRenamed("value", "right_value"), ["shard_id", "key"], "full_outer")
    return both.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


@query(f"SELECT shard_id, sum(bytes)::BIGINT AS bytes, count(*) AS n_chunks FROM (SELECT shard_id, ascii(value) AS chunk, sum(strlen(key) + strlen(value)) AS bytes FROM {ROUTED} GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 2 OR shard_id = 1", "orders_kv")
def compaction_queue(spark, d):
    """Shards due for a merge: those with many chunks and those that were split."""
    size = F.sum(F.octet_length("key") + F.octet_length("value")).alias("bytes")
    chunks = routed(spark, d).groupBy("shard_id", F.ascii("value").alias("chunk")).agg(size).withColumn("was_split", F.col("shard_id") == 1)
    return storage.compaction_order(chunks, most=2).select("shard_id", "bytes", "n_chunks")


# written tables
@query(f"SELECT key, value FROM orders_kv WHERE key >= '{k(200)}' AND key < '{k(700)}'", "orders_kv")
def sorted_table_scan(spark, d):
    """A table written in key order and scanned by range: files and row groups outside the range are skipped."""
    path = storage.scratch(spark, "sorted-table")
    storage.write_sorted(V.orders_kv(spark, d), path, 8)
    return T.list_key_values(storage.read_table(spark, path), RangeQuery(start=k(200), end=k(700)))


@query("SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM (SELECT key, 'S' AS op, value, 1 AS seq FROM orders_kv UNION ALL SELECT key, CASE WHEN value = 'P' THEN 'D' ELSE 'S' END, value || '2', 2 FROM orders_kv WHERE value <> 'O')) WHERE rn = 1 AND op = 'S' AND key >= '" + k(300) + "' AND key < '" + k(5000) + "'", "orders_kv")
def compacted_table(spark, d):
    """Chunks that were bulk loaded, merged into one sorted table of the shard's range."""
    old, new, target = (storage.scratch(spark, n) for n in ("chunk-1", "chunk-2", "compacted"))
    kv = V.orders_kv(spark, d)
    storage.bulk_load(kv.select("key", F.lit("S").alias("op"), "value", F.lit(1).alias("seq")), old)
    storage.bulk_load(kv.filter("value <> 'O'").select("key", F.when(F.col("value") == "P", "D").otherwise("S").alias("op"), F.concat("value", F.lit("2")).alias("value"), F.lit(2).alias("seq")), new)
    storage.compact(spark, [old, new], target, k(300), k(5000))
    return storage.read_table(spark, target)


@query(f"SELECT key, value FROM {LAST} WHERE op = 'S'", "event_log")
def newest_snapshot(spark, d):
    """Two versions of a state are written; a reader that has seen version 2 gets that one."""
    root, rows = storage.scratch(spark, "snapshots"), V.event_log(spark, d)
    storage.snapshot(log.state(rows.filter("seq <= 500")), root, 1)
    storage.snapshot(log.state(rows), root, 2)
    return storage.read_snapshot(spark, root, at_least=2)


@query("SELECT seq, op, key, value FROM event_log WHERE seq > 800 AND op IN ('S', 'D')", "event_log")
def replay_written_log(spark, d):
    path, rows = storage.scratch(spark, "written-log"), V.event_log(spark, d).select("seq", "op", "key", "value")
    storage.append_log(rows.filter("seq <= 600"), path)
    storage.append_log(rows.filter("seq > 600"), path)
    return storage.replay(spark, path, 800).filter(F.col("op").isin("S", "D"))


@query("SELECT CASE WHEN ascii(value) % 2 = 0 THEN 'even' ELSE 'odd' END AS chunk, min(key) AS min_key, max(key) AS max_key, count(*) AS n_keys FROM orders_kv GROUP BY 1", "orders_kv")
def chunk_statistics(spark, d):
    chunk = F.when(F.ascii("value") % 2 == 0, "even").otherwise("odd").alias("chunk")
    return V.orders_kv(spark, d).groupBy(chunk).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_keys"))


# indexes
@query("SELECT c_mktsegment || '|' || printf('%021d', c_custkey) AS key, printf('%021d', c_custkey) AS value FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)")
def index_maintenance(spark, d):
    """Rows that change or go take their index entries along: the index is derived from the rows."""
    rows = V.read(spark, d, "customer").filter("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return indexes.derived(rows, F.col("c_mktsegment"), K.encode_int(F.col("c_custkey")))


# catalog
def _catalog(spark):
    c = Catalog.empty(spark).register_server("a:1").register_server("b:1").create_quorum("q", [1, 2]).create_database("one").create_database("two")
    return c.create_table(1, 1, "t").create_table(1, 1, "u").split_shard(1, k(400)).rename_table(2, "w").freeze_table(2)


@query("SELECT * FROM (VALUES (1::BIGINT, 'one', 2::BIGINT, 3::BIGINT), (2, 'two', 0, 0)) t(database_id, name, n_tables, n_shards)")
def catalog_statistics(spark, d):
    return _catalog(spark).statistics()


@query("SELECT * FROM (VALUES (1::BIGINT, 't', false), (2, 'w', true)) t(table_id, name, is_frozen)")
def catalog_round_trip(spark, d):
    """The catalog as JSON and back."""
    return Catalog.from_json(_catalog(spark).to_json())["tables"].select("table_id", "name", "is_frozen")


# functions
@query("SELECT l_orderkey, l_linenumber, CASE WHEN n >= 1000000 THEN regexp_replace(printf('%.1f', round(n / 1000000.0, 1)), '\\.0$', '') || ' MB' WHEN n >= 1000 THEN regexp_replace(printf('%.1f', round(n / 1000.0, 1)), '\\.0$', '') || ' KB' ELSE n || ' B' END AS size, CASE WHEN l_linenumber % 2 = 0 THEN hex(chr(1) || l_returnflag) ELSE l_returnflag END AS shown FROM (SELECT *, l_orderkey * 100 AS n FROM lineitem)")
def display_functions(spark, d):
    flag = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("\x01"), "l_returnflag")).otherwise(F.col("l_returnflag"))
    return V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", K.human_bytes(F.col("l_orderkey") * 100).alias("size"), K.display_key(flag).alias("shown"))
