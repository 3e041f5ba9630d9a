"""The registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexkv.functions import keys as K
from lexkv.operators import indexes, log, mapreduce, shards, transactions
from lexkv.operators import table as T
from lexkv.operators.table import RangeQuery
from lexkv.plans import tables as V
from lexkv.plans.tables import BOUNDS, SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def k(n: int) -> str:
    return f"{n:021d}"


def query(sql: str | None = None, *views: str):
    """Registers a query and its SQL; views are named in front of it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = ("WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + " " if views else "") + sql
        return fn

    return add


def listing(name: str, q: RangeQuery, sql: str, view: str = "orders_kv", keys_only: bool = False):
    def fn(spark, d):
        kv = getattr(V, view)(spark, d)
        return T.list_keys(kv, q) if keys_only else T.list_key_values(kv, q)

    fn.__name__ = name
    query(sql, view)(fn)


# scans
@query(f"SELECT key, value FROM orders_kv WHERE key = '{k(7)}'", "orders_kv")
def get_point(spark, d):
    return T.get(V.orders_kv(spark, d), k(7))


@query(f"SELECT x.key, coalesce(o.value, 'none') AS value FROM (SELECT '{k(0)}x' AS key) x LEFT JOIN orders_kv o ON o.key = x.key", "orders_kv")
def get_default(spark, d):
    return T.get_default(V.orders_kv(spark, d), k(0) + "x", "none")


def asked(spark, d):
    return V.read(spark, d, "events").select(K.encode_int(F.col("event_id") * 2).alias("key")).distinct()


ASKED = "(SELECT DISTINCT printf('%021d', event_id * 2) AS key FROM events)"


@query(f"SELECT a.key, o.value, CASE WHEN o.key IS NULL THEN 'FAILED' ELSE 'OK' END AS status FROM {ASKED} a LEFT JOIN orders_kv o ON a.key = o.key", "orders_kv")
def multi_get(spark, d):
    return T.multi_get(asked(spark, d), V.orders_kv(spark, d))


@query(f"SELECT a.key FROM {ASKED} a WHERE NOT EXISTS (SELECT 1 FROM orders_kv o WHERE o.key = a.key)", "orders_kv")
def multi_get_misses(spark, d):
    return T.misses(asked(spark, d), V.orders_kv(spark, d))


listing("list_keys", RangeQuery(start=k(100), end=k(900)), f"SELECT key FROM orders_kv WHERE key >= '{k(100)}' AND key < '{k(900)}'", keys_only=True)
listing("list_key_values", RangeQuery(start=k(100), end=k(900)), f"SELECT key, value FROM orders_kv WHERE key >= '{k(100)}' AND key < '{k(900)}'")
listing("list_full_scan", RangeQuery(), "SELECT key, value FROM orders_kv")
listing("list_backward_limit", RangeQuery(start=k(900), end=k(100), reverse=True, limit=100), f"SELECT key, value FROM orders_kv WHERE key <= '{k(900)}' AND key > '{k(100)}' ORDER BY key DESC LIMIT 100")
listing("list_skip", RangeQuery(start=k(10), skip=True, limit=50), f"SELECT key, value FROM orders_kv WHERE key > '{k(10)}' ORDER BY key LIMIT 50")
listing("list_page_k", RangeQuery().after(k(300), 100), f"SELECT key, value FROM orders_kv WHERE key > '{k(300)}' ORDER BY key LIMIT 100")
listing("list_offset", RangeQuery(offset=25, limit=50), "SELECT key, value FROM orders_kv ORDER BY key LIMIT 50 OFFSET 25")
listing("list_prefix", RangeQuery(prefix="/" + k(33) + "/"), f"SELECT key, value FROM lineitem_kv WHERE starts_with(key, '/{k(33)}/')", "lineitem_kv")
listing("list_prefix_range", RangeQuery(prefix=k(0)[:18], start=k(120), end=k(880)), f"SELECT key, value FROM orders_kv WHERE starts_with(key, '{k(0)[:18]}') AND key >= '{k(120)}' AND key < '{k(880)}'")
listing("list_empty_range", RangeQuery(prefix=k(0)[:18], start=k(2000)), "SELECT key, value FROM orders_kv WHERE false")


def counting(name: str, q: RangeQuery, where: str):
    def fn(spark, d):
        return T.count(V.orders_kv(spark, d), q)

    fn.__name__ = name
    query(f"SELECT count(*) AS n FROM orders_kv WHERE {where}", "orders_kv")(fn)


counting("count_all", RangeQuery(), "true")
counting("count_range", RangeQuery(start=k(100), end=k(900)), f"key >= '{k(100)}' AND key < '{k(900)}'")
counting("count_prefix", RangeQuery(prefix=k(0)[:18]), f"starts_with(key, '{k(0)[:18]}')")

# shards
_CASE = "CASE " + " ".join(f"WHEN key >= '{b}' THEN {i}" for b, i in sorted(BOUNDS, reverse=True)) + " END"
ROUTED = f"(SELECT key, value, CAST({_CASE} AS BIGINT) AS shard_id FROM orders_kv)"


def routed(spark, d):
    return shards.route(V.orders_kv(spark, d), BOUNDS)


def shard_frame(spark):
    bounds = sorted(BOUNDS)
    ends = [b for b, _ in bounds[1:]] + [""]
    return spark.createDataFrame([(i, 1, b, e) for (b, i), e in zip(bounds, ends, strict=True)], "shard_id long, table_id long, first_key string, last_key string")


@query(f"SELECT shard_id, count(*) AS n FROM {ROUTED} GROUP BY shard_id", "orders_kv")
def count_per_shard(spark, d):
    return routed(spark, d).groupBy("shard_id").agg(F.count("*").alias("n"))


@query(f"SELECT key, shard_id FROM {ROUTED}", "orders_kv")
def shard_route_array(spark, d):
    return routed(spark, d).select("key", "shard_id")


@query(f"SELECT key, shard_id FROM {ROUTED}", "orders_kv")
def shard_route(spark, d):
    return shards.route_join(V.orders_kv(spark, d), shard_frame(spark)).select("key", "shard_id")


@query(f"SELECT shard_id, count(*) AS n_keys, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS shard_size, min(key) AS min_key, max(key) AS max_key FROM {ROUTED} GROUP BY shard_id", "orders_kv")
def shard_stats(spark, d):
    return shards.stats(routed(spark, d))


@query(f"SELECT shard_id, key AS split_key FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY key) - 1 AS p, count(*) OVER (PARTITION BY shard_id) AS n FROM {ROUTED}) WHERE p = n // 2 AND n > 1", "orders_kv")
def shard_midpoint(spark, d):
    return shards.midpoints(routed(spark, d))


@query(f"SELECT CASE WHEN shard_id = 3 AND key >= '{k(3000)}' THEN 5 ELSE shard_id END AS shard_id, count(*) AS n FROM {ROUTED} GROUP BY 1", "orders_kv")
def shard_split(spark, d):
    after = shards.split(shard_frame(spark), 3, k(3000), 5)
    return shards.route(V.orders_kv(spark, d), shards.bounds_of(after)).groupBy("shard_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS faults")
def shard_tiling(spark, d):
    return shards.tiling_faults(shards.split(shard_frame(spark), 3, k(3000), 5)).agg(F.count("*").alias("faults"))


# log
LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM event_log WHERE op IN ('S', 'D')) WHERE rn = 1)"


@query(f"SELECT key, value FROM {LAST} WHERE op = 'S'", "event_log")
def lww_state(spark, d):
    return log.state(V.event_log(spark, d))


@query(f"SELECT count(*) AS n FROM {LAST} WHERE op = 'S'", "event_log")
def lww_live_count(spark, d):
    return log.state(V.event_log(spark, d)).agg(F.count("*").alias("n"))


FOLD = """(SELECT *, CASE WHEN first_value(op) OVER g = 'S' THEN first_value(value) OVER g END AS base, first_value(op) OVER g AS base_op,
  sum(number) OVER (PARTITION BY key, grp ORDER BY seq ROWS UNBOUNDED PRECEDING) AS total FROM
  (SELECT *, sum(CASE WHEN op = 'A' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS grp FROM event_log)
  WINDOW g AS (PARTITION BY key, grp ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
RESULT = "CASE WHEN base_op <> 'S' THEN total WHEN regexp_full_match(base, '-?[0-9]+') THEN CAST(base AS BIGINT) + total END"


@query(f"SELECT key, seq, number, CAST({RESULT} AS BIGINT) AS result, CASE WHEN {RESULT} IS NULL THEN 'FAILED' ELSE 'OK' END AS status FROM {FOLD} WHERE op = 'A'", "event_log")
def counter_running(spark, d):
    return log.running_adds(V.event_log(spark, d))


@query(f"SELECT key, CASE WHEN op = 'A' AND {RESULT} IS NOT NULL THEN CAST(CAST({RESULT} AS BIGINT) AS VARCHAR) ELSE base END AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {FOLD}) WHERE rn = 1 AND op <> 'D'", "event_log")
def counter_state(spark, d):
    return log.counter_state(V.event_log(spark, d))


ASKS = f"(SELECT *, sum(CASE WHEN op = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY key, grp ORDER BY seq ROWS UNBOUNDED PRECEDING) AS asks, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {FOLD})"
FIRST = "CASE WHEN base_op <> 'S' THEN 1 WHEN regexp_full_match(base, '-?[0-9]+') THEN CAST(base AS BIGINT) END"


def sequence_log(spark, d):
    return V.event_log(spark, d).withColumn("op", F.when(F.col("op") == "A", "Q").otherwise(F.col("op")))


@query(f"SELECT key, seq, CAST({FIRST} + asks - 1 AS BIGINT) AS result FROM {ASKS} WHERE op = 'A'", "event_log")
def sequence_next(spark, d):
    return log.sequence_numbers(sequence_log(spark, d))


@query(f"SELECT key, coalesce(CAST({FIRST} + 1000 * CAST(ceil(asks / 1000) AS BIGINT) AS VARCHAR), base) AS value FROM {ASKS} WHERE rn = 1 AND asks > 0", "event_log")
def sequence_state(spark, d):
    return log.sequence_state(sequence_log(spark, d))


# every kind of command: position 500 truncates, every third add asks for a number of a sequence
MIXED = """mixed AS (SELECT seq, key, CASE WHEN op = 'A' AND seq % 3 = 0 THEN 'Q' ELSE op END AS op, value, number FROM event_log WHERE seq > 500),
  grouped AS (SELECT *, sum(CASE WHEN op IN ('S', 'D') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS grp FROM mixed),
  folded AS (SELECT key, max(CASE WHEN op IN ('S', 'D') THEN op END) AS base_op, max(CASE WHEN op = 'S' THEN value END) AS base, coalesce(sum(number) FILTER (op = 'A'), 0) AS total, count(*) FILTER (op = 'Q') AS asks,
    arg_min(op, seq) FILTER (op IN ('A', 'Q')) AS first_op FROM (SELECT *, max(grp) OVER (PARTITION BY key) AS newest FROM grouped) WHERE grp = newest GROUP BY key)"""
MIXED_STATE = f""", {MIXED} SELECT key, CASE WHEN base_op = 'S' AND (first_op IS NULL OR NOT regexp_full_match(base, '-?[0-9]+')) THEN base
  ELSE CAST(CAST(CASE WHEN base_op = 'S' THEN CAST(base AS BIGINT) WHEN first_op = 'Q' THEN 1 ELSE 0 END + total + 1000 * ceil(asks / 1000) AS BIGINT) AS VARCHAR) END AS value
  FROM folded WHERE base_op = 'S' OR first_op IS NOT NULL"""


def mixed_log(events):
    op = F.when(F.col("seq") == 500, "T").when((F.col("op") == "A") & (F.col("seq") % 3 == 0), "Q").otherwise(F.col("op"))
    return events.withColumn("op", op).withColumn("number", F.when(op == "A", F.col("number")))


@query(MIXED_STATE, "event_log")
def mixed_state(spark, d):
    return log.counter_state(log.after_truncate(mixed_log(V.event_log(spark, d))))


@query(MIXED_STATE, "event_log")
def catch_up_state(spark, d):
    """A snapshot of the first part of the log, then what came behind it: the state of the whole log."""
    rows = mixed_log(V.event_log(spark, d))
    snapshot = log.carried(rows.filter("seq <= 700"))
    return log.folded_state(log.carried(snapshot.unionByName(log.at_least(rows, 700), allowMissingColumns=True)))


@query("SELECT key, op, count(*) AS n FROM event_log WHERE seq > 300 GROUP BY key, op", "event_log")
def replay_once(spark, d):
    """A log of which a part was sent twice, applied behind a position: each command counts once."""
    rows = V.event_log(spark, d)
    twice = rows.unionByName(rows.filter("seq % 2 = 0")).unionByName(rows.limit(1).withColumn("op", F.lit(None).cast("string")).withColumn("seq", F.lit(-1).cast("long")))
    return log.at_least(log.applied(twice), 300).groupBy("key", "op").agg(F.count("*").alias("n"))


@query(f"SELECT key, value FROM {LAST.replace('event_log WHERE', 'event_log WHERE seq > 500 AND')} WHERE op = 'S'", "event_log")
def truncate_fold(spark, d):
    rows = V.event_log(spark, d).withColumn("op", F.when(F.col("seq") == 500, "T").otherwise(F.col("op")))
    return log.state(log.after_truncate(rows))


PENDING = "pending AS (SELECT key, CASE WHEN seq % 4 = 0 THEN 'D' ELSE 'S' END AS op, 'p' || seq AS value FROM (SELECT printf('%021d', user_id) AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)"


def pending(spark, d):
    e = V.read(spark, d, "events")
    return e.select(K.encode_int(F.col("user_id")).alias("key"), F.when(F.col("event_id") % 4 == 0, "D").otherwise("S").alias("op"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("seq"))


OVER = "overlaid AS (SELECT coalesce(p.key, c.key) AS key, CASE WHEN p.key IS NULL THEN c.value ELSE p.value END AS value FROM customer_kv c FULL JOIN pending p ON p.key = c.key WHERE p.op IS NULL OR p.op = 'S')"


@query(f", {PENDING}, {OVER} SELECT key, value FROM overlaid WHERE key >= '{k(3)}' ORDER BY key LIMIT 200", "customer_kv")
def overlay_list(spark, d):
    return log.overlay_list(V.customer_kv(spark, d), pending(spark, d), RangeQuery(start=k(3), limit=200))


@query(f", {PENDING}, {OVER} SELECT a.key, o.value, CASE WHEN o.key IS NULL THEN 'FAILED' ELSE 'OK' END AS status FROM {ASKED} a LEFT JOIN overlaid o ON o.key = a.key", "customer_kv")
def overlay_get(spark, d):
    return log.overlay_get(asked(spark, d), V.customer_kv(spark, d), pending(spark, d))


@query("SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY chunk DESC) AS rn FROM (SELECT key, value, 'S' AS op, 1 AS chunk FROM orders_kv UNION ALL SELECT key, value || '2', CASE WHEN value = 'P' THEN 'D' ELSE 'S' END, 2 FROM orders_kv WHERE value <> 'O')) WHERE rn = 1 AND op = 'S'", "orders_kv")
def merge_chunks(spark, d):
    old = V.orders_kv(spark, d).select("key", F.lit("S").alias("op"), "value", F.lit(1).alias("seq"))
    new = V.orders_kv(spark, d).filter("value <> 'O'").select("key", F.when(F.col("value") == "P", "D").otherwise("S").alias("op"), F.concat("value", F.lit("2")).alias("value"), F.lit(2).alias("seq"))
    return log.merged(old, new)


@query("SELECT key, op, count(*) AS n FROM event_log WHERE op IN ('S', 'D') GROUP BY key, op", "event_log")
def bulk_export(spark, d):
    return V.event_log(spark, d).filter(F.col("op").isin("S", "D")).groupBy("key", "op").agg(F.count("*").alias("n"))


# transactions: the last command of a transaction's id commits it, unless the id is a multiple of 5
COMMIT = "(SELECT txn_id, max(seq) + 0.5 AS apply_seq FROM event_log WHERE txn_id IS NOT NULL AND txn_id % 5 <> 0 GROUP BY txn_id)"


def txn_log(spark, d):
    rows = V.event_log(spark, d).withColumn("seq", F.col("seq") * 2)
    marks = rows.filter("txn_id is not null and txn_id % 5 <> 0").groupBy("txn_id").agg((F.max("seq") + 1).alias("seq")).withColumn("op", F.lit("COMMIT"))
    return rows.unionByName(marks, allowMissingColumns=True)


@query(f"SELECT key, value FROM (SELECT e.*, row_number() OVER (PARTITION BY key ORDER BY coalesce(c.apply_seq, e.seq) DESC, e.seq DESC) AS rn FROM event_log e LEFT JOIN {COMMIT} c ON c.txn_id = e.txn_id WHERE op IN ('S', 'D') AND (e.txn_id IS NULL OR c.txn_id IS NOT NULL)) WHERE rn = 1 AND op = 'S'", "event_log")
def txn_committed_state(spark, d):
    return transactions.committed_state(txn_log(spark, d))


@query("SELECT txn_id, count(*) AS n FROM event_log WHERE txn_id % 5 = 0 GROUP BY txn_id", "event_log")
def txn_discarded(spark, d):
    return transactions.discarded(txn_log(spark, d)).groupBy("txn_id").agg(F.count("*").alias("n"))


# one step of the walk is a release that is due before the next event, or the event
LOCKS = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY major_key ORDER BY ts_ms, session_id, action) AS i FROM
    (SELECT CAST(user_id % 20 AS VARCHAR) AS major_key, user_id AS session_id, epoch_us(ts) // 2000000 AS ts_ms, CASE event_type WHEN 'error' THEN 'unlock' ELSE 'lock' END AS action FROM events)),
  n AS (SELECT major_key, max(i) AS n FROM e GROUP BY major_key),
  walk AS (SELECT major_key, 0::BIGINT AS i, NULL::STRUCT(s BIGINT, asked BIGINT, granted BIGINT) AS holder, []::STRUCT(s BIGINT, asked BIGINT)[] AS waiting,
      []::STRUCT(session_id BIGINT, asked_ms BIGINT, granted_ms BIGINT, released_ms BIGINT, outcome VARCHAR)[] AS done FROM n
    UNION ALL
    SELECT major_key, CASE WHEN due THEN i ELSE i + 1 END,
      CASE WHEN frees THEN CASE WHEN len(live) > 0 THEN {'s': live[1].s, 'asked': live[1].asked, 'granted': now} END WHEN action = 'lock' AND holder IS NULL THEN {'s': s, 'asked': now, 'granted': now} ELSE holder END,
      CASE WHEN frees THEN live[2:] WHEN action = 'lock' AND holder IS NOT NULL THEN list_append(waiting, {'s': s, 'asked': now}) WHEN action = 'unlock' THEN list_filter(waiting, lambda x: x.s <> s) ELSE waiting END,
      CASE WHEN frees THEN list_concat([{'session_id': holder.s, 'asked_ms': holder.asked, 'granted_ms': holder.granted, 'released_ms': now, 'outcome': CASE WHEN due THEN 'lock expired' ELSE 'unlocked' END}],
          list_transform(list_filter(waiting, lambda x: now - x.asked >= 3000), lambda x: {'session_id': x.s, 'asked_ms': x.asked, 'granted_ms': NULL::BIGINT, 'released_ms': x.asked + 3000, 'outcome': 'wait expired'}))
        WHEN action = 'unlock' THEN list_transform(list_filter(waiting, lambda x: x.s = s), lambda x: {'session_id': x.s, 'asked_ms': x.asked, 'granted_ms': NULL::BIGINT, 'released_ms': now, 'outcome': 'gave up'})
        ELSE [] END
    FROM (SELECT *, due OR (action = 'unlock' AND coalesce(holder.s = s, false)) AS frees, list_filter(waiting, lambda x: now - x.asked < 3000) AS live FROM
      (SELECT *, CASE WHEN due THEN holder.granted + 3000 ELSE ts_ms END AS now FROM
        (SELECT w.major_key, w.i, w.holder, w.waiting, e.session_id AS s, e.ts_ms, e.action, w.holder IS NOT NULL AND (e.i IS NULL OR w.holder.granted + 3000 <= e.ts_ms) AS due
         FROM walk w JOIN n ON n.major_key = w.major_key LEFT JOIN e ON e.major_key = w.major_key AND e.i = w.i + 1 WHERE w.i < n.n OR w.holder IS NOT NULL))))
SELECT major_key, d.session_id, d.asked_ms, d.granted_ms, d.released_ms, d.outcome FROM (SELECT major_key, unnest(done) AS d FROM walk)"""


@query(LOCKS)
def lock_simulation(spark, d):
    e = V.read(spark, d, "events")
    action = F.when(F.col("event_type") == "error", "unlock").otherwise("lock")
    # 2,000 times as fast, so that events meet; whatever the session's time zone
    ts = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 2000")
    return transactions.lock_grants(e.select((F.col("user_id") % 20).cast("string").alias("major_key"), F.col("user_id").alias("session_id"), ts.alias("ts_ms"), action.alias("action")))


# indexes
@query("SELECT i.key AS index_key, c.key, c.value FROM segment_index i JOIN customer_kv c ON c.key = i.value", "segment_index", "customer_kv")
def index_lookup(spark, d):
    return indexes.lookup(V.segment_index(spark, d), V.customer_kv(spark, d))


@query("SELECT i.key AS index_key, c.key, c.value FROM segment_index i JOIN customer_kv c ON c.key = i.value WHERE starts_with(i.key, 'BUILDING|')", "segment_index", "customer_kv")
def index_scan_fetch(spark, d):
    return indexes.scan_fetch(V.segment_index(spark, d), V.customer_kv(spark, d), RangeQuery(prefix="BUILDING|"))


@query("SELECT key, value AS expected, CASE WHEN right(key, 1) = '3' THEN NULL ELSE 'x' END AS found, CASE WHEN right(key, 1) = '3' THEN 'missing' ELSE 'different' END AS fault FROM segment_index WHERE right(key, 1) IN ('3', '5')", "segment_index")
def index_violations(spark, d):
    good = V.segment_index(spark, d)
    bad = good.filter(F.substring("key", -1, 1) != "3").withColumn("value", F.when(F.substring("key", -1, 1) == "5", "x").otherwise(F.col("value")))
    return indexes.violations(good, bad)


@query("SELECT coalesce(a.key, b.key) AS key, a.value AS left_value, b.value AS right_value, CASE WHEN b.key IS NULL THEN 'left only' WHEN a.key IS NULL THEN 'right only' ELSE 'different' END AS difference FROM orders_kv a FULL JOIN customer_kv b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value OR a.key IS NULL OR b.key IS NULL", "orders_kv", "customer_kv")
def db_diff(spark, d):
    return indexes.difference(V.orders_kv(spark, d), V.customer_kv(spark, d))


@query(f"SELECT shard_id, count(*) AS n_a, sum(CASE WHEN value <> 'P' THEN 1 ELSE 0 END)::BIGINT AS n_b, count(*) = sum(CASE WHEN value <> 'P' THEN 1 ELSE 0 END) AS same FROM {ROUTED} GROUP BY shard_id", "orders_kv")
def replica_counts(spark, d):
    return indexes.replica_counts(routed(spark, d), routed(spark, d).filter("value <> 'P'"))


# map and reduce
@query("SELECT key FROM docs_kv WHERE contains(value, 'idiot')", "docs_kv")
def map_contains(spark, d):
    return mapreduce.contains(V.docs_kv(spark, d), "idiot").select("key")


@query("SELECT key FROM docs_kv WHERE starts_with(value, 'The')", "docs_kv")
def map_starts_with(spark, d):
    return mapreduce.starts_with(V.docs_kv(spark, d), "The").select("key")


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(value), '[a-z]+')) AS w FROM customer_kv) GROUP BY w", "customer_kv")
def word_count(spark, d):
    return mapreduce.word_counts(V.customer_kv(spark, d))


@query("SELECT w[i] || ' ' || w[i + 1] AS ngram, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w FROM part)) GROUP BY 1")
def ngram_count(spark, d):
    return mapreduce.ngram_counts(V.read(spark, d, "part").select(F.col("p_name").alias("value")))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_value_extract(spark, d):
    return V.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT conv_id, turn, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE rn <= 2")
def newest_n_per_parent(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    turns = V.read(spark, d, "conversations").select("conv_id", "turn").distinct()
    return turns.withColumn("place", F.row_number().over(w)).filter("place <= 2")


@query("SELECT f.follower, e.key, e.value FROM (SELECT printf('%021d', user_id) AS key, event_type AS value FROM events) e JOIN (SELECT printf('%021d', o_custkey) AS key, unnest(list(DISTINCT o_orderkey)) AS follower FROM orders GROUP BY 1) f ON f.key = e.key")
def fanout(spark, d):
    e = V.read(spark, d, "events").select(K.encode_int(F.col("user_id")).alias("key"), F.col("event_type").alias("value"))
    f = V.read(spark, d, "orders").select(K.encode_int(F.col("o_custkey")).alias("key"), F.col("o_orderkey").alias("follower")).distinct()
    return indexes.fan_out(e, f)


@query("SELECT l_orderkey AS chunk, l_linenumber AS place, before, l_partkey AS key FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber)) WHERE before >= l_partkey")
def key_order_check(spark, d):
    from lexkv.sources.storage import order_faults

    chunk = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("key"))
    chunk = chunk.groupBy("chunk", "place").agg(F.min("key").alias("key"))
    return order_faults(chunk, "chunk")


@query("SELECT o_orderkey, printf('%013d', o_orderkey) AS id_key, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS time_key, strftime(o_orderdate, '%Y-%m-%d') AS date_key, '/' || printf('%021d', o_custkey) || '/' || printf('%021d', o_orderkey) AS composite_key, md5(o_orderstatus) AS md5_key FROM orders")
def encode_keys(spark, d):
    c = F.col
    return V.read(spark, d, "orders").select("o_orderkey", K.encode_int(c("o_orderkey"), 13).alias("id_key"), K.encode_timestamp(c("o_orderdate")).alias("time_key"), K.encode_date(c("o_orderdate")).alias("date_key"),
                                             K.composite(K.encode_int(c("o_custkey")), K.encode_int(c("o_orderkey"))).alias("composite_key"), K.md5_key(c("o_orderstatus")).alias("md5_key"))


@query("SELECT seq, CASE WHEN op = 'S' THEN 'INSERT INTO t VALUES (''' || key || ''', ''' || value || ''');' ELSE 'DELETE FROM t WHERE key = ''' || key || ''';' END AS statement FROM event_log WHERE op IN ('S', 'D')", "event_log")
def log_as_sql(spark, d):
    from lexkv.sources.storage import log_as_sql as statements

    return statements(V.event_log(spark, d), "t")


@query("SELECT event_type AS node, count(*) AS requests, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def request_statistics(spark, d):
    return V.read(spark, d, "events").groupBy(F.col("event_type").alias("node")).agg(F.count("*").alias("requests"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT key, first_word AS value FROM (SELECT c.key, min(CAST(o.o_orderkey AS VARCHAR)) AS first_word FROM customer_kv c JOIN orders o ON c.key = printf('%021d', o.o_custkey) GROUP BY 1)", "customer_kv")
def map_reduce(spark, d):
    kv = V.read(spark, d, "orders").select(K.encode_int(F.col("o_custkey")).alias("key"), F.col("o_orderkey").cast("string").alias("value"))
    return mapreduce.map_reduce(kv, lambda key, value: [(key, value)], F.min("value").alias("value"))


@query("SELECT key, value, upper(value) AS out FROM orders_kv", "orders_kv")
def extension(spark, d):
    def upper(key: pd.Series, value: pd.Series) -> pd.Series:
        return value.str.upper()

    return mapreduce.extension(V.orders_kv(spark, d), upper)


@query("SELECT seq, op, key FROM event_log WHERE seq > 900", "event_log")
def change_feed(spark, d):
    from lexkv.streaming.fold import change_feed as feed

    return feed(V.event_log(spark, d).withColumn("version", F.col("seq")), 900).select("seq", "op", "key")


@query("SELECT table_name AS name, n_shards FROM (VALUES ('orders', 3::BIGINT), ('parts', 1::BIGINT)) t(table_name, n_shards)")
def catalog_tables(spark, d):
    from lexkv.operators.catalog import Catalog

    c = Catalog.empty(spark).register_server("a:1").create_quorum("q", [1]).create_database("db").create_table(1, 1, "orders").create_table(1, 1, "parts")
    c = c.split_shard(1, k(400)).split_shard(1, k(200))
    return c["tables"].join(c["shards"].groupBy("table_id").agg(F.count("*").alias("n_shards")), "table_id").select("name", "n_shards")


@query(MIXED_STATE, "event_log")
def stream_fold(spark, d):
    """The state of commands of every kind, kept by a stream over the events that runs until it has read them all."""
    from lexkv.sources.storage import scratch
    from lexkv.streaming import fold

    root, schema = scratch(spark, "stream-fold"), V.read(spark, d, "events").schema
    rows = mixed_log(V.commands(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")))  # a pattern, as the table may be one file
    run = fold.fold_stream(rows, f"{root}/state", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    done = [p["batchId"] for p in run.recentProgress if p["numInputRows"]]
    return fold.folded(spark, f"{root}/state", max(done)) if done else log.folded_state(log.carried(mixed_log(V.event_log(spark, d))))


@query("SELECT seq, op, key, value FROM (SELECT *, sum(size) OVER (ORDER BY seq DESC) AS total FROM (SELECT *, coalesce(strlen(key), 0) + coalesce(strlen(value), 0) AS size FROM event_log)) WHERE total <= 100000", "event_log")
def log_retained(spark, d):
    from lexkv.sources.storage import retained

    return retained(V.event_log(spark, d), 100_000).select("seq", "op", "key", "value")


ENDED = "(SELECT txn_id, arg_min(op, seq) AS \"end\", min(seq) AS apply_seq FROM marked WHERE op IN ('COMMIT', 'ROLLBACK') GROUP BY txn_id)"
MARKED = "marked AS (SELECT seq, CASE WHEN op = 'D' THEN 'ROLLBACK' WHEN number > 90 THEN 'COMMIT' ELSE op END AS op, seq // 30 AS txn_id FROM event_log)"


@query(f", {MARKED} SELECT m.txn_id, m.seq, m.op, e.\"end\" FROM marked m JOIN {ENDED} e ON e.txn_id = m.txn_id WHERE m.seq > e.apply_seq", "event_log")
def txn_rejected(spark, d):
    op = F.when(F.col("op") == "D", "ROLLBACK").when(F.col("number") > 90, "COMMIT").otherwise(F.col("op"))
    return transactions.rejected(V.event_log(spark, d).select("seq", op.alias("op"), F.floor(F.col("seq") / 30).alias("txn_id")))


@query(f"SELECT shard_id, sum(strlen(key) + strlen(value))::BIGINT AS shard_size FROM {ROUTED} WHERE shard_id <> 4 GROUP BY shard_id HAVING sum(strlen(key) + strlen(value)) > 20000 AND min(key) < max(key)", "orders_kv")
def shard_split_policy(spark, d):
    tables = spark.createDataFrame([(1, False)], "table_id long, is_frozen boolean")
    busy = spark.createDataFrame([(4,)], "shard_id long")
    return shards.to_split(shards.stats(routed(spark, d)), shard_frame(spark), tables, 20_000, busy)


@query(f"SELECT shard_id, key AS split_key FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY key) - 1 AS p, count(*) OVER (PARTITION BY shard_id) AS n, sum(strlen(key) + strlen(value)) OVER (PARTITION BY shard_id) AS size FROM {ROUTED}) WHERE p = n // 2 AND n > 1 ORDER BY size DESC, shard_id LIMIT 1", "orders_kv")
def shard_next_split(spark, d):
    tables = spark.createDataFrame([(1, False)], "table_id long, is_frozen boolean")
    rows, frame = routed(spark, d), shard_frame(spark)
    return shards.next_split(shards.to_split(shards.stats(rows), frame, tables, 0), shards.midpoints(rows), frame)


@query("SELECT coalesce(c.key, a.key) AS key, coalesce(c.value, a.value) AS value FROM customer_kv c FULL JOIN (SELECT DISTINCT key, 'new' AS value FROM " + ASKED + ") a ON a.key = c.key", "customer_kv")
def insert_misses(spark, d):
    return indexes.inserted_misses(V.customer_kv(spark, d), asked(spark, d).withColumn("value", F.lit("new")))


@query("SELECT a.key, CASE WHEN done THEN 'new' ELSE o.value END AS value, done FROM (SELECT a.key, CASE WHEN right(a.key, 1) = '4' THEN o.key IS NULL ELSE coalesce(o.value = 'F', false) END AS done FROM " + ASKED + " a LEFT JOIN orders_kv o ON o.key = a.key) a LEFT JOIN orders_kv o ON o.key = a.key", "orders_kv")
def conditional_writes(spark, d):
    asks = asked(spark, d).select("key", F.when(F.substring("key", -1, 1) != "4", "F").alias("expected"), F.lit("new").alias("value"))
    return log.conditional_writes(V.orders_kv(spark, d), asks)


@query("SELECT p_partkey, instr(p_name, 'a') AS place, regexp_full_match(p_name, '[ -\x7f]*') AS printable, hex(p_name) AS hexed, left(p_name, 3) AS head, lpad(CAST(CAST(p_partkey AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0') AS signed_key, CAST(p_partkey AS VARCHAR) AS part FROM part")
def scalar_functions(spark, d):
    c = F.col
    return V.read(spark, d, "part").select("p_partkey", K.byte_find(c("p_name"), "a").cast("long").alias("place"), K.is_printable(c("p_name")).alias("printable"), F.hex("p_name").alias("hexed"), F.substring("p_name", 1, 3).alias("head"),
                                           K.encode_signed(c("p_partkey")).alias("signed_key"), K.composite_part(K.composite(c("p_name"), c("p_partkey").cast("string")), 1).alias("part"))
