"""Scan contract, log folds against a dictionary, transactions, catalog rules, storage and streams."""

import random

import pytest
from pyspark.sql import functions as F

from lexkv.functions import keys as K
from lexkv.operators import log as L
from lexkv.operators import mapreduce, shards, transactions
from lexkv.operators import table as T
from lexkv.operators.catalog import Catalog, CatalogError
from lexkv.operators.table import RangeQuery
from lexkv.sources import storage
from lexkv.streaming import fold


def key(i):
    return f"{i:013d}"


@pytest.fixture(scope="module")
def grid(spark):
    return spark.range(22000).select(F.format_string("%013d", "id").alias("key"), F.lit("v").alias("value")).cache()


# (start, end, prefix, backward, limit, expected rows): fixed values of the scan contract
CASES = [
    (100, None, "", False, 111, 111), (100, None, "", True, 111, 101), (100, None, "", True, 100, 100), (None, None, "", False, None, 22000),
    (None, None, "", True, None, 22000), (None, None, "", False, 1234, 1234), (None, None, "", True, 1234, 1234), (None, 15000, "", False, None, 15000),
    (None, 15000, "", True, None, 6999), (10000, 15000, "", False, None, 5000), (15000, 10000, "", True, None, 5000), (10000, 15000, "0000000012", False, None, 1000),
    (15000, 10000, "00000000120", True, None, 100), (None, None, "0000000012", False, None, 1000), (None, None, "00000000120", True, None, 100), (None, None, "000000002", False, None, 2000),
    (None, None, "000000002", True, None, 2000), (13000, None, "0000000012", False, None, 0), (12000, None, "0000000013", True, None, 0), (4000, 7000, "", False, None, 3000),
    (7000, 4000, "", True, None, 3000), (18000, 22000, "", False, None, 4000), (22000, 18000, "", True, None, 3999), (22000, 21000, "", True, None, 999), (None, None, "0000000007", True, None, 1000),
]


@pytest.mark.parametrize("start,end,prefix,back,limit,want", CASES)
def test_scan_contract(grid, start, end, prefix, back, limit, want):
    q = RangeQuery(prefix or None, None if start is None else key(start), None if end is None else key(end), limit, back)
    rows = [r.key for r in T.list_keys(grid, q).collect()]
    assert len(rows) == want and rows == sorted(rows, reverse=back)


def test_pages_skip_and_binary(spark, grid):
    seen = [r.key for p in T.pages(grid, RangeQuery(start=key(21000), limit=250), 100) for r in p.collect()]
    assert seen == [key(i) for i in range(21000, 21250)]
    back = [r.key for p in T.pages(grid, RangeQuery(start=key(5), reverse=True), 2) for r in p.collect()]
    assert back == [key(i) for i in range(5, -1, -1)]
    kv = spark.createDataFrame([(bytearray(b"\xff\x01"),), (bytearray(b"\xff"),), (bytearray(b"a\xff\x02"),), (bytearray(b"a"),)], "key binary")
    assert [bytes(r.key) for r in T.list_keys(kv).collect()] == [b"a", b"a\xff\x02", b"\xff", b"\xff\x01"]
    assert [bytes(r.key) for r in T.list_keys(kv, RangeQuery(prefix=b"a\xff", reverse=True)).collect()] == [b"a\xff\x02"]
    assert K.prefix_successor(b"a\xff") == b"b" and K.prefix_successor(b"\xff") is None and K.prefix_successor("az") == "a{"
    with pytest.raises(ValueError):
        T.get(grid, "")
    assert T.list_key_values(grid, RangeQuery(limit=0)).count() == 0


def test_pushdown(spark, tmp_path, grid):
    storage.write_sorted(grid, f"{tmp_path}/t", 4)
    plan = T.list_keys(storage.read_table(spark, f"{tmp_path}/t"), RangeQuery(prefix="0000000012"))._jdf.queryExecution().toString()
    assert "StringStartsWith(key" in plan and "GreaterThanOrEqual(key" in plan


def commands(n=1500, seed=5):
    r = random.Random(seed)
    out = []
    for seq in range(1, n):
        op = r.choice("SDAAA")
        out.append((seq, op, f"k{r.randrange(25)}", r.choice(["5", "x", " 3", "", "-7", "+1", "12"]) if op == "S" else None, r.randrange(-50, 50) if op == "A" else None))
    return out


def test_fold_equals_dictionary(spark):
    rows = commands()
    log = spark.createDataFrame(rows, fold.LOG)
    state, results = {}, {}
    for seq, op, k, value, number in rows:
        if op == "S":
            state[k] = value
        elif op == "D":
            state.pop(k, None)
        else:
            base = state.get(k, "")
            ok = base == "" or base.lstrip("-").isdigit() and not base.startswith("--")
            results[seq] = int(base or 0) + number if ok else None
            if ok:
                state[k] = str(results[seq])
    assert {r.key: r.value for r in L.counter_state(log).collect()} == state
    assert {r.seq: r.result for r in L.running_adds(log).collect()} == results


def test_overlay_sequences_and_conditions(spark):
    kv = spark.createDataFrame([("a", "1"), ("c", "3"), ("e", "5")], "key string, value string")
    pending = spark.createDataFrame([(1, "S", "b", "2"), (2, "D", "c", None), (3, "D", "bb", None), (4, "S", "b", "22")], "seq long, op string, key string, value string")
    assert [tuple(r) for r in L.overlay_list(kv, pending, RangeQuery(limit=2)).collect()] == [("a", "1"), ("b", "22")]
    assert [r.key for r in L.overlay_list(kv, pending, RangeQuery(reverse=True, end="a")).collect()] == ["e", "b"]
    log = spark.createDataFrame([(1, "Q", "s", None), (2, "Q", "s", None), (3, "S", "s", "50"), (4, "Q", "s", None)], "seq long, op string, key string, value string")
    assert {r.seq: r.result for r in L.sequence_numbers(log).collect()} == {1: 1, 2: 2, 4: 50}
    assert L.sequence_state(log).first().value == "1050"
    asked = spark.createDataFrame([("a", None, "x"), ("z", None, "x"), ("c", "3", "y"), ("e", "4", "y")], "key string, expected string, value string")
    assert {r.key: (r.value, r.done) for r in L.conditional_writes(kv, asked).collect()} == {"a": ("1", False), "z": ("x", True), "c": ("y", True), "e": ("5", False)}
    texts = spark.createDataFrame([("5",), ("+5",), (" 5",), ("",), ("-",), ("1.5",), ("9223372036854775808",)], "t string")
    assert [r[0] for r in texts.select(K.int_of_text(F.col("t"))).collect()] == [5, None, None, 0, None, None, None]
    signed = spark.createDataFrame([(-5,), (3,), (-(2**63),), (2**63 - 1,)], "n long").select("n", K.encode_signed(F.col("n")).alias("k"))
    assert [r.n for r in signed.orderBy("k").collect()] == [-(2**63), -5, 3, 2**63 - 1]


def test_transactions_apply_as_units(spark):
    rows = [(1, "S", "a", "1", 7), (2, "S", "a", "2", None), (3, "COMMIT", None, None, 7), (4, "S", "b", "1", 8), (5, "ROLLBACK", None, None, 8)]
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string, txn_id long")
    assert {r.key: r.value for r in transactions.committed_state(log).collect()} == {"a": "1"}
    events = spark.createDataFrame([("m", 1, 0, "lock"), ("m", 2, 10, "lock"), ("m", 3, 20, "lock"), ("m", 1, 100, "unlock"), ("m", 9, 4000, "expire_all")], "major_key string, session_id long, ts_ms long, action string")
    got = {r.session_id: (r.granted_ms, r.released_ms, r.outcome) for r in transactions.lock_grants(events).collect()}
    assert got == {1: (0, 100, "unlocked"), 2: (100, 3100, "lock expired"), 3: (None, 3020, "wait expired")}


def test_catalog_rules(spark):
    c = Catalog.empty(spark).register_server("a").register_server("b").create_quorum("q", [1]).create_database("db").create_table(1, 1, "t")
    for bad in (lambda: c.create_database("db"), lambda: c.create_table(1, 9, "u"), lambda: c.create_database("é"), lambda: c.create_database("x" * 1025), lambda: c.delete_quorum(1), lambda: c.unregister_server(1), lambda: c.create_quorum("r", [5]), lambda: c.remove_node(1, 1), lambda: c.split_shard(1, "")):
        with pytest.raises(CatalogError):
            bad()
    s = c.rename_database(1, "db").split_shard(1, "m")
    assert shards.tiling_faults(s["shards"]).count() == 0 and s["shards"].count() == 2
    assert s.truncate_table(1)["shards"].count() == 1
    with pytest.raises(CatalogError):
        s.add_node(1, 2).truncate_table(1)
    assert s.add_node(1, 2).activate_node(1, 2).remove_node(1, 1).one("quorums", quorum_id=1).active_nodes == [2]
    assert s.delete_database(1)["shards"].count() == 0
    again = Catalog.from_json(s.to_json())
    assert sorted(map(tuple, again["shards"].collect())) == sorted(map(tuple, s["shards"].collect()))
    assert s.freeze_database(1).one("tables", table_id=1).is_frozen


def test_storage_and_streams(spark, tmp_path):
    rows = [(s, o, k, v, n) for s, o, k, v, n in commands(600, 9) if o != "A"]
    log = spark.createDataFrame(rows, fold.LOG)
    want = sorted(map(tuple, L.state(log).collect()))
    half = log.filter("seq < 300"), log.filter("seq >= 300")
    for n, part in enumerate(half):
        part.coalesce(1).write.parquet(f"{tmp_path}/c{n}")
        storage.append_log(part.coalesce(1), f"{tmp_path}/log")
    storage.compact(spark, [f"{tmp_path}/c0", f"{tmp_path}/c1"], f"{tmp_path}/whole")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/whole").select("key", "value").collect())) == want
    assert storage.replay(spark, f"{tmp_path}/log", 299).count() == half[1].count()
    storage.snapshot(L.state(half[0]), f"{tmp_path}/snap", 1)
    storage.snapshot(L.state(log), f"{tmp_path}/snap", 2)
    assert sorted(map(tuple, storage.read_snapshot(spark, f"{tmp_path}/snap").select("key", "value").collect())) == want
    with pytest.raises(ValueError):
        storage.read_snapshot(spark, f"{tmp_path}/snap", 3)
    q = fold.fold_stream(fold.read_log_stream(spark, f"{tmp_path}/log"), f"{tmp_path}/state", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, fold.folded(spark, f"{tmp_path}/state", 1).collect())) == want
    size = {r.seq: len(r.key) + len(r.value or "") for r in log.collect()}
    kept = {r.seq for r in storage.retained(log, 400).collect()}
    total, expect = 0, set()
    for s in sorted(size, reverse=True):
        total += size[s]
        if total > 400:
            break
        expect.add(s)
    assert kept == expect


def test_split_and_migrate_keep_rows(spark, grid):
    bounds = [("", 1), (key(9000), 2)]
    routed = shards.route(grid, bounds)
    mid = {r.shard_id: r.split_key for r in shards.midpoints(routed).collect()}
    assert mid == {1: key(4500), 2: key(9000 + 6500)}
    frame = spark.createDataFrame([(1, 1, "", key(9000)), (2, 1, key(9000), "")], "shard_id long, table_id long, first_key string, last_key string")
    after = shards.split(frame, 2, mid[2], 3)
    n = {r.shard_id: r["count"] for r in shards.route(grid, shards.bounds_of(after)).groupBy("shard_id").count().collect()}
    assert n == {1: 9000, 2: 6500, 3: 6500}
    copy, moved = shards.migrated(routed, frame, 2, 9, 1)
    assert copy.count() == 13000 and {r.shard_id for r in moved.collect()} == {1, 9}
    with pytest.raises(ValueError):
        shards.split(frame, 1, key(9000), 3)
    assert mapreduce.map_partitions(grid.limit(10), lambda it: it, "key string, value string").count() == 10
