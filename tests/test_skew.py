"""Hot keys cut into ranges and episodes give what a plain walk over the whole log gives; streams merge their chunks."""

import random

from pyspark.sql import functions as F

from lexkv.operators import log as L
from lexkv.operators import indexes, shards, transactions
from lexkv.sources import storage
from lexkv.streaming import fold


def test_running_results_over_ranges(spark):
    r, rows = random.Random(3), []
    for seq in range(1, 1200):
        op = r.choice("AAAAAAAAASD") if r.random() < 0.4 else "A"
        rows.append((seq, op, r.choice(["hot", "hot", "b", "c", None]), r.choice(["5", "x", "", None]) if op == "S" else None, r.choice([r.randrange(-9, 9), None, 7]) if op == "A" else None))
    start, want = {}, {}
    for seq, op, k, value, number in rows:
        if op != "A":
            start[k] = 0 if op == "D" else {"5": 5, "": 0}.get(value)
        else:
            start[k] = None if start.get(k, 0) is None else start.get(k, 0) + (number or 0)
            want[seq] = start[k]
    log = spark.createDataFrame(rows, fold.LOG)
    for width in (7, 100, L.RANGE):
        got = {x.seq: x.result for x in L.running_adds(log, width).filter("key is not null").collect()}
        assert got == {s: v for s, v in want.items() if rows[s - 1][2] is not None}


def test_running_results_leave_int64(spark):
    big = 2**63 - 1
    rows = [(1, "A", "k", None, big), (2, "A", "k", None, 1), (3, "A", "k", None, -2), (4, "D", "k", None, None), (5, "A", "k", None, 3)]
    got = {x.seq: (x.result, x.status) for x in L.running_adds(spark.createDataFrame(rows, fold.LOG), 2).collect()}
    assert got == {1: (big, "OK"), 2: (None, "FAILED"), 3: (big - 1, "OK"), 5: (3, "OK")}
    assert L.running_adds(spark.createDataFrame([], fold.LOG)).count() == 0


def test_sequences_over_ranges(spark):
    r, rows, at, want = random.Random(4), [], {}, {}
    for seq in range(1, 600):
        k = r.choice(["hot", "hot", "b"])
        if r.random() < 0.03:
            rows.append((seq, "S", k, str(seq)))
            at[k] = seq
        else:
            rows.append((seq, "Q", k, None))
            want[seq] = at.get(k, 1)
            at[k] = want[seq] + 1
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string")
    for width in (5, L.RANGE):
        assert {x.seq: x.result for x in L.sequence_numbers(log, width=width).collect()} == want


def plain_locks(events, expiry):
    """Each key's events in one list, walked from the first to the last."""
    out = []
    for key in {e[0] for e in events}:
        held, queue = None, []
        steps = sorted((t, s, a) for k, s, t, a in events if k == key) + [(10**12, -1, "end")]
        for now, session, action in steps:
            free = None
            while held and held[2] + expiry <= now or free is not None:
                if free is None:
                    free = held[2] + expiry
                    out.append((key, *held, free, "lock expired"))
                    held = None
                if not queue:
                    free = None
                    continue
                s, asked = queue.pop(0)
                if free - asked < expiry:
                    held, free = (s, asked, free), None
                else:
                    out.append((key, s, asked, None, asked + expiry, "wait expired"))
            if action == "lock":
                if held:
                    queue.append((session, now))
                else:
                    held = (session, now, now)
            elif action == "unlock" and held and held[0] == session:
                out.append((key, *held, now, "unlocked"))
                held = None
                while queue and not held:
                    s, asked = queue.pop(0)
                    if now - asked < expiry:
                        held = (s, asked, now)
                    else:
                        out.append((key, s, asked, None, asked + expiry, "wait expired"))
            elif action == "unlock":
                out += [(key, s, asked, None, now, "gave up") for s, asked in queue if s == session]
                queue = [w for w in queue if w[0] != session]
            elif action == "expire_all":
                out += [(key, s, asked, None, now, "dropped") for s, asked in queue]
                queue = []
                if held:
                    out.append((key, *held, now, "dropped"))
                held = None
    return sorted(out, key=repr)


def test_locks_over_episodes(spark):
    r, now, events = random.Random(6), 0, []
    for _ in range(1500):
        now += r.choice([0, 1, 5, 20, 20, 60, 400])
        events.append((r.choice(["hot", "hot", "hot", "b"]), r.randrange(6), now, r.choice(["lock"] * 5 + ["unlock"] * 4 + ["expire_all"] * (r.random() < 0.2))))
    frame = spark.createDataFrame(events, "major_key string, session_id long, ts_ms long, action string")
    got = sorted((tuple(x) for x in transactions.lock_grants(frame, 100).collect()), key=repr)
    assert got == plain_locks(events, 100)
    assert transactions._episodes(frame, 200).select("major_key", "episode").distinct().count() > 20
    odd = spark.createDataFrame([(None, 1, 5, "lock"), (None, None, 6, "lock"), ("a", 1, None, "lock"), ("a", 1, 1, None)], frame.schema)
    # the waiter without a session asked at 6 and gets the lock at 105, inside its 100 ms; a lock without a time is left out
    assert {x.session_id: (x.granted_ms, x.outcome) for x in transactions.lock_grants(odd, 100).collect()} == {1: (5, "lock expired"), None: (105, "lock expired")}
    assert transactions.lock_grants(frame.limit(0)).count() == 0


def test_first_mark_ends_a_transaction(spark):
    rows = [(1, "S", "a", "1", 7), (2, "ROLLBACK", None, None, 7), (3, "COMMIT", None, None, 7), (4, "S", "b", "1", 8), (5, "COMMIT", None, None, 8), (6, "S", "b", "2", 8), (7, "S", "c", "1", 9)]
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string, txn_id long")
    assert {x.key: x.value for x in transactions.committed_state(log).collect()} == {"b": "1"}
    assert {x.seq for x in transactions.discarded(log).collect()} == {1, 7}
    assert {(x.seq, x.end) for x in transactions.rejected(log).collect()} == {(3, "ROLLBACK"), (6, "COMMIT")}


def test_stream_merges_chunks(spark, tmp_path):
    r, rows = random.Random(8), []
    for seq in range(600):
        rows.append((seq, r.choice("SSD"), f"k{r.randrange(40)}", str(seq), None))
    log = spark.createDataFrame(rows, fold.LOG)
    for n in range(6):
        log.filter(F.floor(F.col("seq") / 100) == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    q = fold.fold_stream(fold.read_log_stream(spark, f"{tmp_path}/log"), f"{tmp_path}/state", f"{tmp_path}/cp", every=2).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, fold.folded(spark, f"{tmp_path}/state", 5, every=2).collect())) == sorted(map(tuple, L.state(log).collect()))
    assert (tmp_path / "state" / "level=2" / "upto=4").exists()
    assert fold.chunks("r", 5, 2) == ["r/level=1/upto=6", "r/level=2/upto=4"] and len(fold.chunks("r", 9998, 10)) == 36


def test_retention_and_policies(spark):
    log = spark.range(50_000).select(F.col("id").alias("seq"), F.lit("S").alias("op"), F.lit("k").alias("key"), F.lit("v").alias("value"))
    assert storage.retained(log, 999, ranges=5).agg(F.min("seq"), F.count("*")).first()[:] == (50_000 - 499, 499)
    assert storage.retained(log.limit(0), 999).count() == 0
    chunks = spark.createDataFrame([(1, c, 10, False) for c in range(11)] + [(2, 0, 500, True), (3, 0, 900, None)], "shard_id long, chunk long, bytes long, was_split boolean")
    assert [x.shard_id for x in storage.compaction_order(chunks).collect()] == [2, 1]
    frame = spark.createDataFrame([(1, 1, "", "m"), (2, 1, "m", "")], "shard_id long, table_id long, first_key string, last_key string")
    due = spark.createDataFrame([(1, 10), (2, 20)], "shard_id long, shard_size long")
    mid = spark.createDataFrame([(1, "c"), (2, "m")], "shard_id long, split_key string")
    assert tuple(shards.next_split(due, mid, frame).first()) == (1, "c")


def test_route_join_keeps_all_shards_of_a_large_catalog(spark):
    n = shards.ARRAY_SHARDS + 2500
    firsts = [""] + [f"{10 * k:07d}" for k in range(1, n)]
    catalog = spark.createDataFrame(list(zip(range(n), firsts, [*firsts[1:], ""])), "shard_id long, first_key string, last_key string")
    keys = spark.range(0, 10 * n + 50, 3).select(F.format_string("%07d", "id").alias("key"), F.least(F.floor(F.col("id") / 10), F.lit(n - 1)).alias("want"))
    got = shards.route_join(keys, catalog)
    assert got.columns == ["key", "want", "shard_id"]
    assert got.count() == keys.count() and got.filter("shard_id <> want").count() == 0


def test_stream_folds_all_commands(spark, tmp_path):
    r, rows = random.Random(11), []
    for seq in range(600):
        op = "T" if seq in (130, 371) else r.choice("SDAAAAQQ")
        key = None if op == "T" else r.choice(["adds", "hot", f"k{r.randrange(30)}"])
        rows.append((seq, "A" if key == "adds" else op, key, r.choice(["5", "x", "", "-7"]) if op == "S" and key != "adds" else None, r.randrange(-9, 9) if op == "A" or key == "adds" else None))
    log = spark.createDataFrame(rows, fold.LOG)
    for n in range(6):
        log.filter(F.floor(F.col("seq") / 100) == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    q = fold.fold_stream(fold.read_log_stream(spark, f"{tmp_path}/log"), f"{tmp_path}/state", f"{tmp_path}/cp", every=2).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for version in range(6):
        want = L.counter_state(L.after_truncate(log.filter(F.col("seq") < 100 * (version + 1))))
        if version:
            got = fold.folded(spark, f"{tmp_path}/state", version, every=2)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_sequences_after_deletes_and_texts(spark):
    rows = [(1, "S", "s", "50"), (2, "D", "s", None), (3, "Q", "s", None), (4, "Q", "s", None), (5, "S", "t", "x"), (6, "Q", "t", None), (7, "S", "t", "9"), (8, "Q", "t", None), (9, "S", "u", "x"), (10, "Q", "u", None), (11, "Q", "v", None), (12, "D", "v", None)]
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string")
    for width in (1, 3, L.RANGE):
        assert {x.seq: x.result for x in L.sequence_numbers(log, width=width).collect()} == {3: 1, 4: 2, 6: None, 8: 9, 10: None, 11: 1}
    assert {x.key: x.value for x in L.sequence_state(log).collect()} == {"s": "1001", "t": "1009", "u": "x"}


def test_fan_out_deals_out_hot_keys(spark):
    followers = spark.range(1000).select(F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("follower"))
    events = spark.createDataFrame([("hot", "a"), ("hot", "a"), ("k7", "b"), ("none", "c")], "key string, value string")
    want = sorted(map(tuple, events.join(followers, "key").select("follower", "key", "value").collect()))
    assert sorted(map(tuple, indexes.fan_out(events, followers, 100).collect())) == want and len(want) == 1208
