"""Transactions on a log whose rows carry txn_id (null: outside any), and locks on major keys."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOCK_MS = 3000


def ends(log: DataFrame) -> DataFrame:
    """The mark that ended each transaction, its first COMMIT or ROLLBACK: (txn_id, end, apply_seq). Later marks find no transaction."""
    marks = log.filter(F.col("op").isin("COMMIT", "ROLLBACK") & F.col("txn_id").isNotNull())
    return marks.groupBy("txn_id").agg(F.min_by("op", "seq").alias("end"), F.min("seq").alias("apply_seq"))


def committed(log: DataFrame) -> DataFrame:
    """Data commands of committed transactions and of none, ordered as (seq of the commit, own seq).

    Marks are rows with op 'COMMIT' or 'ROLLBACK'; the first one ends the
    transaction. apply_seq and seq give the order in which commands apply: a
    transaction applies as a unit where it commits.
    """
    data = log.filter(F.col("op").isin("S", "D", "A"))
    plain = data.filter("txn_id is null").withColumn("apply_seq", F.col("seq"))
    done = ends(log).filter("end = 'COMMIT'").drop("end")
    return plain.unionByName(data.join(done, "txn_id").filter("seq < apply_seq").select(*plain.columns))


def discarded(log: DataFrame) -> DataFrame:
    """Data commands of transactions that are rolled back or never end."""
    data = log.filter(F.col("op").isin("S", "D", "A") & F.col("txn_id").isNotNull())
    return data.join(ends(log).filter("end = 'COMMIT'"), "txn_id", "left_anti")


def rejected(log: DataFrame) -> DataFrame:
    """Commands and marks of a transaction behind the mark that ended it: (txn_id, seq, op, end). They fail and change nothing."""
    return log.join(ends(log), "txn_id").filter("seq > apply_seq").select("txn_id", "seq", "op", "end")


def committed_state(log: DataFrame) -> DataFrame:
    """Live (key, value) after committed sets and deletes."""
    order = F.struct("apply_seq", "seq")
    last = committed(log).filter(F.col("op").isin("S", "D")).groupBy("key").agg(F.max_by(F.struct("op", "value"), order).alias("w"))
    return last.filter("w.op = 'S'").select("key", "w.value")


def _episodes(events: DataFrame, quiet_ms: int) -> DataFrame:
    """events with `episode`: a new one begins where a key was quiet for over quiet_ms, so that no lock or waiter is left.

    Time is cut into slots of quiet_ms; only a key's distinct slots are ordered.
    """
    rows = events.withColumn("_slot", F.floor(F.col("ts_ms") / quiet_ms))
    slots = rows.select("major_key", "_slot").distinct()
    order = Window.partitionBy("major_key").orderBy("_slot")
    fresh = F.coalesce(F.col("_slot") - F.lag("_slot").over(order) > 1, F.lit(True))
    slots = slots.withColumn("_new", fresh.cast("long"))
    slots = slots.withColumn("episode", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    null_safe = F.col("a.major_key").eqNullSafe(F.col("b.major_key")) & (F.col("a._slot") == F.col("b._slot"))
    return rows.alias("a").join(slots.alias("b"), null_safe).select("a.*", "b.episode").drop("_slot")


def lock_grants(events: DataFrame, expiry_ms: int = LOCK_MS) -> DataFrame:
    """FIFO locks per major key from events (major_key, session_id, ts_ms, action lock | unlock | expire_all).

    A lock is held until it is unlocked or expiry_ms later; a waiter gives up
    after expiry_ms. expire_all, as when a primary loses its lease, drops the
    holder and all waiters. One row for each ask: granted_ms or null, released_ms
    and outcome. Time comes from the events alone; events without a time are
    left out, as they have no place in the order.

    Grants of one key depend on each other only until it has been quiet for
    twice expiry_ms, so its events are cut there into episodes, which spread over
    tasks. A task reads its episodes in order of time as a stream; it holds the
    lock's holder and those waiting, who leave after expiry_ms.
    """
    names = ["major_key", "session_id", "asked_ms", "granted_ms", "released_ms", "outcome"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, holder, waiting, current = [], None, deque(), None

        def release(at: int, why: str) -> None:
            nonlocal holder
            out.append((*holder, at, why))
            holder = None
            while waiting:
                session, asked = waiting.popleft()
                if at - asked < expiry_ms:
                    holder = (current[0], session, asked, at)
                    return
                out.append((current[0], session, asked, None, asked + expiry_ms, "wait expired"))

        def settle(now: int | None) -> None:
            """Releases what expires until now; None: all of it."""
            while holder and (now is None or holder[3] + expiry_ms <= now):
                release(holder[3] + expiry_ms, "lock expired")

        def table() -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({"session_id": "Int64", "granted_ms": "Int64", "released_ms": "Int64"})

        for pdf in batches:
            for key, episode, session, ts, action in zip(pdf.major_key, pdf.episode, pdf.session_id, pdf.ts_ms, pdf.action, strict=True):
                session = None if pd.isna(session) else int(session)
                if (key, episode) != current:
                    settle(None)
                    current = (key, episode)
                now = int(ts)
                settle(now)
                if action == "lock":
                    if holder is None:
                        holder = (key, session, now, now)
                    else:
                        waiting.append((session, now))
                elif action == "unlock":
                    if holder and holder[1] == session:
                        release(now, "unlocked")
                    else:
                        out.extend((key, s, asked, None, now, "gave up") for s, asked in waiting if s == session)
                        waiting = deque(w for w in waiting if w[0] != session)
                elif action == "expire_all":
                    out.extend((key, s, asked, None, now, "dropped") for s, asked in waiting)
                    waiting = deque()
                    if holder:
                        release(now, "dropped")
            yield table()
            out.clear()
        settle(None)
        yield table()

    rows = _episodes(events.select("major_key", "session_id", "ts_ms", "action").filter("ts_ms is not null"), 2 * expiry_ms)
    rows = rows.repartition("major_key", "episode").sortWithinPartitions("major_key", "episode", "ts_ms", "session_id", "action")
    return rows.mapInPandas(run, "major_key string, session_id long, asked_ms long, granted_ms long, released_ms long, outcome string")
