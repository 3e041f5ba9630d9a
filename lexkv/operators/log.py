"""The ordered command log: last-writer-wins state, counters, sequences, truncation, pending overlay.

Log rows: seq (total order), op ('S' set, 'D' delete, 'A' add, 'Q' next number
of a sequence, 'T' truncate; null: ignored), key, value (set), number (add).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexkv.functions.keys import int_of_text, is_int_text
from lexkv.operators.table import RangeQuery

BLOCK = 1000
#: Positions of the log that one task folds of a key at once.
RANGE = 1 << 20


def applied(log: DataFrame, position: list[str] = ["seq"]) -> DataFrame:
    """Commands to apply: each position once, empty rounds dropped."""
    return log.filter("op is not null").dropDuplicates(position)


def last_writes(log: DataFrame) -> DataFrame:
    """Newest set or delete of each key, tombstones included: one partial aggregate."""
    return log.filter(F.col("op").isin("S", "D")).groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("w")).select("key", "w.*")


def state(log: DataFrame) -> DataFrame:
    """Live (key, value) of a log of sets and deletes."""
    return last_writes(log).filter("op = 'S'").select("key", "value")


def after_truncate(log: DataFrame) -> DataFrame:
    """Commands behind the table's last truncate, which is a barrier for every key: one row, so it is broadcast."""
    cut = log.filter("op = 'T'").agg(F.coalesce(F.max("seq"), F.lit(-1).cast("long")).alias("_cut"))
    return log.join(F.broadcast(cut), F.col("seq") > F.col("_cut")).filter("op <> 'T'").drop("_cut")


def counter_state(log: DataFrame, start: int = 1, block: int = BLOCK) -> DataFrame:
    """Live (key, value) after sets, deletes, adds and sequence commands, without a window: safe for hot keys.

    The newest set or delete is the base; adds behind it are summed, and numbers
    that sequence commands asked for are taken in whole blocks. On a missing base
    the first of them decides: an add counts from 0, a sequence from start. A
    base that is no number fails all of them and stays. Sums outside int64 give
    null.
    """
    writes = last_writes(log).select("key", F.col("op").alias("base_op"), F.col("value").alias("base"), F.col("seq").alias("base_seq"))
    first = F.coalesce("first", "seq") if "first" in log.columns else F.col("seq")
    asks = log.filter(F.col("op").isin("A", "Q")).select("key", "seq", "op", "number", first.alias("first"))
    asks = asks.join(writes.select("key", "base_seq"), "key", "left").filter("base_seq is null or seq > base_seq")
    is_q = F.col("op") == "Q"
    total, n = F.expr("try_sum(case when op = 'A' then number end)"), F.sum(F.when(is_q, F.coalesce("number", F.lit(1))))
    sums = asks.groupBy("key").agg(total.alias("total"), n.cast("long").alias("n"), F.count(F.when(~is_q, 1)).alias("adds"), F.min_by("op", "first").alias("first_op"))
    both = writes.join(sums, "key", "full_outer")
    none = F.when(F.col("first_op") == "Q", F.lit(start)).otherwise(F.lit(0)).cast("long")
    begin = F.when(F.col("base_op") == "S", int_of_text(F.col("base"))).otherwise(none)
    plain = (F.col("base_op") == "S") & (F.col("first_op").isNull() | ~is_int_text(F.col("base")))
    added = F.when(F.col("adds") > 0, F.col("total")).otherwise(F.lit(0)).cast("long")
    taken = F.lit(block).cast("long") * F.ceil(F.coalesce("n", F.lit(0)) / block)
    value = F.when(plain, F.col("base")).otherwise(F.try_add(F.try_add(begin, added), taken).cast("string"))
    return both.filter("base_op = 'S' or first_op is not null").select("key", value.alias("value"))


def _since_barrier(rows: DataFrame, barrier: Column, base: Column, number: Column, width: int) -> DataFrame:
    """rows with `base` (that of the key's newest barrier up to here, null before any) and `total` (sum of number since it).

    A hot key is cut into ranges of `width` positions: each range is folded by
    itself, then one summary row a range carries the base and the sum over to
    the next ranges, so no task orders all rows of a key. Sums are exact decimals.
    """
    rows = rows.withColumn("_range", F.floor(F.col("seq") / width)).withColumn("_mark", F.when(barrier, F.struct(base.alias("base"))))
    rows = rows.withColumn("_number", F.when(~barrier, number).cast("decimal(38,0)"))
    upto = Window.partitionBy("key", "_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_grp", F.count("_mark").over(upto))
    inside = Window.partitionBy("key", "_range", "_grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_here", F.first("_mark").over(inside)).withColumn("_sum", F.coalesce(F.sum("_number").over(inside), F.lit(0).cast("decimal(38,0)")))

    last = F.max_by(F.struct("_here", "_sum"), "seq")
    ends = rows.groupBy("key", "_range").agg(last.alias("_end")).select("key", "_range", "_end.*")
    earlier = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_part", F.count("_here").over(earlier))
    # within a part only the first range has a barrier: its tail and all later ranges add up
    since = Window.partitionBy("key", "_part").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("key", "_range", F.first("_here").over(since).alias("_base"), F.sum("_sum").over(since).alias("_all"))
    place = Window.partitionBy("key").orderBy("_range")
    carry = ends.select("key", "_range", F.lag("_base").over(place).alias("_base"), F.lag("_all").over(place).alias("_all")).filter("_all is not null")

    out = rows.join(carry, ["key", "_range"], "left")
    none = F.col("_grp") == 0
    total = F.col("_sum") + F.when(none, F.coalesce("_all", F.lit(0).cast("decimal(38,0)"))).otherwise(F.lit(0).cast("decimal(38,0)"))
    return out.withColumn("base", F.when(none, F.col("_base")).otherwise(F.col("_here"))["base"]).withColumn("total", total)


def _whole(n: Column) -> Column:
    """n as int64; null outside of it."""
    return n.try_cast("long")


def running_adds(log: DataFrame, width: int = RANGE) -> DataFrame:
    """For each add its result (null where it fails or leaves int64) and status, in log order per key."""
    rows = log.filter(F.col("op").isin("S", "D", "A"))
    start = F.when(F.col("op") == "D", F.lit(0).cast("long")).otherwise(int_of_text(F.col("value")))
    base = F.struct(start.alias("start"))
    out = _since_barrier(rows, F.col("op") != "A", base, F.col("number"), width).filter("op = 'A'")
    start = F.when(F.col("base").isNull(), F.lit(0).cast("long")).otherwise(F.col("base.start"))
    out = out.withColumn("result", _whole(start.cast("decimal(38,0)") + F.col("total")))
    return out.select("key", "seq", "number", "result", F.when(F.col("result").isNull(), "FAILED").otherwise("OK").alias("status"))


def sequence_numbers(log: DataFrame, start: int = 1, width: int = RANGE) -> DataFrame:
    """Numbers handed out by 'Q' commands: dense per key, from the last set value, or from start if there is none or it was deleted.

    A set value that is no number fails all commands behind it: their result is null.
    """
    rows = log.filter(F.col("op").isin("S", "D", "Q"))
    first = F.when(F.col("op") == "D", F.lit(start).cast("long")).otherwise(int_of_text(F.col("value")))
    out = _since_barrier(rows, F.col("op") != "Q", F.struct(first.alias("first")), F.lit(1), width).filter("op = 'Q'")
    first = F.when(F.col("base").isNull(), F.lit(start).cast("long")).otherwise(F.col("base.first"))
    return out.select("key", "seq", _whole(first.cast("decimal(38,0)") + F.col("total") - 1).alias("result"))


def sequence_state(log: DataFrame, start: int = 1, block: int = BLOCK) -> DataFrame:
    """Stored next value of each sequence: numbers are taken from the table in blocks. A base that is no number stays."""
    last = last_writes(log).select("key", F.col("op").alias("base_op"), F.col("value").alias("base"), F.col("seq").alias("base_seq"))
    asks = log.filter("op = 'Q'").join(last, "key", "left").filter("base_seq is null or seq > base_seq")
    asks = asks.groupBy("key").agg(F.count("*").alias("n"), F.max("base_op").alias("base_op"), F.max("base").alias("base"))
    was_set = F.coalesce(F.col("base_op") == "S", F.lit(False))
    first = F.when(was_set, int_of_text(F.col("base"))).otherwise(F.lit(start).cast("long"))
    value = F.when(was_set & first.isNull(), F.col("base")).otherwise((first + block * F.ceil(F.col("n") / block)).cast("string"))
    return asks.select("key", value.alias("value"))


def carried(log: DataFrame) -> DataFrame:
    """What counter_state(after_truncate(log)) needs, as rows of a log again: carried rows of parts of a log, put together, are carried in turn.

    The last truncate; each key's newest set or delete behind it; one add and
    one sequence command a key for all that came behind that, with the positions
    of the first and the last. Parts may come in any order, but a set, delete or
    truncate between two commands that an earlier part has summed cannot be
    applied any more: that raises an error.
    """
    number = F.col("number") if "number" in log.columns else F.lit(None)
    first = F.coalesce("first", "seq") if "first" in log.columns else F.col("seq")
    rows = log.select("seq", "op", "key", "value", number.cast("decimal(38,0)").alias("number"), first.alias("first"))
    cut = rows.filter("op = 'T'").agg(F.max("seq").alias("_cut"))
    rows = rows.join(F.broadcast(cut)).filter("op <> 'T' and (_cut is null or seq > _cut)")
    writes = last_writes(rows)
    bases = writes.select("key", F.col("seq").alias("base_seq"))
    asks = rows.filter(F.col("op").isin("A", "Q")).join(bases, "key", "left").filter("base_seq is null or seq > base_seq")
    late = F.coalesce(F.col("first") <= F.greatest("base_seq", "_cut"), F.lit(False))
    number = F.when(F.col("op") == "Q", F.coalesce("number", F.lit(1))).otherwise(F.col("number"))
    number = F.when(late, F.raise_error(F.lit("a command came after later ones had been summed"))).otherwise(number)
    asks = asks.groupBy("key", "op").agg(F.max("seq").alias("seq"), F.sum(number).cast("decimal(38,0)").alias("number"), F.min("first").alias("first"))
    kept = asks.unionByName(writes, allowMissingColumns=True)
    return kept.unionByName(cut.filter("_cut is not null").select(F.col("_cut").alias("seq"), F.lit("T").alias("op")), allowMissingColumns=True)


def folded_state(rows: DataFrame) -> DataFrame:
    """Live (key, value) of rows that carried() gives."""
    return counter_state(after_truncate(rows.withColumn("number", F.col("number").try_cast("long"))))


def pending_writes(pending: DataFrame) -> DataFrame:
    """One entry for each key of a batch not yet submitted: its last write."""
    return last_writes(pending).select("key", "op", "value")


def overlay(kv: DataFrame, pending: DataFrame) -> DataFrame:
    """Committed rows as this client sees them: pending sets win, pending deletes hide."""
    p = pending_writes(pending).select("key", F.col("op").alias("p_op"), F.col("value").alias("p_value"))
    both = kv.select("key", "value").join(p, "key", "full_outer")
    return both.filter("p_op is null or p_op = 'S'").select("key", F.when(F.col("p_op") == "S", F.col("p_value")).otherwise(F.col("value")).alias("value"))


def overlay_list(kv: DataFrame, pending: DataFrame, q: RangeQuery) -> DataFrame:
    """A list over the overlay: both sides are cut to the range before they meet; order and limit come after."""
    from lexkv.operators.table import list_key_values

    return list_key_values(overlay(q.rows(kv), q.rows(pending)), q)


def overlay_get(keys: DataFrame, kv: DataFrame, pending: DataFrame) -> DataFrame:
    from lexkv.operators.table import multi_get

    return multi_get(keys, overlay(kv.join(keys, "key", "left_semi"), pending.join(keys, "key", "left_semi")))


def submitted(log: DataFrame, pending: DataFrame) -> DataFrame:
    """The log with a pending batch appended, one write a key, in the order of last writes."""
    last = last_writes(pending)
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("_top"))
    moved = last.join(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("_top")).drop("_top")
    return log.unionByName(moved, allowMissingColumns=True)


def merged(*chunks: DataFrame) -> DataFrame:
    """Newest row of each key over chunks (key, op, value, seq), tombstones dropped: all chunks of the table are here."""
    every = chunks[0]
    for c in chunks[1:]:
        every = every.unionByName(c)
    return state(every)


def at_least(log: DataFrame, seen: int) -> DataFrame:
    """The log behind a position a reader has seen."""
    return log.filter(F.col("seq") > F.lit(seen))


def conditional_writes(kv: DataFrame, asked: DataFrame) -> DataFrame:
    """Set-if-missing and test-and-set as one join: rows (key, expected, value), expected null: only if missing.

    Gives key, value after, and whether the write took effect. One ask a key.
    """
    cur = kv.select("key", F.col("value").alias("current"), F.lit(True).alias("there"))
    j = asked.join(cur, "key", "left")
    ok = F.when(F.col("expected").isNull(), F.col("there").isNull()).otherwise(F.col("there").isNotNull() & (F.col("current") == F.col("expected")))
    return j.select("key", F.when(ok, F.col("value")).otherwise(F.col("current")).alias("value"), ok.alias("done"))


