"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, twice over. A
document's virtual finish time is the source's tokens up to its end over the
source's target, so at any virtual time the sources have been served in
proportion to their targets. The mix is the queue in order of finish times,
truncated where the total budget is used up; the one document a source is then
serving gives the words served so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexkv.llm.common import materialize

#: Weights by the source's place, repeating; the mix's share of all tokens; most copies of a document.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MAX_COPIES = 1.5, 2
SEED = 42
#: Sources are one row each in a window over all of them: a mix has few.
MAX_SOURCES = 10_000
#: Rows a bucket of a source's shuffled order holds on average.
BUCKET_ROWS = 1024
#: Columns that a mix adds or uses on the way.
ADDED = ("source_size", "target", "cum", "n", "_source", "_key", "_bucket", "_tag", "_in", "_ahead")
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size).

    Water filling: sources in order of the level at which they are full; the
    first whose full level is not below that of the budget left, shared by the
    weights left, sets the level of all the rest.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(place)
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    few = F.when(F.count("*").over(Window.partitionBy()) > MAX_SOURCES, F.raise_error(F.lit(f"over {MAX_SOURCES} sources"))).otherwise(cases)
    s = s.withColumn("weight", few.cast("double")).withColumn("cap", F.col("source_size") * float(copies)).withColumn("fills", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fills", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight)
    level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "level"))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "n", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of docs, written, so that words are counted once for all that needs no texts."""
    return materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")


def _placed(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """rows with their source's size and target, the place in its shuffled order (_key) and a bucket of that order."""
    t = targets.select(F.col("source").alias("_source"), "source_size", "n", "target")
    few = F.broadcast(t)  # MAX_SOURCES rows at most, else source_targets raises
    rows = rows.join(few, rows["source"].eqNullSafe(t["_source"])).drop("_source")
    rows = rows.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets).cast("long")).drop("n")
    return rows.withColumn("_tag", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))


def queued(rows: DataFrame, sizes: DataFrame, seed: int = SEED, weights=WEIGHTS, budget: float = BUDGET, copies: int = MAX_COPIES) -> DataFrame:
    """rows, which have a size, with source_size, target and cum, the words of the source's queue up to the document's end.

    sizes: sized() of the same rows. The order is a seeded hash of doc_id; rows
    that tie are ordered by size. A source's running sums are made in buckets of
    the hash, so that no task holds a whole source: sums of buckets first, then
    sums inside each.
    """
    targets = source_targets(sizes.select("source", "size"), weights, budget, copies)
    sums = _placed(sizes, targets, seed).groupBy("_tag", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("_tag").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_tag", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_tag", "_bucket").orderBy("_key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = _placed(rows, targets, seed).withColumn("_in", F.sum("size").over(inside)).join(sums, ["_tag", "_bucket"])
    return rows.withColumn("cum", F.col("_in") + F.col("_ahead")).drop("_tag", "_bucket", "_in", "_ahead")


def served(copies: int = MAX_COPIES) -> Column:
    """For each copy of a queued document: its virtual finish time and the words the mix takes.

    The budget is the sum of the targets, so it is used up at virtual time 1. A
    copy that finishes by then is taken whole; one being served then gives the
    words before it; later ones give none.
    """

    def copy(k: int) -> Column:
        end = F.col("cum") + k * F.col("source_size")
        finish = F.when(F.col("target") > 0, end / F.col("target"))
        words = F.floor(F.col("target") + 1e-6).cast("long") - (end - F.col("size"))
        return F.struct(F.lit(k).alias("copy"), finish.alias("virtual_finish"), F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), words)).alias("taken"))

    return F.array(*[copy(k) for k in range(copies)])


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The mix: a row for each copy taken, with size, source_size, target, copy, virtual_finish and taken words.

    Ordered by virtual finish time, a global range sort. Null texts and texts
    without words have size 0 and are never taken; a null source is a source of
    its own, the last; repeated rows are separate documents; a null doc_id is
    ordered like any other. Empty tables give empty results. Other columns
    stay, but added ones replace those of the same name.
    """
    docs = docs.drop("copy", "virtual_finish", "taken", "_copy", *ADDED)
    q = queued(docs.withColumn("size", n_words(F.col("text"))), sized(docs), seed, weights, budget, copies).withColumn("_copy", F.explode(served(copies)))
    q = q.filter("_copy.taken > 0").select("*", "_copy.*").drop("_copy")
    return q.orderBy("virtual_finish", "_key", "copy").drop("_key", "cum")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of each row of docs, copies summed."""
    sizes = sized(docs)
    q = queued(sizes, sizes)
    taken = F.aggregate(F.transform(served(), lambda c: c["taken"]), F.lit(0).cast("long"), lambda a, b: a + b)
    return q.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix with the columns of docs, whatever their names: a row for each copy, its text cut after the taken words, in order of finish times."""
    names, used = docs.columns, ("doc_id", "text", "source")
    rest = [c for c in names if c not in used]
    docs = docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")) if rest else docs
    m = mixed(docs)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("taken").cast("int"))
    m = m.withColumn("text", F.when(F.col("taken") < F.col("size"), F.array_join(words, " ")).otherwise(F.col("text")))
    length = F.length("text").cast("long").alias("n_chars")
    return m.select(*[length if c == "n_chars" else F.col(c) if c in used else F.col("_rest").getField(c).alias(c) for c in names])
