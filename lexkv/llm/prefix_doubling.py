"""Removal of repeated strings by distributed prefix doubling of every position's rank.

The rank of a position stands for the bytes that start there: the first
FIRST bytes themselves, then, for twice as many, the least position with the
same pair of ranks at the position and behind its bytes. Spark groups the pairs
of each round; positions whose pair is unique drop out, the others are reranked
until the ranks stand for `length` bytes. Exact, without hashes.

Each round shuffles every position that is left several times: see the README
for what that costs. suffix_dedup gives the same result by sampled positions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexkv.llm.common import arrow_map, batch, materialize

#: Bytes of the first rank, a whole number; positions that a task sends at a time.
FIRST, PIECE = 8, 1 << 18


def _first_ranks(batches):
    for b in batches:
        for rid, text in zip(b["rid"].to_pylist(), b["text"].to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for k in range(0, len(data) - FIRST + 1, PIECE):
                part = data[k : k + PIECE + FIRST - 1]
                rank = np.ndarray((len(part) - FIRST + 1,), dtype="<i8", buffer=part, strides=(1,)).copy()
                yield batch(rid=np.full(len(rank), rid), at=np.arange(k, k + len(rank)), rank=rank)


def _reranked(ranks: DataFrame, ahead: int) -> DataFrame:
    """Ranks of the bytes of two ranks, the second one `ahead`; positions of unique pairs are left out."""
    behind = ranks.select("rid", (F.col("at") - ahead).alias("at"), F.col("rank").alias("then"))
    pairs = materialize(ranks.join(behind, ["rid", "at"]), "doubling-pairs")
    groups = pairs.groupBy("rank", "then").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("new")).filter("n > 1")
    return materialize(pairs.join(groups, ["rank", "then"]).select("rid", "at", F.col("new").alias("rank")), "doubling-ranks")


def removed(docs: DataFrame, length: int = 200) -> DataFrame:
    """suffix_dedup.removed by plain prefix doubling: the same rows, without the kept bytes.

    Null and empty texts have no bytes; repeated rows remove each other; a null
    doc_id stays null; extra columns are ignored; an empty table gives an empty
    result.
    """
    if length < FIRST:
        raise ValueError(f"length must be {FIRST} at least")
    rows = materialize(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "doubling-rows")
    ranks, size = arrow_map(rows.select("rid", "text"), _first_ranks, "rid long, at long, rank long"), FIRST
    while size < length:
        ahead = min(size, length - size)
        ranks, size = _reranked(ranks, ahead), size + ahead
    if length == FIRST:
        ranks = ranks.join(ranks.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1"), "rank")
    place = Window.partitionBy("rid").orderBy("at")
    starts = ranks.select("rid", "at", (F.col("at") - F.lag("at", 1, -length - 1).over(place) > length).alias("new"))
    runs = starts.withColumn("run", F.sum(F.col("new").cast("int")).over(place)).groupBy("rid", "run").agg(F.min("at").alias("a"), (F.max("at") + length).alias("b"))
    runs = runs.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))  # bounded by a text's bytes over `length`
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    cut = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept")),
                      lambda s, r: F.struct(r["b"].alias("at"), F.concat(s["kept"], F.substring(F.col("data"), (s["at"] + 1).cast("int"), (r["a"] - s["at"]).cast("int"))).alias("kept")))
    out = rows.withColumn("data", data).join(runs, "rid", "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<a:long,b:long>>"))).withColumn("cut", cut)
    kept = F.concat("cut.kept", F.substring(F.col("data"), (F.col("cut.at") + 1).cast("int"), F.length("data")))
    n_removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return out.select("doc_id", F.length("data").cast("long").alias("n_bytes"), n_removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))
