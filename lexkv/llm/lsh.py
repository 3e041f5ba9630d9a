"""From hash buckets to exact links, without all pairs of a group as rows.

1. bucket_edges: members of each bucket are compared in blocks; of the pairs
   that pass, only a spanning forest is returned.
2. components: connected components by least labels and pointer jumping.
3. exact_links: all members of a component meet in blocks, an exact test
   counts each member's links and returns a spanning forest of the true links.

Every pair that passes step 1 lies in one component, so step 3 sees it; a
group of N members costs N*N/BLOCK rows at most, and no task holds over two
blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkv.llm.common import arrow_map, batch, grouped, materialize

#: Members of a block; two blocks meet in a task.
BLOCK = 256
#: Bytes of payload that a block may hold on average.
BLOCK_BYTES = 8 << 20
#: Pairs compared at a time.
PAIRS = 200_000


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each of n nodes' components under the pairs a[i], b[i]."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            return root
    return root


def dealt(df: DataFrame, key: str, n: str) -> DataFrame:
    """Rows with `meet` (a group of one block or a pair of blocks) and `blk`; `parts` blocks a key."""
    i = F.pmod(F.xxhash64("cid"), F.col(n))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda j: F.least(i, j) * F.col(n) + F.greatest(i, j))
    return df.withColumn("blk", i.cast("int")).withColumn("meet", F.explode(pairs)).withColumn("meet", F.xxhash64(key, "meet")).drop(n)


def _index_pairs(sizes: np.ndarray):
    """All (i < j) inside consecutive groups, in pieces of about PAIRS."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    small = sizes <= 64
    for size in np.unique(sizes[small & (sizes > 1)]):
        x, y = np.triu_indices(size, 1)
        at = start[:-1][sizes == size]
        step = max(1, PAIRS // len(x))
        for k in range(0, len(at), step):
            base = at[k : k + step, None]
            yield (base + x).ravel(), (base + y).ravel()
    for g in np.flatnonzero(~small):
        x, y = np.triu_indices(sizes[g], 1)
        for k in range(0, len(x), PAIRS):
            yield start[g] + x[k : k + PAIRS], start[g] + y[k : k + PAIRS]


def _bucket_task(passes: Callable, width: int, dtype: str):
    def task(batches):
        for t in grouped(batches, "meet"):
            meet = t["meet"].to_numpy()
            cid, blk = t["cid"].to_numpy(), t["blk"].to_numpy()
            data = np.frombuffer(b"".join(x.as_py() for x in t["payload"]), dtype=dtype).reshape(len(cid), width)
            first = np.flatnonzero(np.r_[True, meet[1:] != meet[:-1]])
            sizes = np.diff(np.r_[first, len(meet)])
            alone = np.minimum.reduceat(blk, first) == np.maximum.reduceat(blk, first)
            alone = np.repeat(alone, sizes)
            a, b = [], []
            for i, j in _index_pairs(sizes):
                ok = alone[i] | (blk[i] != blk[j])
                i, j = i[ok], j[ok]
                ok = passes(data, i, j)
                a.append(i[ok])
                b.append(j[ok])
            if a:
                root = roots_of(len(cid), np.concatenate(a), np.concatenate(b))
                moved = np.flatnonzero(root != np.arange(len(cid)))
                if len(moved):
                    yield batch(a=cid[moved], b=cid[root[moved]])

    return task


def bucket_edges(buckets: DataFrame, payload: DataFrame, passes: Callable, width: int, dtype: str) -> DataFrame:
    """buckets (key, cid); payload (cid, payload binary). Edges (a, b) that span what passes(data, i, j) lets through."""
    full = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = buckets.join(full, "key").withColumn("parts", F.ceil(F.col("n") / BLOCK)).drop("n")
    rows = dealt(members, "key", "parts").drop("key").join(payload, "cid")
    # in order of cid, so that buckets that share members tend to share their roots
    rows = rows.repartition("meet").sortWithinPartitions("meet", "cid")
    return arrow_map(rows, _bucket_task(passes, width, dtype), "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(cid, comp): the least cid reachable; only for cids that have an edge."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), f"{name}-edges")
    now = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("cid"), F.least("a", "b").alias("comp"))
    now = materialize(now, f"{name}-labels")
    while True:
        near = both.join(now, both.b == now.cid).groupBy("a").agg(F.min("comp").alias("near"))
        step = now.join(near, now.cid == near.a, "left").select("cid", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        up = now.select(F.col("cid").alias("up"), F.col("comp").alias("over"))
        step = materialize(step.join(up, step.comp == up.up, "left").select("cid", F.least("comp", "over").alias("comp"), "was"), f"{name}-labels")
        moved = step.filter("comp <> was").limit(1).count()
        now = step.select("cid", "comp")
        if not moved:
            return now


def _exact_task(linked: Callable):
    def task(batches):
        for t in grouped(batches, "meet", 512):
            meet = t["meet"].to_numpy()
            cid, blk, copies = t["cid"].to_numpy(), t["blk"].to_numpy(), t["copies"].to_numpy()
            first = np.flatnonzero(np.r_[True, meet[1:] != meet[:-1]])
            ids, counts, roots = [], [], []
            for lo, hi in zip(first, np.r_[first[1:], len(meet)], strict=True):
                if hi - lo < 2:
                    continue
                m = linked([x.as_py() for x in t["payload"].slice(lo, hi - lo)])
                own = blk[lo:hi]
                if own.min() != own.max():
                    m &= own[:, None] != own[None, :]
                np.fill_diagonal(m, False)
                a, b = np.nonzero(np.triu(m))
                if not len(a):
                    continue
                ids.append(cid[lo:hi])
                counts.append(m.astype(np.int64) @ copies[lo:hi])
                roots.append(cid[lo:hi][roots_of(hi - lo, a, b)])
            if ids:
                yield batch(cid=np.concatenate(ids), links=np.concatenate(counts), root=np.concatenate(roots))

    return task


def exact_links(members: DataFrame, linked: Callable, name: str) -> tuple[DataFrame, DataFrame]:
    """members (comp, cid, copies, payload). Links of each cid in rows of other cids, and (cid, comp) by true links.

    linked(payloads) gives the square matrix of links of two blocks at most.
    """
    size = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
    rows = dealt(members.join(size, "comp").withColumn("parts", parts).drop("n", "bytes"), "comp", "parts")
    rows = rows.select("meet", "blk", "cid", "copies", "payload").repartition("meet").sortWithinPartitions("meet", "cid")
    found = materialize(arrow_map(rows, _exact_task(linked), "cid long, links long, root long", 256), f"{name}-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    return links, components(found.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct(), name)

