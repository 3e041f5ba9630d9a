"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Rows with the same set of five-word shingles form a class. Classes that agree
on all values of a band of their MinHash signature are candidates; their
signatures are compared a few values at a time and a pair is dropped once the
posterior probability that its similarity reaches the threshold, under a
uniform prior, falls below the tolerance. Survivors are verified by the exact
Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkv.llm import lsh
from lexkv.llm.common import U64, arrow_map, batch, binaries, distinct, hashed_words, longs, materialize, mix, rolled

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
HASHES, BAND = 128, 4
STEPS = (16, 32, 64, 128)
#: Shingles hashed at a time, which bounds the memory a long text takes.
PIECE = 2048

_rng = np.random.RandomState(20240601)
_MUL = (np.frombuffer(_rng.bytes(4 * HASHES), dtype=np.uint32) | np.uint32(1)).reshape(-1, 1)
_ADD = np.frombuffer(_rng.bytes(4 * HASHES), dtype=np.uint32).reshape(-1, 1)


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    return distinct(rolled(words, min(n, len(words))) + U64(min(n, len(words)) != n))


def signature(s: np.ndarray) -> np.ndarray:
    low, s = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32), (s >> U64(32)).astype(np.uint32)
    for k in range(0, len(s), PIECE):
        low = np.minimum(low, (s[None, k : k + PIECE] * _MUL + _ADD).min(axis=1))
    return low


def class_key(s: np.ndarray) -> int:
    m = mix(s)
    x = np.array([m.sum() ^ U64(len(s)), np.bitwise_xor.reduce(m * (s | U64(1)))], dtype=U64)
    return int(mix(mix(x[:1]) + x[1:])[0].astype(np.int64))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest equal values that keep a pair). P(J >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    out = []
    for n in STEPS:
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def bayes_filter(threshold: float, tolerance: float):
    steps = least_matches(threshold, tolerance)

    def passes(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(i), dtype=bool)
        left, equal, seen = np.arange(len(i)), np.zeros(len(i), dtype=np.int32), 0
        for n, least in steps:
            equal = equal + (sig[i[left], seen:n] == sig[j[left], seen:n]).sum(axis=1)
            keep = equal >= least
            left, equal, seen = left[keep], equal[keep], n
        ok[left] = True
        return ok

    return passes


def _shingled(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The shingles of each text; rolled hashes are made for some texts at once."""
    for k in range(0, len(texts), 32):
        h, sizes = hashed_words(texts[k : k + 32])
        grams, at = rolled(h, WORDS), 0
        for n in sizes.tolist():
            yield distinct(grams[at : at + n - WORDS + 1]) if n >= WORDS else shingles(h[at : at + n])
            at += n


def _sketch(batches):
    for b in batches:
        rid, cid, sig, size = b["rid"], [], [], []
        for s in _shingled(b["text"].to_pylist()):
            size.append(len(s))
            cid.append(class_key(s) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield batch(rid=rid, doc_id=b["doc_id"], cid=longs(cid), n=longs(size), sig=binaries(sig))


def _bands(batches):
    for b in batches:
        cid = b["cid"].to_numpy()
        sig = np.frombuffer(b"".join(x.as_py() for x in b["sig"]), dtype=np.uint32).reshape(len(cid), HASHES)
        keys = np.zeros((len(cid), HASHES // BAND), dtype=U64)
        for k in range(BAND):
            keys = mix(keys * U64(0x9E3779B97F4A7C15) + sig[:, k::BAND])
        keys = mix(keys + np.arange(HASHES // BAND, dtype=U64))
        yield batch(key=keys.astype(np.int64).ravel(), cid=np.repeat(cid, HASHES // BAND))


def _sets(batches):
    for b in batches:
        sets = [s.tobytes() for s in _shingled(b["text"].to_pylist())]
        yield batch(comp=b["comp"], cid=b["cid"], copies=b["copies"], payload=binaries(sets))


def exact_jaccard(threshold: float):
    def linked(sets: list[bytes]) -> np.ndarray:
        s = [np.frombuffer(x, dtype=U64) for x in sets]
        n = np.array([len(x) for x in s])
        row = np.repeat(np.arange(len(s)), n)
        _, col = np.unique(np.concatenate(s), return_inverse=True)
        shared = np.zeros((len(s), len(s)), dtype=np.float64)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, int(col[-1]) + 1, PIECE):
            a, b = np.searchsorted(col, (lo, lo + PIECE))
            x = np.zeros((len(s), PIECE), dtype=np.float32)
            x[row[a:b], col[a:b] - lo] = 1
            shared += x @ x.T
        return shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9

    return linked


def numbered(docs: DataFrame, rid: str = "rid") -> DataFrame:
    """Rows with a number that tells repeated rows apart. They are written once: a number made in each scan changes with its splits."""
    return materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "jaccard-rows")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of docs: rid, doc_id, class_id (least doc_id of its component), n_links, kept.

    n_links counts the other rows at Jaccard similarity of five-word shingles
    >= threshold; kept marks one row of each component, that with the least
    (doc_id, rid). Words are cut at ASCII white space, in lower case. A null or
    empty text links with nothing and stays; a text of under five words is one
    shingle; repeated rows link with each other; a null doc_id counts as
    largest; other columns are ignored. An empty table gives an empty result.
    A pair at the threshold is missed with probability under 1e-6 by the bands
    ((1 - 0.8^4)^32) and by pruning (the tolerance).
    """
    return _joined(numbered(docs.select("doc_id", "text")), threshold, tolerance)


def _joined(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """jaccard_join of rows (rid, doc_id, text), whose rid is a written column."""
    sk = materialize(arrow_map(rows, _sketch, "rid long, doc_id long, cid long, n long, sig binary"), "jaccard-sketch")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("least")
    classes = materialize(sk.filter("cid is not null").groupBy("cid").agg(F.count("*").alias("copies"), least, F.max("sig").alias("sig")), "jaccard-classes")
    bands = arrow_map(classes.select("cid", "sig"), _bands, "key long, cid long")
    edges = lsh.bucket_edges(bands, classes.select("cid", F.col("sig").alias("payload")), bayes_filter(threshold, tolerance), HASHES, "<u4")
    comps = lsh.components(edges, "jaccard-candidates")
    wanted = comps.join(classes, "cid").select("comp", "cid", "copies", F.col("least.rid").alias("rid"))
    sets = arrow_map(rows.join(wanted, "rid").select("comp", "cid", "copies", "text"), _sets, "comp long, cid long, copies long, payload binary", 256)
    links, true = lsh.exact_links(sets, exact_jaccard(threshold), "jaccard")
    of = classes.select("cid", "copies", "least").join(true, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    heads = of.groupBy("comp").agg(F.min("least").alias("head"))
    of = of.join(heads, "comp").join(links, "cid", "left")
    of = of.select("cid", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sk.select("rid", "doc_id", "cid").join(of, "cid", "left")
    return out.select("rid", "doc_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("head.rid") == F.col("rid"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each near-duplicate component; rows without words stay. All columns are kept."""
    rid = "_rid" + "_" * max(map(len, docs.columns))  # a name that no column has
    rows = numbered(docs, rid)
    keep = _joined(rows.select(F.col(rid).alias("rid"), "doc_id", "text"), threshold, TOLERANCE).filter("kept").select(F.col("rid").alias(rid))
    return rows.join(keep, rid, "left_semi").drop(rid)
