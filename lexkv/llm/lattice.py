"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors onto 16 random orthonormal directions, shifts
them and decodes both halves to the nearest point of the E8 lattice. A vector
enters its own cell and, one half changed at a time, the neighbouring cells.
Vectors that share a cell are verified by cosine in double precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkv.llm import lsh
from lexkv.llm.common import U64, arrow_map, batch, binaries, materialize, mix

COSINE = 0.98
TABLES = 8
#: Lattice cells a unit of length.
SCALE = 3.5


def nearest_d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points with an even sum of whole coordinates, and the next by two changed coordinates."""
    r = np.rint(x)
    off = x - r
    step = np.where(off >= 0, 1.0, -1.0)
    order = np.argsort(-np.abs(off), axis=1)
    rows = np.arange(len(x))
    odd = (r.sum(axis=1) % 2) != 0
    best = r.copy()
    first, second = order[:, 0], order[:, 1]
    best[rows[odd], first[odd]] += step[rows[odd], first[odd]]
    other = r.copy()
    other[rows, second] += step[rows, second]
    other[rows[~odd], first[~odd]] += step[rows[~odd], first[~odd]]
    return best, other


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """For each row the nearest E8 point and two neighbouring points: shape (rows, 3, 8), doubled to whole numbers."""
    a, a2 = nearest_d8(x)
    b, b2 = nearest_d8(x - 0.5)
    b, b2 = b + 0.5, b2 + 0.5
    near = (((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None]
    out = np.stack([np.where(near, a, b), np.where(near, b, a), np.where(near, a2, b2)], axis=1)
    return np.rint(2 * out).astype(np.int64)


def _projection(d: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(7919 * table + d)
    q = rng.normal(size=(max(d, 16), 16))
    q = np.linalg.qr(q)[0][:d]
    # orthonormal rows spread a difference of 64 dimensions over 16: scale back as for 64
    return q * SCALE * np.sqrt(max(d, 16) / 64), rng.uniform(0, 1, 16)


def _hash(points: np.ndarray) -> np.ndarray:
    h = np.zeros(points.shape[:-1], dtype=U64)
    for k in range(points.shape[-1]):
        h = mix(h * U64(0x9E3779B97F4A7C15) + points[..., k].astype(U64))
    return h


def _unit(b) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in b["payload"]), dtype="<f8").reshape(b.num_rows, -1)


def cells(tables: int, width: int):
    def task(batches):
        parts = [_projection(width, t) for t in range(tables)]
        for b in batches:
            if not b.num_rows:
                continue
            v = _unit(b)
            v = v / np.sqrt((v * v).sum(axis=1))[:, None]
            label = b["label"].to_numpy().astype(np.int64).astype(U64)
            keys = []
            for t, (p, shift) in enumerate(parts):
                y = v @ p + shift
                lo, hi = _hash(nearest_e8(y[:, :8])), _hash(nearest_e8(y[:, 8:]))
                for i, j in ((0, 0), (1, 0), (2, 0), (0, 1), (0, 2)):
                    keys.append(mix(mix(lo[:, i] + mix(hi[:, j])) ^ mix(label * U64(2 * tables + 1) + U64(t))))
            yield batch(key=np.stack(keys, axis=1).astype(np.int64).ravel(), cid=np.repeat(b["cid"].to_numpy(), len(keys)))

    return task


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of one label (not null) and one width link, at cosine >=
    `cosine` in double precision. Null, empty or zero vectors and those with
    null or non-finite components link with nothing; so do rows without label.
    Repeated rows link with each other; component_id is the least vec_id
    reachable (a null vec_id is its own); extra columns are ignored. An empty
    table gives an empty result. Recall of links is measured by the tests.
    """
    v = vectors.select("vec_id", "label", "embedding").withColumn("rid", F.monotonically_increasing_id())
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("label").isNotNull() & F.coalesce(whole & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = v.withColumn("cid", F.when(ok, F.xxhash64("label", F.transform("embedding", lambda x: x + 0.0))))
    v = materialize(v, "lattice-rows")
    widths = [r.w for r in v.filter("cid is not null").select(F.size("embedding").alias("w")).distinct().limit(65).collect()]
    if len(widths) > 64:
        raise ValueError("over 64 widths of vectors")
    links = comps = None
    classes = v.filter("cid is not null").groupBy("cid").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min(F.struct("label", "embedding")).alias("x"))
    classes = materialize(classes.select("cid", "copies", "least", "x.label", F.col("x.embedding").alias("embedding")), "lattice-classes")
    for w in sorted(widths):
        raw = arrow_map(classes.filter(F.size("embedding") == w).select("cid", "copies", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")), _packed, "cid long, copies long, label long, payload binary", 4000)
        payload = materialize(raw, "lattice-vectors")
        buckets = arrow_map(payload.select("cid", "label", "payload"), cells(tables, w), "key long, cid long", 4000).distinct()
        edges = lsh.bucket_edges(buckets, payload.select("cid", "payload"), lambda x, i, j: _cosines(x[i], x[j]) >= cosine, w, "<f8")
        found = lsh.components(edges, "lattice-candidates")
        members = found.join(payload, "cid").withColumn("payload", F.concat(F.unhex(F.lpad(F.hex("label"), 16, "0")), "payload"))
        a, b = lsh.exact_links(members.select("comp", "cid", "copies", "payload"), _exact(cosine), "lattice")
        links, comps = (a, b) if links is None else (links.unionByName(a), comps.unionByName(b))
    of = classes.select("cid", "copies", "least")
    if links is not None:
        of = of.join(comps, "cid", "left").join(links, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    else:
        of = of.withColumn("comp", F.col("cid")).withColumn("links", F.lit(0))
    heads = of.groupBy("comp").agg(F.min("least").alias("head"))
    of = of.join(heads, "comp").select("cid", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = v.select("vec_id", "cid").join(of, "cid", "left")
    head = F.when(F.col("vec_id").isNotNull(), F.coalesce("head", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), head.alias("component_id"), F.coalesce(head == F.col("vec_id"), F.lit(True)).alias("kept"))


def _packed(batches):
    for b in batches:
        rows = [np.asarray(x.as_py(), dtype="<f8").tobytes() for x in b["embedding"]]
        yield batch(cid=b["cid"], copies=b["copies"], label=b["label"], payload=binaries(rows))


def _exact(cosine: float):
    def linked(rows: list[bytes]) -> np.ndarray:
        label = np.array([int.from_bytes(x[:8], "big") for x in rows])
        x = np.frombuffer(b"".join(r[8:] for r in rows), dtype="<f8").reshape(len(rows), -1)
        norm = np.sqrt((x * x).sum(axis=1))
        return ((x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine) & (label[:, None] == label[None, :])

    return linked
