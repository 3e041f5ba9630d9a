"""Helpers shared by the training-data operators: shared-folder tables, Arrow maps, hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch; texts are long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Bytes of text whose words are hashed at a time; words over LONG_WORD bytes (a multiple of 8) are hashed one by one.
HASH_BYTES, LONG_WORD = 1 << 17, 64
U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is missing, a temporary folder serves a local master;
    on a cluster the setting is required.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(shared_dir, "own", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = shared_dir.own = tempfile.mkdtemp(prefix="lexkv-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with short batches. fn takes an iterator of record batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in columns.values()], list(columns))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes of ASCII white space, which separate words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def _hashed(data: bytes, cuts: Callable | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and hashes of the words of data, eight bytes of all words at a time."""
    b = np.frombuffer(data + b" " * 9, dtype=np.uint8)
    space = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.r_[0, edges]
    start, end = edges[0::2], edges[1::2]
    if cuts is not None and len(inner := cuts(b, space)):
        start, end = np.sort(np.r_[start, inner]), np.sort(np.r_[end, inner])
    size = end - start
    eight = np.ndarray((len(b) - 7,), dtype="<u8", buffer=b.data, strides=(1,))
    h = mix(eight[start] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(U64)
    left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    for k in range(8, LONG_WORD, 8):
        left = left[size[left] > k]
        h[left] = mix(h[left] * U64(0x9E3779B97F4A7C15) + (eight[start[left] + k] & _LOW_BYTES[np.minimum(size[left] - k, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return start, size, mix(h)


def word_pieces(texts: list[str | None], cuts: Callable | None = None) -> Iterator[tuple]:
    """Some texts at a time: their bytes, where words start, words' sizes and hashes, and each text's number of words.

    Words are in lower case (A-Z), between ASCII white space; null counts as
    empty. cuts(bytes, which are white space) gives places inside words to cut at.
    """
    n, held = 0, []
    for k, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass") if t else b"")
        n += len(held[-1])
        if n >= HASH_BYTES or k + 1 == len(texts):
            data = b"\n".join(held).lower()
            start, size, h = _hashed(data, cuts)
            ends = np.cumsum([len(x) + 1 for x in held])
            yield data, start, size, h, np.diff(np.r_[0, np.searchsorted(start, ends)])
            n, held = 0, []


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in their order, and each text's number of words."""
    found = [x[3:] for x in word_pieces(texts)]
    return (np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting whole numbers is faster than np.unique, which hashes them."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)
    return x[first], np.diff(np.r_[first, len(x)])


def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each in x, and the place of each of x among them."""
    order = np.argsort(x)
    y = x[order]
    new = np.r_[True, y[1:] != y[:-1]] if len(x) else np.zeros(0, dtype=bool)
    inverse = np.empty(len(x), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return y[new], order[new], inverse


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of hashes."""
    if len(h) < n:
        return h[:0]
    out = mix(h[: len(h) - n + 1])
    for k in range(1, n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key, each of about `rows` rows or one group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        k = t[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def each_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """A table for each group, from batches sorted by key."""
    for t in grouped(batches, key, 1):
        k = t[key].to_numpy()
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for lo, hi in zip(first, np.r_[first[1:], len(k)], strict=True):
            yield t.slice(lo, hi - lo)


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def binaries(values) -> pa.Array:
    return pa.array(values, pa.binary())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a path that Python tasks can open.

    For side files that tasks map into memory; the shared folder must then be
    mounted on all machines (no scheme or file:).
    """
    path = table_path(spark, name)
    scheme, sep, rest = path.partition(":")
    if sep and scheme != "file":
        raise ValueError(f"{name} needs spark.checkpoint.dir as a mounted folder, not {scheme}:")
    path = "/" + rest.lstrip("/") if sep else path
    os.makedirs(path, exist_ok=True)
    return path


def put_file(path: str, data: bytes) -> None:
    """Write a side file whole: a task that runs twice replaces it by the same bytes."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def to_shards(df: DataFrame, shards: int) -> DataFrame:
    """Rows with `shard` in 0..shards-1 to a task each, in order of shard and block."""
    return df.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "block")


def split_by_shard(shard: np.ndarray, shards: int, *arrays: np.ndarray):
    """(shard, slices of arrays) for arrays that are ordered by shard."""
    at = np.searchsorted(shard, np.arange(shards + 1))
    for k in np.flatnonzero(at[1:] > at[:-1]):
        yield int(k), [a[at[k] : at[k + 1]] for a in arrays]
