"""Removal of repeated strings by winnowing and hash names of substrings, in place of prefix doubling.

A position has 64-bit names (hashes, no ranks) of the bytes that start there,
for growing lengths. Spark brings equal names together, in sorted arrays by
shard; positions whose name is unique at one length drop out before the next:

1. 64 bytes, at sampled positions only: in each stretch of 200 bytes the
   position with the least name. Equal 200-byte strings have the same one at
   the same place, so a string is unique if its sampled name is.
2. Stretches of 200 to 336 bytes from one sampled position to another. Where
   such a stretch repeats, all strings inside do; one copy stands for all.
3. 200 bytes, at the positions left over and inside the copies that stand.

Each round, map tasks send the distinct names of a block of documents and get
two bits back for each: repeated, and first. The bits are side files in the
shared folder; a later pass over the same blocks names its positions again, so
neither texts nor positions are shuffled.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkv.llm.common import U64, arrow_map, batch, binaries, counted, each_group, longs, materialize, mix, placed, put_file, shared_path, split_by_shard, strings, to_shards

LENGTH = 200
GRAM = 64
#: Bytes of a block of documents, of a piece hashed at a time, and of text that a shard stands for.
BLOCK_BYTES, PIECE_BYTES, SHARD_BYTES = 4 << 20, 1 << 18, 4 << 20
#: Bytes that a piece of a long document reads beyond its own positions.
BEYOND = 2 * LENGTH
_MOST = 2 * PIECE_BYTES + BEYOND + 1
_rng = np.random.RandomState(4711)
_TABLE = np.frombuffer(_rng.bytes(8 * 256), dtype=U64)
_BASE = 0xD1342543DE82EF95
_POWER = np.concatenate([np.ones(1, dtype=U64), np.cumprod(np.full(_MOST, _BASE, dtype=U64))])
_INVERSE = np.concatenate([np.ones(1, dtype=U64), np.cumprod(np.full(_MOST, pow(_BASE, -1, 1 << 64), dtype=U64))])


def _named(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` consecutive values."""
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


class Piece:
    """Whole short documents, or a part of a long one, joined into one array of bytes.

    parts: (document, offset in it, bytes, own): the first `own` positions are
    this piece's; what follows is only read.
    """

    def __init__(self, parts: list[tuple[int, int, bytes, int]], length: int):
        self.parts, self.length = parts, length
        data = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
        n = len(data)
        self.sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(_TABLE[data] * _POWER[:n], dtype=U64)])
        self.starts = np.cumsum([0] + [len(p[2]) for p in parts])
        windows = max(0, n - length + 1)
        self.valid = np.zeros(windows, dtype=bool)
        for (_, _, b, own), at in zip(parts, self.starts, strict=False):
            self.valid[at : at + max(0, min(own, len(b) - length + 1))] = True
        fits = np.zeros(windows, dtype=bool)
        for (_, _, b, _), at in zip(parts, self.starts, strict=False):
            fits[at : at + max(0, len(b) - length + 1)] = True
        gram = min(GRAM, length)
        width = length - gram + 1
        if not windows:
            self.least = self.sampled = self.names = self.a = self.e = self.spans = np.zeros(0, dtype=U64)
            self.a = self.e = np.zeros(0, dtype=np.int64)
            return
        grams = self.name(np.arange(n - gram + 1), gram)
        self.least = _slide(grams, width, np.minimum)
        none = np.zeros(width - 1, dtype=U64)
        most = _slide(np.concatenate([none, np.where(fits, self.least, U64(0)), none]), width, np.maximum)
        self.sampled = np.flatnonzero(most == grams)
        # least names are small numbers: mixed again, they spread over the shards
        self.names = mix(grams[self.sampled])
        j = np.searchsorted(self.sampled, self.sampled + length - gram)
        doc = np.searchsorted(self.starts, self.sampled, side="right") - 1
        ok = j < len(self.sampled)
        ok[ok] = doc[ok] == doc[j[ok]]
        limit = np.array([at + p[3] for p, at in zip(parts, self.starts, strict=False)])
        ok &= self.sampled < limit[doc]
        self.a, self.e = self.sampled[ok], self.sampled[j[ok]] + gram
        # spans have names of their own: mixed with their length and a mark
        raw = (self.sums[self.e] - self.sums[self.a]) * _INVERSE[self.a]
        self.spans = mix(mix(raw) + (self.e - self.a).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))

    def name(self, at: np.ndarray, length: int) -> np.ndarray:
        return _named((self.sums[at + length] - self.sums[at]) * _INVERSE[at])

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Own windows whose sampled name is repeated."""
        if not len(self.least):
            return self.valid
        new = np.flatnonzero(np.r_[True, self.least[1:] != self.least[:-1]])
        hit = _among(mix(self.least[new]), repeated)
        return self.valid & np.repeat(hit, np.diff(np.r_[new, len(self.least)]))

    def inside(self, ok: np.ndarray) -> np.ndarray:
        """Windows inside the stretches that ok marks."""
        d = np.zeros(len(self.valid) + 1, dtype=np.int32)
        np.add.at(d, self.a[ok], 1)
        np.add.at(d, self.e[ok] - self.length + 1, -1)
        return np.cumsum(d[:-1]) > 0


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    return table[np.searchsorted(table, x).clip(max=len(table) - 1)] == x


class Block:
    """Documents of about BLOCK_BYTES, as pieces."""

    def __init__(self, texts: list[bytes], length: int):
        self.texts, self.pieces, self.length = texts, [], length
        parts, n = [], 0
        for d, b in enumerate(texts):
            if len(b) < length:
                continue
            if len(b) > PIECE_BYTES:
                for k in range(0, len(b), PIECE_BYTES):
                    self.pieces.append(Piece([(d, k, b[k : k + PIECE_BYTES + BEYOND], PIECE_BYTES)], length))
                continue
            parts.append((d, 0, b, len(b)))
            n += len(b)
            if n >= PIECE_BYTES:
                self.pieces.append(Piece(parts, length))
                parts, n = [], 0
        if parts:
            self.pieces.append(Piece(parts, length))

    def first_names(self) -> np.ndarray:
        return np.concatenate([x for p in self.pieces for x in (p.names, p.spans)] or [np.zeros(0, dtype=U64)])

    def windows(self, repeated: np.ndarray, first: np.ndarray):
        """For each piece: positions proven to repeat, and positions whose names are to be compared."""
        seen: set[int] = set()
        for p in self.pieces:
            proven = p.inside(_among(p.spans, repeated)) & p.valid
            stand = np.flatnonzero(_among(p.spans, first))
            stand = np.array([k for k in stand if (x := int(p.spans[k])) not in seen and not seen.add(x)], dtype=np.int64)
            yield p, proven, np.flatnonzero(p.candidates(repeated) & (~proven | p.inside(stand)))


BLOCKS = "block long, ids array<long>, sizes array<long>, data binary"


def blocked(docs: DataFrame) -> DataFrame:
    """docs as a written table of blocks, so that all passes see the same blocks in the same order, however they are split."""

    def task(batches):
        part, k, ids, texts, n = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            return batch(block=longs([part << 24 | k]), ids=pa.array([ids], pa.list_(pa.int64())), sizes=pa.array([list(map(len, texts))], pa.list_(pa.int64())), data=binaries([b"".join(texts)]))

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids.append(doc)
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                n += len(texts[-1])
                if n >= BLOCK_BYTES:
                    yield block()
                    k, ids, texts, n = k + 1, [], [], 0
        if ids:
            yield block()

    # rows are large: few of them make a row group, which is read at once
    options = {"parquet.block.row.count.limit": 2, "parquet.page.size.row.check.min": 1}
    return materialize(arrow_map(docs.select("doc_id", "text"), task, BLOCKS), "suffix-blocks", **options)


def each_block(batches, length: int):
    """(block id, doc ids, Block) of the rows of blocked()."""
    for b in batches:
        for key, ids, sizes, data in zip(b["block"].to_pylist(), b["ids"].to_pylist(), b["sizes"].to_pylist(), b["data"], strict=True):
            ends = np.cumsum(sizes).tolist()
            data = data.as_py()
            yield key, ids, Block([data[e - n : e] for e, n in zip(ends, sizes, strict=True)], length)


def _order(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names sorted, which is by shard as well, and whether they occur again in the block."""
    u, n = counted(names)
    return u, n > 1


def _rows(block: int, names: np.ndarray, shards: int) -> pa.RecordBatch:
    u, again = _order(names)
    shard = (u >> U64(64 - shards.bit_length() + 1)).astype(np.int64)
    parts = list(split_by_shard(shard, shards, u, again))
    return batch(shard=longs([s for s, _ in parts]), block=longs([block] * len(parts)), names=binaries([x.tobytes() for _, (x, _) in parts]), again=binaries([np.packbits(y).tobytes() for _, (_, y) in parts]))


NAMED = "shard long, block long, names binary, again binary"
BITS = "block long, shard long, n long, repeated binary, first binary"


def _compared(batches):
    for t in each_group(batches, "shard"):
        parts = [np.frombuffer(x.as_py(), dtype="<u8") for x in t["names"]]
        sizes = [len(x) for x in parts]
        u, at, inv = placed(np.concatenate(parts))
        n = np.bincount(inv, minlength=len(u))
        again = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=k) for x, k in zip(t["again"], sizes, strict=True)])
        repeated = n > 1
        repeated[inv[again > 0]] = True
        first = np.zeros(len(inv), dtype=bool)
        first[at] = True
        cut = np.cumsum(sizes)[:-1]
        rows = [(np.packbits(r).tobytes(), np.packbits(f).tobytes()) for r, f in zip(np.split(repeated[inv], cut), np.split(first & repeated[inv], cut), strict=True)]
        yield batch(block=t["block"].combine_chunks(), shard=t["shard"].combine_chunks(), n=longs(sizes), repeated=binaries([r for r, _ in rows]), first=binaries([f for _, f in rows]))


def _written(path: str):
    def task(batches):
        for t in each_group(batches, "block"):
            sizes = t["n"].to_pylist()
            bits = [np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=k) for x, k in zip(t[c], sizes, strict=True)]) for c in ("repeated", "first")]
            put_file(f"{path}/{t['block'][0].as_py()}", (bits[0] | bits[1] << 1).astype(np.uint8).tobytes())
            yield batch(block=longs([t["block"][0].as_py()]))

    return task


def _marked(path: str, block: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct names that are repeated, and those that it has first."""
    u, _ = _order(names)
    file = f"{path}/{block}"
    if not len(u):
        return u, u
    bits = np.fromfile(file, dtype=np.uint8) if os.path.exists(file) else np.zeros(0, dtype=np.uint8)
    if len(bits) != len(u):
        raise ValueError(f"the bits of block {block} are not those of its names")
    return u[(bits & 1) > 0], u[(bits & 2) > 0]


def _round(rows: DataFrame, task, shards: int, name: str) -> str:
    path = shared_path(rows.sparkSession, name)
    bits = arrow_map(to_shards(arrow_map(rows, task, NAMED, 1), shards), _compared, BITS, 64)
    bits = bits.repartition("block").sortWithinPartitions("block", "shard")
    arrow_map(bits, _written(path), "block long", 256).agg(F.count("*")).collect()
    return path


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(block: Block, one: str, two: str, key: int) -> list[np.ndarray | None]:
    """For each document the mask of bytes that repeated strings cover; None where there are none."""
    repeated, first = _marked(one, key, block.first_names())
    found = [(p, proven, at, p.name(at, block.length)) for p, proven, at in block.windows(repeated, first)]
    again, _ = _marked(two, key, np.concatenate([x[3] for x in found] or [np.zeros(0, dtype=U64)]))
    masks: list[np.ndarray | None] = [None] * len(block.texts)
    for p, proven, at, names in found:
        hit = proven
        hit[at[_among(names, again)]] = True
        if not hit.any():
            continue
        for (d, offset, b, _), start in zip(p.parts, p.starts, strict=False):
            s = np.flatnonzero(hit[start : start + len(b)])
            if len(s):
                if masks[d] is None:
                    masks[d] = np.zeros(len(block.texts[d]) + 1, dtype=np.int32)
                np.add.at(masks[d], s + offset, 1)
                np.add.at(masks[d], s + offset + block.length, -1)
    return [None if m is None else np.cumsum(m[:-1]) > 0 for m in masks]


def removed(docs: DataFrame, length: int = LENGTH, shards: int | None = None, texts: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, if texts).

    Every byte covered by a string of `length` UTF-8 bytes that starts anywhere
    else as well is removed. Null and empty texts have no bytes; texts shorter
    than length keep all; repeated rows remove each other; a null doc_id stays
    null; extra columns are ignored; an empty table gives an empty result. Two
    strings of one name that differ are taken as equal; names have 64 bits.
    """
    if not GRAM <= length <= BEYOND // 2:
        raise ValueError(f"length must be {GRAM} to {BEYOND // 2}")
    rows = blocked(docs)
    if shards is None:
        size = rows.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
        shards = 1 << max(4, min(16, (size // SHARD_BYTES).bit_length()))

    def sampled(batches):
        for key, _, block in each_block(batches, length):
            yield _rows(key, block.first_names(), shards)

    one = _round(rows, sampled, shards, "suffix-sampled")

    def whole(batches):
        for key, _, block in each_block(batches, length):
            repeated, first = _marked(one, key, block.first_names())
            names = [p.name(at, length) for p, _, at in block.windows(repeated, first)]
            yield _rows(key, np.concatenate(names or [np.zeros(0, dtype=U64)]), shards)

    two = _round(rows, whole, shards, "suffix-whole")

    def task(batches):
        for key, ids, block in each_block(batches, length):
            out = []
            for doc, b, mask in zip(ids, block.texts, covered(block, one, two, key), strict=True):
                if mask is None:
                    kept, n, spans = b, 0, 0
                else:
                    n, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(b, dtype=np.uint8)[~mask].tobytes()
                out.append((doc, len(b), n, spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            cols = list(zip(*out, strict=True))
            kept = {"kept": binaries(cols[5])} if texts else {}
            yield batch(doc_id=longs(cols[0]), n_bytes=longs(cols[1]), n_removed=longs(cols[2]), n_spans=longs(cols[3]), kept_sha256=strings(cols[4]), **kept)

    return arrow_map(rows, task, RESULT + (", kept binary" if texts else ""), 1)
