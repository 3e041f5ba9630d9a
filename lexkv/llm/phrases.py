"""Lempel-Ziv phrase fingerprints.

A text is parsed into LZ78 dictionary phrases; the minima of hashes of the
phrase set form its fingerprint, whose agreement estimates how many phrases two
texts share, as a compressor would find them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkv.llm.common import U64, arrow_map, batch, longs, mix, strings

VALUES = 128
#: Code points after which the dictionary starts afresh; bounds the memory of long texts.
FRESH = 1 << 20
PIECE = 4096
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.RandomState(77)
_MUL = (np.frombuffer(_rng.bytes(8 * VALUES), dtype=U64) | U64(1)).reshape(-1, 1)
_POWERS = np.concatenate([[1], np.cumprod(np.full(FRESH, _BASE, dtype=U64))]).astype(U64)


def parse(text: str, known: set[str], ends: list[int], start: int = 0) -> None:
    """Append the ends of the LZ78 phrases of text from start on; the last may be a known phrase."""
    phrase = ""
    at = start
    add, end = known.add, ends.append
    for c in text[start:] if start else text:
        phrase += c
        at += 1
        if phrase not in known:
            add(phrase)
            end(at)
            phrase = ""
    if phrase:
        end(at)


def fingerprint_of(hashes: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, 0xFFFF, dtype=np.uint16)
    best = np.full(VALUES, 0xFFFFFFFFFFFFFFFF, dtype=U64)
    for k in range(0, len(hashes), PIECE):
        best = np.minimum(best, (hashes[None, k : k + PIECE] * _MUL).min(axis=1))
    return mix(best).astype(np.uint16) if len(hashes) else low


class Parsed:
    """A text's phrases; edited() re-uses those of the unchanged beginning."""

    def __init__(self, text: str):
        self.text = text
        self.parts: list[list[int]] = []
        for k in range(0, len(text), FRESH):
            ends: list[int] = []
            parse(text[k : k + FRESH], set(), ends)
            self.parts.append(ends)

    def hashes(self) -> np.ndarray:
        return np.concatenate([self._of(self.text[k * FRESH : (k + 1) * FRESH], e) for k, e in enumerate(self.parts)] or [np.zeros(0, dtype=U64)])

    @staticmethod
    def _of(text: str, ends: list[int]) -> np.ndarray:
        # hashes are relative to a fixed length, so that they agree across texts
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64) + U64(1)
        e = np.array(ends, dtype=np.int64)
        s = np.concatenate([[0], e[:-1]]).astype(np.int64)
        prefix = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(codes) * _POWERS[: len(codes)], dtype=U64)])
        return mix((prefix[e] - prefix[s]) * _POWERS[FRESH - s])

    def edited(self, text: str) -> np.ndarray:
        """Hashes of the phrases of a text that begins as this one does; parsed afresh from where they part."""
        same = 0
        n = min(len(text), len(self.text))
        if text[:n] == self.text[:n]:
            same = n
        else:
            lo, hi = 0, n
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if text[:mid] == self.text[:mid] else (lo, mid)
            same = lo
        out = []
        for k in range(0, len(text), FRESH):
            part = text[k : k + FRESH]
            ends, known, start = [], set(), 0
            if k // FRESH < len(self.parts):
                limit = min(same - k, len(part))
                for e in self.parts[k // FRESH]:
                    if e > limit or e == len(self.text) - k:
                        break
                    known.add(part[start:e])
                    ends.append(e)
                    start = e
            parse(part, known, ends, start)
            out.append(self._of(part, ends))
        return np.concatenate(out or [np.zeros(0, dtype=U64)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, after: str) -> str:
    """The last third of text replaced by the first as many code points of after (or all of it)."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _task(batches):
    held = None

    def digest(doc, text, head, print_, after, after_print):
        new = edited_text(text, after)
        own = fingerprint_of(print_.edited(new))
        return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), head.tobytes().hex(), own.tobytes().hex(), likeness(head, own), likeness(head, after_print)

    for b in batches:
        rows = []
        for doc, text, guest in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["guest"].to_pylist(), strict=True):
            parsed = Parsed(text or "")
            mark = fingerprint_of(parsed.hashes())
            if held is not None:
                rows.append(digest(*held, text or "", mark))
            held = None if guest else (doc, text or "", mark, parsed)
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        yield batch(doc_id=longs(cols[0]), n_chars=longs(cols[1]), edited_sha256=strings(cols[2]), fingerprint=strings(cols[3]), edited_fingerprint=strings(cols[4]),
                    near_edited=pa.array(cols[5], pa.float64()), near_next=pa.array(cols[6], pa.float64()))
    if held is not None:
        raise ValueError("a bucket of documents does not end with the next bucket's first")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprinted(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one after in descending order of (doc_id, text),
    null doc_ids last; the last one's next is the first. Null texts count as
    empty; an empty text has no phrases and a fingerprint of its own. Repeated
    rows stand next to each other; extra columns are ignored; an empty table
    gives an empty result. Documents are dealt in ranges of doc_id; each range
    is closed by a copy of the next range's first document.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = rows.filter("doc_id is not null").approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets)
    splits = sorted({int(x) for x in splits})
    low = F.lit(len(splits) + 1)
    if splits:
        place = F.lit(len(splits)) - F.size(F.filter(F.array(*[F.lit(x) for x in splits]), lambda x: x <= F.col("doc_id")))
        rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), low).otherwise(place))
    else:
        rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), low).otherwise(F.lit(0)))
    # the first document of each bucket also closes the bucket before it; buckets are as many as splits
    full = [r.bucket for r in rows.select("bucket").distinct().orderBy("bucket").collect()]
    first = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    heads = rows.join(F.broadcast(first.withColumnRenamed("doc_id", "top").withColumnRenamed("bucket", "of")), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("x")).select("bucket", "x.doc_id", "x.text")
    before = {b: full[k - 1] for k, b in enumerate(full)}
    if not full:
        return arrow_map(rows.withColumn("guest", F.lit(True)).select("doc_id", "text", "guest"), _task, SCHEMA)
    closing = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket"))
    guests = heads.select("doc_id", "text", closing.alias("bucket"), F.lit(True).alias("guest"))
    every = rows.select("doc_id", "text", "bucket", F.lit(False).alias("guest")).unionByName(guests)
    every = every.repartitionById(max(full) + 1, F.col("bucket").cast("int"))
    every = every.sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    return arrow_map(every.select("doc_id", "text", "guest"), _task, SCHEMA, 200)

