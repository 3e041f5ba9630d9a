"""Interpolated modified Kneser-Ney language model of word pairs, counted in Spark.

Pass 1 counts words, pass 2 counts pairs of words. Map tasks count what they
hold and cut it by shard; each shard is merged by one task, which writes sorted
arrays of hashes with their counts to the shared folder. Scoring tasks map the
arrays into memory, shard by shard, and look up the sorted pairs of a block of
texts (CHUNK_TOKENS) at once, so a file is opened once a block.

A pair's shard follows its first word, so that a shard knows all that follows
a word. Words so common that their followers alone would fill a shard (at most
HEAVY * shards words can be) are spread by the second word as well; what their
shards know of them is summed.
"""

from __future__ import annotations

import mmap
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexkv.llm.common import U64, arrow_map, batch, binaries, counted, each_group, hashed_words, longs, materialize, mix, placed, put_file, shared_path, split_by_shard, to_shards

#: Tokens that a task counts or scores at a time, and bytes of text a shard stands for.
CHUNK_TOKENS, SHARD_BYTES = 2_000_000, 8 << 20
HEAVY = 8
#: Shards are told by the upper bits of hashes, 16 at most.
MOST_SHARDS = 1 << 16
#: Marks before the first word and after the last; no word holds white space.
BEGIN, END = U64(xxhash.xxh64_intdigest(b" begin")), U64(xxhash.xxh64_intdigest(b" end"))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of BEGIN, words, END of all texts, and each text's number of tokens (words and the end)."""
    words, n = hashed_words(texts)
    ends = np.cumsum(n + 2)
    h = np.zeros(len(words) + 2 * len(texts), dtype=U64)
    inner = np.ones(len(h), dtype=bool)
    inner[ends - 1] = inner[ends - n - 2] = False
    h[inner], h[ends - 1], h[ends - n - 2] = words, END, BEGIN
    return h, n + 1


def _chunks(batches):
    """Token hashes of about CHUNK_TOKENS, whole texts."""
    held, n = [], 0
    for b in batches:
        h, _ = tokens(b["text"].to_pylist())
        held.append(h)
        n += len(h)
        if n >= CHUNK_TOKENS:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> U64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(hashes), dtype=np.int64)


def routes(first: np.ndarray, second: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Hashes by whose upper bits pairs go to shards."""
    if not len(heavy):
        return first
    at = np.searchsorted(heavy, first).clip(max=len(heavy) - 1)
    return np.where(heavy[at] == first, first ^ mix(second), first)


def pair_key(first: np.ndarray, second: np.ndarray, route: np.ndarray) -> np.ndarray:
    """A pair's hash below the 16 upper bits of its route: sorted keys are sorted by shard."""
    return route & U64(0xFFFF << 48) | mix(mix(first) * U64(0x9E3779B97F4A7C15) + second) >> U64(16)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    u, _, at = placed(keys)
    return u, *[np.bincount(at, weights=v, minlength=len(u)).astype(np.int64) for v in values]


def _counted_words(shards: int):
    def task(batches):
        for k, h in enumerate(_chunks(batches)):
            u, n = counted(h)
            parts = list(split_by_shard(shard_of(u, shards), shards, u, n))
            yield batch(shard=longs([p[0] for p in parts]), block=longs([k] * len(parts)), a=binaries([p[1][0].tobytes() for p in parts]), n=binaries([p[1][1].astype("<i8").tobytes() for p in parts]))

    return task


def _joined(t: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in t[column]), dtype=dtype)


def _merged_words(path: str):
    def task(batches):
        for t in each_group(batches, "shard"):
            shard = t["shard"][0].as_py()
            w, n = _summed(_joined(t, "a", "<u8"), _joined(t, "n", "<i8"))
            put_table(f"{path}/words-{shard}", w, n)
            real = w != BEGIN
            top = np.argsort(-n, kind="stable")[: 8 * HEAVY]
            yield batch(shard=longs([shard]), words=longs([int(real.sum())]), tokens=longs([int(n[real].sum())]), top=binaries([w[top].tobytes()]), top_n=binaries([n[top].astype("<i8").tobytes()]))

    return task


def _counted_pairs(heavy: np.ndarray, shards: int):
    def task(batches):
        for k, h in enumerate(_chunks(batches)):
            ok = h[1:] != BEGIN
            a, b = h[:-1][ok], h[1:][ok]
            route = routes(a, b, heavy)
            # by shard, then by parts of both hashes: a pair that these part from its like is merged later
            order = np.argsort(route & U64(0xFFFF << 48) | a >> U64(16) << U64(40) >> U64(16) | b >> U64(40))
            a, b, route = a[order], b[order], route[order]
            at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            n = np.diff(np.r_[at, len(a)])
            rows = []
            for shard, (x, y, c) in split_by_shard(shard_of(route[at], shards), shards, a[at], b[at], n):
                new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                big = np.flatnonzero(c > 254)
                small = c.clip(max=255).astype(np.uint8)
                rows.append((shard, k, x[new].tobytes(), np.diff(np.r_[new, len(x)]).astype("<u4").tobytes(), y.tobytes(), small.tobytes(), c[big].astype("<i8").tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield batch(shard=longs(cols[0]), block=longs(cols[1]), a=binaries(cols[2]), runs=binaries(cols[3]), b=binaries(cols[4]), n=binaries(cols[5]), big=binaries(cols[6]))

    return task


PAIRS = "shard long, block long, a binary, runs binary, b binary, n binary, big binary"
MERGED = "kind string, shard long, block long, a binary, n binary"


def _merged_pairs(path: str, heavy: np.ndarray, shards: int):
    """Writes a shard's pairs and what it knows of first words; gives what others need: heavy first words, second words, counts of counts."""

    def task(batches):
        for t in each_group(batches, "shard"):
            shard = t["shard"][0].as_py()
            first = np.repeat(_joined(t, "a", "<u8"), _joined(t, "runs", "<u4"))
            second = _joined(t, "b", "<u8")
            n = _joined(t, "n", "u1").astype(np.int64)
            n[n == 255] = _joined(t, "big", "<i8")
            u, at, inv = placed(pair_key(first, second, routes(first, second, heavy)))
            n = np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64)
            first, second = first[at], second[at]
            put_table(f"{path}/pairs-{shard}", u, n)
            w, *stats = _summed(first, n, n == 1, n == 2, n > 2)
            far = np.isin(w, heavy)
            put_table(f"{path}/first-{shard}", w[~far], *[x[~far] for x in stats])
            rows = [("counts", shard, b"", np.array([(n == k).sum() for k in (1, 2, 3, 4)], dtype="<i8").tobytes())]
            if far.any():
                rows += [("heavy", s, x.tobytes(), np.array(y, dtype="<i8").tobytes()) for s, (x, *y) in split_by_shard(shard_of(w[far], shards), shards, w[far], *[x[far] for x in stats])]
            v, c = counted(second)
            rows += [("second", s, x.tobytes(), y.astype("<u4").tobytes()) for s, (x, y) in split_by_shard(shard_of(v, shards), shards, v, c)]
            yield batch(kind=pa.array([r[0] for r in rows]), shard=longs([r[1] for r in rows]), block=longs([shard] * len(rows)), a=binaries([r[2] for r in rows]), n=binaries([r[3] for r in rows]))

    return task


def _merged_seconds(path: str):
    """Writes all that is known of a shard's words; gives counts of counts."""

    def task(batches):
        for t in each_group(batches, "shard"):
            shard, kinds = t["shard"][0].as_py(), t["kind"].to_numpy(zero_copy_only=False)
            pairs = _joined(t.filter(pa.array(kinds == "counts")), "n", "<i8").reshape(-1, 4).sum(axis=0)
            part = t.filter(pa.array(kinds == "second"))
            w, n = _summed(_joined(part, "a", "<u8"), _joined(part, "n", "<u4"))
            counts = np.array([n.sum(), *[(n == k).sum() for k in (1, 2, 3, 4)]])
            words, known = _mapped(f"{path}/words-{shard}") or (np.zeros(0, dtype=U64), np.zeros((1, 0), dtype=np.int64))
            known = np.concatenate([known, np.zeros((5, len(words)), dtype=np.int64)])
            known[1, np.searchsorted(words, w)] = n
            first = _mapped(f"{path}/first-{shard}")
            if first:
                known[2:, np.searchsorted(words, first[0])] = first[1]
            part = t.filter(pa.array(kinds == "heavy"))
            for x, y in zip(part["a"], part["n"], strict=True):
                x = np.frombuffer(x.as_py(), dtype="<u8")
                known[2:, np.searchsorted(words, x)] += np.frombuffer(y.as_py(), dtype="<i8").reshape(4, -1)
            put_table(f"{path}/known-{shard}", words, *known)
            yield batch(**{c: longs([int(x)]) for c, x in zip(COUNTS.replace(" long", "").split(", "), [*pairs, *counts], strict=True)})

    return task


COUNTS = "p1 long, p2 long, p3 long, p4 long, pairs long, n1 long, n2 long, n3 long, n4 long"


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; kept inside their bounds where counts are few."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(min(max(x, 0.05), k - 0.05)) for k, x in enumerate(d, 1))


@dataclass
class Model:
    path: str
    shards: int
    heavy: np.ndarray
    tokens: int
    words: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_counts: tuple[int, int, int]


def put_table(path: str, keys: np.ndarray, *values: np.ndarray) -> None:
    """Sorted keys and columns of counts in one file, counts in as few bytes as hold them all."""
    most = max((int(x.max(initial=0)) for x in values), default=0)
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    head = np.array([len(keys), width], dtype="<u8")
    put_file(path, b"".join([head.tobytes(), keys.astype("<u8").tobytes(), *[x.astype(f"<u{width}").tobytes() for x in values]]))


def _mapped(path: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys and columns of a file of put_table(), mapped into memory; None where there are none."""
    try:
        with open(path, "rb") as f:
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    except FileNotFoundError:
        return None
    n, width = np.frombuffer(m, "<u8", 2).tolist()
    return (np.frombuffer(m, "<u8", n, 16), np.frombuffer(m, f"<u{width}", -1, 16 + 8 * n).reshape(-1, n)) if n else None


def lookup(path: str, table: str, shards: int, keys: np.ndarray, columns: int) -> np.ndarray:
    """The columns of a table at sorted keys, a shard at a time; 0 where a key is missing."""
    out = np.zeros((columns, len(keys)), dtype=np.int64)
    at = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for x in np.flatnonzero(at[1:] > at[:-1]).tolist():
        found = _mapped(f"{path}/{table}-{x}")
        if found is not None:
            own = keys[at[x] : at[x + 1]]
            place = np.searchsorted(found[0], own).clip(max=len(found[0]) - 1)
            hit = np.flatnonzero(found[0][place] == own)
            out[:, at[x] + hit] = found[1][:, place[hit]]
    return out


def token_scores(m: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of the texts whose hashes are h its count in training and its log10 probability."""
    ok = h[1:] != BEGIN
    words, _, at = placed(h)
    count, before, total, *kinds = lookup(m.path, "known", m.shards, words, 6)
    d = np.array([0.0, *m.word_discounts])
    lower = np.where(before > 0, before - d[before.clip(max=3)], 0.0)
    spare = sum(x * y for x, y in zip(m.word_discounts, m.word_counts, strict=True))
    lower = (lower + spare / (m.words + 1)) / m.pairs if m.pairs else np.full(len(words), 1 / (m.words + 1))
    d = np.array([0.0, *m.pair_discounts])
    back = np.where(total > 0, sum(x * y for x, y in zip(kinds, d[1:], strict=True)) / np.maximum(total, 1), 1.0)
    first, second = h[:-1][ok], h[1:][ok]
    ia, ib = at[:-1][ok], at[1:][ok]
    u, _, inv = placed(pair_key(first, second, routes(first, second, m.heavy)))
    n = lookup(m.path, "pairs", m.shards, u, 1)[0][inv]
    direct = np.where(n > 0, (n - d[n.clip(max=3)]) / np.maximum(total[ia], 1), 0.0)
    return count[ib], np.log10(direct + back[ia] * lower[ib])


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """The model of all rows of docs (text). shards, a power of two of MOST_SHARDS at most, follows the size of the texts."""
    spark = docs.sparkSession
    texts = docs.select("text")
    if shards is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = min(MOST_SHARDS, 1 << max(4, (size // SHARD_BYTES).bit_length()))
    if not 1 <= shards <= MOST_SHARDS or shards & (shards - 1):
        raise ValueError(f"shards must be a power of two up to {MOST_SHARDS}")
    path = shared_path(spark, "kneser-ney")
    seen = to_shards(arrow_map(texts, _counted_words(shards), "shard long, block long, a binary, n binary"), shards)
    words = materialize(arrow_map(seen, _merged_words(path), "shard long, words long, tokens long, top binary, top_n binary", 64), "lm-words")
    types, total = words.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    heavy: list[int] = []
    for r in words.select("top", "top_n").toLocalIterator():  # 8 * HEAVY words a shard at most
        w, n = np.frombuffer(r.top, dtype="<u8"), np.frombuffer(r.top_n, dtype="<i8")
        heavy += w[n * HEAVY * shards > total].tolist()
    heavy = np.array(sorted(heavy), dtype=U64)
    seen = to_shards(arrow_map(texts, _counted_pairs(heavy, shards), PAIRS), shards)
    seconds = to_shards(arrow_map(seen, _merged_pairs(path, heavy, shards), MERGED, 64), shards)
    done = arrow_map(seconds, _merged_seconds(path), COUNTS, 64)
    s = done.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in done.columns]).first()
    return Model(path, shards, heavy, total, types, s.pairs, discounts(s.p1, s.p2, s.p3, s.p4), discounts(s.n1, s.n2, s.n3, s.n4), (s.n1, s.n2, types - s.n1 - s.n2))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _scored(model: Model, held: list[tuple]) -> pa.RecordBatch:
    docs, out, h, sizes = zip(*held, strict=True)
    sizes = np.concatenate(sizes)
    count, log = token_scores(model, np.concatenate(h))
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    score = np.add.reduceat(log, first)
    return batch(doc_id=pa.concat_arrays(docs), held_out=pa.concat_arrays(out), n_tokens=sizes, n_known=np.add.reduceat((count > 0).astype(np.int64), first), train_tokens=np.full(len(sizes), model.tokens, dtype=np.int64),
                 base_score=np.add.reduceat(base, first), score=score, perplexity=10 ** (-score / sizes))


def scored(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows that are not held out. Null and empty texts are one
    end token; repeated rows count and are scored each; a null doc_id is not
    held out; extra columns are ignored; an empty table gives an empty result;
    without training rows all words are unknown and equally likely.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")))

    def task(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            h, sizes = tokens(b["text"].to_pylist())
            held.append((b["doc_id"], b["held_out"], h, sizes))
            n += len(h)
            if n >= CHUNK_TOKENS:
                yield _scored(model, held)
                held, n = [], 0
        if held:
            yield _scored(model, held)

    return arrow_map(rows, task, SCORED)
