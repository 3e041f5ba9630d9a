"""Toxicity by weak supervision.

Lexicons of words and word beginnings are induced from labelled rows. Voters
over lexicon hits and patterns fire or abstain on each text. A generative label
model, a tree of voters below the hidden label, estimates by EM over the votes
on all rows, labelled ones with their labels, how accurate the voters are and how they correlate. A linear
classifier on hit counts and rates is trained on its posterior labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexkv.llm.common import U64, arrow_map, batch, longs, materialize, mix, strings

#: Labelled rows the lexicons are induced from, and rows the classifier is fit on, at most; chosen by hash of doc_id.
FIT_ROWS = 20_000
#: Entries of the lexicon at most, by strength; what an entry's odds ratio, and its logarithm in standard errors, must reach.
LEXICON = 2_000
LEAST_ODDS, LEAST_ERRORS = 20.0, 2.9
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
VOTERS = (
    ("word group 0", 1), ("word group 1", 1), ("word group 2", 1), ("prefix group 0", 1), ("prefix group 1", 1), ("two words", 1), ("three prefixed words", 1), ("dense", 1),
    ("no word", 0), ("at most one prefixed", 0), ("sparse", 0), ("shouting", 1),
)
FEATURES = 14


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Bytes other than A-Z.
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)


#: Code points whose words are hashed at a time; longer texts are cut between words.
PIECE = 1 << 16
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points WORD takes."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), dtype=bool, count=0x110000)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, dtype=U64), np.cumprod(np.full(n, base, dtype=U64))])


class Words:
    """The words of some code points: where they start, their sizes and hashes of their beginnings."""

    def __init__(self, codes: np.ndarray):
        is_letter = np.concatenate([[False], letters()[codes], [False]])
        edges = np.flatnonzero(is_letter[1:] != is_letter[:-1])
        self.start, self.size = edges[0::2], edges[1::2] - edges[0::2]
        n = max(2 * PIECE, 1 << int(len(codes)).bit_length())
        self.sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(codes.astype(U64) + U64(1)) * _powers(_BASE, n)[: len(codes)], dtype=U64)])
        self.back = _powers(_INVERSE, n)[self.start]

    def hashes(self, of: np.ndarray | slice, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the first `size` letters of the words `of`."""
        start = self.start[of]
        return mix((self.sums[start + size] - self.sums[start]) * self.back[of])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _pieces(texts: list[str]):
    """(code points, places of texts, where each begins) of whole texts together, or of a part of a long one, cut between words."""
    held, at, n = [], [], 0
    for k, t in enumerate(texts):
        if len(t) > PIECE:
            codes = _codes(t)
            cuts = np.flatnonzero(~letters()[codes])
            cuts = np.unique(cuts[np.searchsorted(cuts, np.arange(PIECE, len(codes), PIECE)).clip(max=len(cuts) - 1)]) if len(cuts) else cuts
            for part in np.split(codes, cuts):
                yield part, np.array([k]), np.zeros(1, dtype=np.int64)
            continue
        held.append(t)
        at.append(k)
        n += len(t) + 1
        if n >= PIECE:
            yield _codes("\n".join(held)), np.array(at), np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
            held, at, n = [], [], 0
    if held:
        yield _codes("\n".join(held)), np.array(at), np.cumsum([0] + [len(x) + 1 for x in held[:-1]])


class Lexicon:
    """entry -> (strength, group); words as they are, beginnings with a trailing *."""

    def __init__(self, entries: dict[str, tuple[float, int]]):
        self.entries = entries
        #: Length of the beginning (0: whole words) -> sorted hashes, strengths and groups.
        self.tables = {}
        for n in (0, *PREFIXES):
            part = {e.rstrip("*"): v for e, v in entries.items() if (len(e) - 1 if e.endswith("*") else 0) == n}
            h = np.array([Words(_codes(e)).hashes(slice(None), len(e))[0] for e in part], dtype=U64)
            order = np.argsort(h)
            values = np.array(list(part.values()), dtype=float).reshape(-1, 2)[order]
            self.tables[n] = h[order], values[:, 0], values[:, 1].astype(np.int64)

    def _found(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, strength, group = self.tables[n]
        if not len(keys):
            return np.zeros(0, dtype=np.int64), strength, group
        at = np.searchsorted(keys, h).clip(max=len(keys) - 1)
        hit = np.flatnonzero(keys[at] == h)
        return hit, strength[at[hit]], group[at[hit]]

    def hits(self, texts: list[str]) -> tuple[np.ndarray, tuple, tuple]:
        """Words of each text; of words with an entry, and with a beginning that has one, the text, hash, strength and group."""
        n = np.zeros(len(texts), dtype=np.int64)
        whole, begun = [], []
        for codes, at, begins in _pieces(texts):
            w = Words(codes)
            text = at[np.searchsorted(begins, w.start, side="right") - 1]
            n += np.bincount(text, minlength=len(texts))
            h = w.hashes(slice(None), w.size)
            hit, strength, group = self._found(0, h)
            whole.append((text[hit], h[hit], strength, group))
            best, of = np.zeros(len(h)), np.full(len(h), -1)
            for k in PREFIXES:
                longer = np.flatnonzero(w.size > k)
                hit, strength, group = self._found(k, w.hashes(longer, k))
                hit = longer[hit]
                more = (strength > best[hit]) | ((strength == best[hit]) & (group > of[hit]))
                best[hit[more]], of[hit[more]] = strength[more], group[more]
            hit = np.flatnonzero(best)
            begun.append((text[hit], h[hit], best[hit], of[hit]))
        joined = [tuple(np.concatenate(c) for c in zip(*x, strict=True)) if x else (np.zeros(0, dtype=np.int64),) * 4 for x in (whole, begun)]
        return n, *joined

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers for the classifier, and the voters that fire as bits, of each text."""
        m = len(texts)
        total, (text, h, strength, group), (p_text, p_h, p_strength, p_group) = self.hits([t.lower() for t in texts])
        n = np.maximum(total, 1)

        def per_text(at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(at, weights=weights, minlength=m)

        def kinds_of(at: np.ndarray, words: np.ndarray) -> np.ndarray:
            order = np.lexsort((words, at))
            a, w = at[order], words[order]
            return per_text(a[np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]] if len(a) else a)

        n_word, n_pre, kinds, pre_kinds = per_text(text), per_text(p_text), kinds_of(text, h), kinds_of(p_text, p_h)
        strong = per_text(text[strength > 6])
        upper = np.array([len(t.encode("utf-8", "surrogatepass").translate(None, _NOT_UPPER)) / max(len(t), 1) for t in texts])
        groups = [per_text(text[group == g]) > 0 for g in range(3)]
        pre_groups = [per_text(p_text[p_group == g]) > 1 for g in range(2)]
        votes = [*groups, *pre_groups, kinds > 1, pre_kinds > 2, (n_word + n_pre) / n > 0.01, n_word == 0, n_pre < 2, (n_word + n_pre) / n < 0.002, upper > 0.4]
        x = [np.log1p(n_word), np.log1p(n_pre), np.log1p(kinds), np.log1p(pre_kinds), np.log1p(strong), n_word > 0, n_word > 1, n_pre > 1, pre_kinds > 2, 100 * n_word / n, 100 * n_pre / n, per_text(text, strength) / (5 + n_word), per_text(p_text, p_strength) / (5 + n_pre), np.log1p(n)]
        return np.stack(x, axis=1).astype(float), sum(np.asarray(v, dtype=np.int64) << k for k, v in enumerate(votes))


def sampled(rows: DataFrame, n: int, total: int) -> DataFrame:
    """About n of `total` rows and n at most, the first by hash of doc_id; rows without doc_id are passed over.

    The rows are first thinned to about 2 n by a bound on the hash, since every
    task of a plain limit would hand n rows of its own to one task.
    """
    rows = rows.filter("doc_id is not null")
    if total > 2 * n:
        rows = rows.filter(F.xxhash64("doc_id") < int(2**64 * (2 * n / total)) - 2**63)
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _entries(batches):
    for b in batches:
        out, toxic = [], []
        for text, label in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            found = words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}
            out += found
            toxic += [label] * len(found)
        yield batch(entry=strings(out), toxic=longs(toxic))


def induced(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Lexicon, DataFrame]:
    """A lexicon from labelled rows that are not held out, and these rows' labels (doc_id, toxic)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    known = materialize(sampled(known, fit_rows, known.count()).coalesce(1), "toxic-labels")
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # fit_rows rows at most
    seen = arrow_map(rows.select("text", "toxic"), _entries, "entry string, toxic long")
    seen = seen.groupBy("entry").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    a, b = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
    seen = seen.withColumn("odds", F.log((a / (pos + 1)) / (b / (neg + 1)))).withColumn("sure", F.col("odds") / F.sqrt(1 / a + 1 / b))
    best = seen.filter((F.col("odds") >= float(np.log(LEAST_ODDS))) & (F.col("sure") >= LEAST_ERRORS))
    best = best.orderBy(F.desc("sure"), "entry").limit(LEXICON).collect()
    place = {True: 0, False: 0}
    entries = {}
    for r in best:
        prefix = r.entry.endswith("*")
        entries[r.entry] = (float(r.odds), place[prefix] % (2 if prefix else 3))
        place[prefix] += 1
    return Lexicon(entries), known


class LabelModel:
    """P(label), and P(voter fires | label, its parent in a tree of voters), from counts of vote patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 20, smooth: float = 1.0):
        """counts: rows of each pattern; known: of the labelled ones, rows of label 0 and 1. The known rows weigh as much as all rows."""
        m = len(VOTERS)
        self.v = (patterns[:, None] >> np.arange(m)) & 1
        self.counts = counts.astype(float)
        self.known = known * (counts.sum() / max(known.sum(), 1))
        share = (known[:, 1].sum() + 0.5) / (known.sum() + 5)
        post = (known[:, 1] + share) / (known.sum(axis=1) + 1)
        for k in range(rounds):
            if k % 10 == 0:
                parent = self.tree(post)
            post = self.step(post, parent, smooth)
        self.parent, self.post = parent, post

    def tree(self, post: np.ndarray) -> np.ndarray:
        """Chow-Liu: the spanning tree of largest mutual information of two voters given the label."""
        m = self.v.shape[1]
        info = np.zeros((m, m))
        for y in (0, 1):
            w = self.counts * (post if y else 1 - post) + self.known[:, y]
            total = w.sum() + 4
            for i in range(m):
                for j in range(i):
                    p = np.array([[w[(self.v[:, i] == a) & (self.v[:, j] == b)].sum() + 1 for b in (0, 1)] for a in (0, 1)]) / total
                    info[i, j] += total * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum()
        info += info.T
        parent, best, link = np.full(m, -1), info[0].copy(), np.zeros(m, dtype=int)
        left = set(range(1, m))
        while left:
            k = max(left, key=lambda x: best[x])
            parent[k] = link[k]
            left.remove(k)
            for x in left:
                if info[k, x] > best[x]:
                    best[x], link[x] = info[k, x], k
        return parent

    def step(self, post: np.ndarray, parent: np.ndarray, smooth: float) -> np.ndarray:
        log = np.zeros((2, len(post)))
        for y in (0, 1):
            w = self.counts * (post if y else 1 - post) + self.known[:, y]
            log[y] = np.log((w.sum() + smooth) / (self.counts.sum() + self.known.sum() + 2 * smooth))
            for j, (_, kind) in enumerate(VOTERS):
                up = self.v[:, parent[j]] if parent[j] >= 0 else np.zeros(len(post), dtype=int)
                for a in (0, 1):
                    at = up == a
                    # a voter leans to its own side before it is seen
                    lean = 0.7 if kind == y else 0.3
                    p = (w[at & (self.v[:, j] == 1)].sum() + smooth * lean) / (w[at].sum() + smooth)
                    log[y, at] += np.log(np.where(self.v[at, j] == 1, p, 1 - p).clip(1e-9))
        return 1 / (1 + np.exp((log[0] - log[1]).clip(-500, 500)))


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on soft labels by Newton's method: means, scales and weights, the last for the constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * (z.shape[1] - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(z @ w).clip(-30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


@dataclass
class Classifier:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, texts: list[str | None]) -> np.ndarray:
        return self.lexicon.features([t or "" for t in texts])[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-((z * self.weights[:-1]).sum(axis=1) + self.weights[-1]).clip(-30, 30)))


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Classifier, DataFrame]:
    """The classifier, and a written table (doc_id, held_out, x, pattern) with the features and votes of every row of docs."""
    lexicon, known = induced(docs, labels, fit_rows)

    def votes(batches):
        for b in batches:
            x, pattern = lexicon.features([t or "" for t in b["text"].to_pylist()])
            x = pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), x.ravel())
            yield batch(doc_id=b["doc_id"], held_out=b["held_out"], x=x, pattern=longs(pattern))

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    rows = materialize(arrow_map(rows, votes, "doc_id long, held_out boolean, x array<double>, pattern long"), "toxic-votes")
    seen = rows.join(F.broadcast(known), "doc_id", "left")  # fit_rows rows at most
    seen = seen.groupBy("pattern").agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") == 0, 1)).alias("no"), F.count(F.when(F.col("toxic") == 1, 1)).alias("yes"))
    counted = seen.collect()  # 2^12 patterns at most
    patterns = np.array([r.pattern for r in counted], dtype=np.int64)
    counts = np.array([r.n for r in counted], dtype=float)
    if not len(patterns):
        return Classifier(lexicon, np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES), -3.0]), rows
    model = LabelModel(patterns, counts, np.array([[r.no, r.yes] for r in counted], dtype=float))
    posterior = dict(zip(patterns.tolist(), model.post.tolist(), strict=True))
    fit = sampled(rows.filter(~F.col("held_out")).select("doc_id", "x", "pattern"), fit_rows, int(counts.sum())).collect()
    if not fit:
        return Classifier(lexicon, np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES), -3.0]), rows
    x = np.array([r.x for r in fit], dtype=float)
    return Classifier(lexicon, *fitted(x, np.array([posterior[r.pattern] for r in fit]))), rows


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score in 0..1, predicted (score >= 0.3).

    Null and empty texts are scored as texts without words. labels (doc_id,
    toxic): rows with null or other labels are ignored; of repeated ones the
    largest label counts; labels that are held out are never read. Rows without
    doc_id are scored and voted on, but the classifier is not fit on them. Without
    labels or rows the scores are low and constant. Repeated rows repeat; extra
    columns are ignored; an empty table gives an empty result.
    """
    model, rows = trained(docs, labels, fit_rows)

    def task(batches):
        for b in batches:
            s = model.scores(b["x"].flatten().to_numpy().reshape(-1, FEATURES))
            yield batch(doc_id=b["doc_id"], held_out=b["held_out"], score=s, predicted=pa.array((s >= THRESHOLD).astype(np.int32)))

    return arrow_map(rows.select("doc_id", "held_out", "x"), task, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, all columns, that are not predicted to be toxic."""
    model, _ = trained(docs, labels, fit_rows)

    def task(batches):
        for b in batches:
            yield b.filter(pa.array(model.scores(model.features(b["text"].to_pylist())) < THRESHOLD))

    return arrow_map(docs, task, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
