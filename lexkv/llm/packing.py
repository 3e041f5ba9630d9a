"""Sum-of-squares online packing of tokenized documents into windows.

Each task packs its own rows. A document longer than a window fills whole
windows; the rest goes to the fill level that minimises the sum of squared
counts of partly filled windows. Windows left open, at the end or when many
are open, are completed by cutting pieces; what remains at the end is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lexkv.llm.common import U64, arrow_map, batch, placed, word_pieces

WINDOW = 2048
END_ID = 1
#: Open windows a task holds before it completes them by cutting.
MAX_OPEN = 2048
#: Parts of texts whose ids a Python worker remembers before it starts afresh.
WORDS_KEPT = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: ASCII letters, and marks (an apostrophe may join letters and is none).
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_MARK[0x21:0x7F] = True
_MARK[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("'")]] = False
#: Lower-case letters that stay as they are in the tokenizer's normal form and make one word.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))


def mark_cuts(b: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Where marks follow a letter up to white space; there the tokenizer cuts in any case."""
    m = _MARK[b]
    edges = np.flatnonzero(m[1:] != m[:-1]) + 1
    if m[0]:
        edges = edges[1:]
    start, end = edges[0::2], edges[1::2]
    return start[_LETTER[b[start - 1]] & space[end]]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker: its tasks share what it has learnt."""
    return WordTokens(path)


class WordTokens:
    """Token ids of texts, made of the ids of their parts, which the tokenizer never joins; known parts are found by hash.

    The tokenizer lowers letters itself, so A-Z are lowered first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(not t.special or t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens must be special ones that stand for themselves in the raw text")
        self.special = {t.content: np.array([k], dtype="<u4") for k, t in added.items()}
        self.between = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})")
        self.tokenizer.encode_special_tokens = True  # ids_of() takes special tokens out; what looks like one by now is plain text
        # a word of LETTERS alone goes to the tokenizer's model at once, if it takes them as one word
        pieces = [self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS]
        whole = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(LETTERS))
        self.letters = str.maketrans(dict(zip(LETTERS, pieces, strict=True)))
        self.word = re.compile(f"[{LETTERS}]+" if [x for x, _ in whole] == ["".join(pieces)] else "(?!)").fullmatch
        self.clear()

    def clear(self) -> None:
        #: Sorted hashes of parts; the place of each in `bounds`, between whose values its ids are.
        self.keys, self.place = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        self.bounds, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u4")

    def encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and how many each has."""
        tokenize, letters, word = self.tokenizer.model.tokenize, self.letters, self.word
        found = [[t.id for t in tokenize(x.translate(letters))] if word(x) else None for x in parts]
        rest = [k for k, x in enumerate(found) if x is None]
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            # one text of many words costs less than many texts; offsets tell whose a token is
            e = self.tokenizer.encode(" ".join([parts[k] for k in some]), add_special_tokens=False)
            begin = np.cumsum([0] + [len(parts[k]) + 1 for k in some])
            cut, ids = np.searchsorted(np.array([x for x, _ in e.offsets], dtype=np.int64), begin).tolist(), e.ids
            for k, x, y in zip(some, cut, cut[1:], strict=False):
                found[k] = ids[x:y]
        sizes = np.array(list(map(len, found)), dtype=np.int64)
        return np.fromiter((i for x in found for i in x), dtype="<u4", count=int(sizes.sum())), sizes

    def places(self, pieces: list[tuple]) -> np.ndarray:
        """The place in `bounds` of every word of word_pieces(); new words are learnt."""
        u, at, inverse = placed(np.concatenate([p[3] for p in pieces]))
        if len(self.keys) + len(u) > WORDS_KEPT:
            self.clear()
        spot = np.searchsorted(self.keys, u)
        new = self.keys[spot.clip(max=len(self.keys) - 1)] != u if len(self.keys) else np.ones(len(u), dtype=bool)
        if new.any():
            ends = np.cumsum([len(p[3]) for p in pieces])
            words = []
            for k in at[new].tolist():
                n = int(np.searchsorted(ends, k, side="right"))
                data, start, size, h, _ = pieces[n]
                k -= int(ends[n]) - len(h)
                words.append(data[start[k] : start[k] + size[k]].decode("utf-8", "replace"))
            ids, sizes = self.encoded(words)
            self.place = np.insert(self.place, spot[new], len(self.bounds) - 1 + np.arange(len(words)))
            self.keys = np.insert(self.keys, spot[new], u[new])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        return self.place[np.searchsorted(self.keys, u)][inverse]

    def plain(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts without special tokens."""
        pieces = list(word_pieces(texts, mark_cuts))
        if not pieces:
            return []
        place = self.places(pieces)
        size = self.bounds[place + 1] - self.bounds[place]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.bounds[place] - ends + size, size) + np.arange(size.sum())]
        words = np.cumsum(np.concatenate([p[4] for p in pieces]))
        return np.split(ids, np.r_[0, ends][words[:-1]])

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts, with the special tokens in them, which the tokenizer finds before it lowers letters."""
        cut = {k: self.between.split(t) for k, t in enumerate(texts) if t and any(x in t for x in self.special)}
        out = self.plain([None if k in cut else t for k, t in enumerate(texts)])
        for k, parts in cut.items():
            between = self.plain(parts[::2])
            out[k] = np.concatenate([x for pair in zip(between, [*map(self.special.get, parts[1::2]), between[0][:0]], strict=True) for x in pair])
        return out


class Packer:
    """Pieces are (doc, start, ids as bytes, doc_tokens); a window is a list of pieces."""

    def __init__(self, window: int = WINDOW, first_id: int = 0, max_open: int = MAX_OPEN):
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.out: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def level(self, size: int) -> int:
        """The level to place a piece at: 0 opens a window."""
        n, w = self.count, self.window
        if size == w:
            return 0
        best, gain = 0, 2 * n[size] + 1
        if n[w - size]:
            full = 1 - 2 * n[w - size]
            if full < gain:
                best, gain = w - size, full
        held = n[1 : w - size]
        if len(held):
            delta = np.where(held > 0, 2 * (n[1 + size : w] - held) + 2, np.iinfo(np.int64).max)
            k = int(delta.argmin())
            if held[k] and delta[k] < gain:
                best = k + 1
        return best

    def put(self, pieces: list, level: int) -> None:
        if level == self.window:
            self.close(pieces)
        elif level:
            self.open.setdefault(level, []).append(pieces)
            self.count[level] += 1
            self.n_open += 1

    def take(self, level: int) -> list:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        whole = len(ids) - len(ids) % step
        for k in range(0, whole, step):
            self.close([(doc, k // 4, ids[k : k + step], total)])
        if whole < len(ids):
            piece = (doc, whole // 4, ids[whole:], total)
            size = len(piece[2]) // 4
            at = self.level(size)
            pieces = self.take(at) if at else []
            pieces.append(piece)
            self.put(pieces, at + size)
            if self.n_open > self.max_open:
                self.complete()

    def complete(self) -> None:
        """Fill the fullest open windows with pieces cut from the emptiest; one at most stays open."""
        left = [(lv, p) for lv in sorted(self.open) for p in self.open[lv]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        lo, hi = 0, len(left) - 1
        while lo < hi:
            level, pieces = left[hi]
            while level < self.window and lo < hi:
                small, source = left[lo]
                while source and level < self.window:
                    doc, start, ids, total = source.pop()
                    n = min(self.window - level, len(ids) // 4)
                    pieces.append((doc, start, ids[: 4 * n], total))
                    if 4 * n < len(ids):
                        source.append((doc, start + n, ids[4 * n :], total))
                    level, small = level + n, small - n
                left[lo] = (small, source)
                lo += not source
            self.put(pieces, level)
            hi -= 1
        if lo == hi:
            self.put(left[lo][1], left[lo][0])

    def finish(self) -> None:
        self.complete()
        for level in list(self.open):
            while self.open[level]:
                pieces, rest = self.take(level)[::-1], level
                for bit in range(self.window.bit_length() - 1, -1, -1):
                    size, part = 1 << bit, []
                    if not rest & size:
                        continue
                    rest -= size
                    while size:
                        doc, start, ids, total = pieces.pop()
                        n = min(size, len(ids) // 4)
                        part.append((doc, start, ids[: 4 * n], total))
                        if 4 * n < len(ids):
                            pieces.append((doc, start + n, ids[4 * n :], total))
                        size -= n
                    self.close(part)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield batch(**{c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*self.out, strict=True), strict=True)})
            self.out = []


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer is the path of a tokenizers file, the same on all machines. A
    null or empty text is its end id alone; repeated rows are packed each; a
    null doc_id stays null; extra columns are ignored; an empty table gives an
    empty result. Sequence ids are unique: the task's number times 2^32 plus a
    count. Sequences hold window tokens or a power of two.
    """

    def task(batches):
        tokens = word_tokens(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for doc, ids in zip(b["doc_id"].to_pylist(), tokens.ids_of(b["text"].to_pylist()), strict=True):
                packer.add(doc, ids.tobytes() + end)
            yield from packer.rows()
        packer.finish()
        yield from packer.rows()

    return arrow_map(docs.select("doc_id", "text"), task, SCHEMA)
