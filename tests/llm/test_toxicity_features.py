"""Features of many texts at once against a plain reading of each text."""

import random

import numpy as np

from lexkv.llm import toxicity as T

ENTRIES = {"idiot": (7.0, 0), "scum": (5.0, 1), "ñandú": (6.5, 2), "idio*": (6.0, 0), "idiot*": (6.0, 1), "scumb*": (4.0, 1), "trasht*": (3.5, 0)}


def plain(text):
    words = T.WORD.findall(text.lower())
    n = max(len(words), 1)
    lex = [(w, *ENTRIES[w]) for w in words if w in ENTRIES]
    pre = [(w, *max(p)) for w in words if (p := [ENTRIES[w[:k] + "*"] for k in T.PREFIXES if len(w) > k and w[:k] + "*" in ENTRIES])]
    n_word, n_pre, kinds, pre_kinds = len(lex), len(pre), len({x[0] for x in lex}), len({x[0] for x in pre})
    upper = sum("A" <= c <= "Z" for c in text) / max(len(text), 1)
    group, pre_group = [x[2] for x in lex], [x[2] for x in pre]
    votes = [0 in group, 1 in group, 2 in group, pre_group.count(0) > 1, pre_group.count(1) > 1, kinds > 1, pre_kinds > 2, (n_word + n_pre) / n > 0.01, not n_word, n_pre < 2, (n_word + n_pre) / n < 0.002, upper > 0.4]
    x = [np.log1p(n_word), np.log1p(n_pre), np.log1p(kinds), np.log1p(pre_kinds), np.log1p(sum(x[1] > 6 for x in lex)), n_word > 0, n_word > 1, n_pre > 1, pre_kinds > 2, 100 * n_word / n, 100 * n_pre / n]
    x += [sum(x[1] for x in lex) / (5 + n_word), sum(x[1] for x in pre) / (5 + n_pre), np.log1p(n)]
    return [float(v) for v in x], sum(1 << k for k, v in enumerate(votes) if v)


def test_features_equal_a_plain_reading(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 200)
    r = random.Random(4)
    words = ["idiot", "IDIOTIC", "idiots", "idio", "scum", "Scumbag", "scumb", "ñandú", "ÑANDÚ", "trashtalk", "İstanbul", "x2y", "a_b", "²", "٣", "the", "end", "don't", "\ud800", "中文", "z" * 450]
    texts = ["", " ", "idiot", *(r.choice(["", " ", "\n"]).join(r.choice(words) + r.choice([" ", ", ", "-", ""]) for _ in range(r.randrange(120))) for _ in range(300))]
    lexicon = T.Lexicon(ENTRIES)
    x, votes = lexicon.features(texts)
    for k, t in enumerate(texts):
        want, bits = plain(t)
        assert np.allclose(x[k], want, rtol=1e-12), (t, x[k], want)
        assert votes[k] == bits, t
    assert T.Lexicon({}).features(texts[:3])[1].tolist() == [plain("")[1]] * 3
    assert lexicon.features([])[0].shape == (0, T.FEATURES)
