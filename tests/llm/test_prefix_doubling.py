"""Prefix doubling against the query's method and against all strings."""

import random

from lexkv.llm import prefix_doubling, suffix_dedup


def table(spark, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("ab é") for _ in range(n))
    shared = [text(300), text(210), text(199), "z" * 500]
    rows = [(k, text(r.randrange(400)) + r.choice([*shared, ""]) + text(r.randrange(50)) + r.choice([*shared, ""]), "x") for k in range(60)]
    rows += [(None, rows[3][1], None), (3, rows[3][1], "x"), (61, None, "x"), (62, "", "x"), (63, "short", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, rid string")


def test_same_rows_as_by_samples(spark):
    docs = table(spark, 5)
    got, want = (sorted(map(str, m.removed(docs).collect())) for m in (prefix_doubling, suffix_dedup))
    assert got == want and any("n_removed=0" not in x for x in got)
    assert prefix_doubling.removed(docs.limit(0)).count() == 0


def test_all_strings_of_a_short_length(spark):
    data = ["abcabcabcxabc", "xyabcabcq", None, "abcabcab"]
    got = {r.doc_id: r.n_removed for r in prefix_doubling.removed(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string"), 8).collect()}
    seen = [t[k : k + 8] for t in data if t for k in range(len(t) - 7)]
    for d, t in enumerate(data):
        gone = {k + i for k in range(len(t or "") - 7) if seen.count(t[k : k + 8]) > 1 for i in range(8)}
        assert got[d] == len(gone)
