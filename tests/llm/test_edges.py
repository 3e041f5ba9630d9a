"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexkv.llm import jaccard_join, kneser_ney, lattice, mixing, packing, phrases, pii, suffix_dedup, toxicity, warc
from lexkv.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, cid long, rid long, _rid long, copy int, cum long, held_out string"
LONG = " ".join(f"w{k % 9973} and" for k in range(60_000))
PROSE = "one sentence of plain words that goes on for a while about nothing in particular, write to a.b@example.org or +1 202 555 0100"
#: doc_id, text, source; rows 7 repeat, the sixth and the one without id tie in text.
ROWS = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "word", None), (5, LONG, "b"), (6, PROSE, "b"), (None, PROSE, "a"), (7, "four words are here", None), (7, "four words are here", None), (8, "Ünïcode 𝒳 é́   end", "c"), (9, "x" * 5000, "c")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    rows = [(i, t, None, s, None if t is None else len(t), 77, 7.5, 1, 2, k, 3, 4, "clash") for k, (i, t, s) in enumerate(ROWS)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (5, 0, 0), (6, None, 0), (None, 1, 1), (4, 0, None), (3, 1, 9)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "empty.parquet")
    docs.limit(0).write.parquet(path)
    return spark.read.parquet(path)


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


def every(rows):
    return ids(rows) == sorted((i is None, i or 0) for i, _, _ in ROWS)


def test_jaccard(docs, empty):
    got = jaccard_join.jaccard_join(docs).collect()
    assert every(got)
    by = {(r.doc_id, r.kept): r for r in got}
    assert by[6, True].n_links == 1 and by[None, False].class_id == 6 and by[1, True].n_links == by[2, True].n_links == by[3, True].n_links == 0
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True] and all(r.n_links == 1 and r.class_id == 7 for r in got if r.doc_id == 7)
    out = jaccard_join.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS) - 2
    assert all(r["_rid"] is not None and r.cid == 1 for r in out.collect())
    assert jaccard_join.jaccard_join(empty).count() == jaccard_join.deduplicated(empty).count() == 0


def test_language_model(docs, empty):
    got = kneser_ney.scored(docs).collect()
    assert every(got) and all(np.isfinite(r.score) and r.score < 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[1].score == by[2].score and by[5].n_tokens == 120_001
    assert by[None].held_out is False and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    assert kneser_ney.scored(empty).count() == 0
    only = docs.filter("crc32(cast(doc_id as string)) % 5 = 1")
    assert all(np.isfinite(r.score) and r.n_known == r.train_tokens == 0 for r in kneser_ney.scored(only).collect())


def test_warc(spark, tmp_path):
    page = "<p>" + "same payload " * 20
    rows = [(1, "http://a/ b\r\nc", page), (2, None, page), (2, None, page), (None, "u", page), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9 + "é"), (8, "u", "y" * 3_000_000)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, rid int").write.parquet(f"{tmp_path}/p")
    got = warc.archive_round_trip(spark.read.parquet(f"{tmp_path}/p")).collect()
    want = sorted((p is None, p or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in rows)
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got) == want
    assert sorted((str(r.page_id), r.refers_to) for r in got if r.record_type == "revisit") == [("2", 1), ("2", 1), ("None", 1)]
    assert warc.archive_round_trip(spark.read.parquet(f"{tmp_path}/p").filter("page_id > 99")).count() == 0


def test_pii(docs, empty):
    got = pii.detected(docs).collect()
    by = {r.doc_id: r for r in got}
    assert every(got) and by[6].spans == by[None].spans and by[6].n_email == by[6].n_phone == 1 and by[1].spans == by[2].spans == ""
    assert by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = pii.masked(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()}[1] is None
    assert {r.doc_id: r.text for r in out.collect()}[6].endswith("write to [EMAIL] or [PHONE]") and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert pii.detected(empty).count() == pii.masked(empty).count() == 0


@pytest.mark.parametrize("text", ["a@b@c.de @x.y a.@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.0002.3.255", "4111 1111 1111 1111 1 4111-1111-1111-1111", "+1 (202) 555-0100+44 20 7946 0958 +123", "0" * 50_000, "." * 9000 + "@" * 900, "1." * 20_000, "+" * 9000 + "1- " * 9000])
def test_pii_spans_equal_plain_patterns(text):
    plain = [
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    short = text[:400]  # the plain patterns take quadratic time
    assert pii.base_spans(short) == sorted((m.start(), k, m.end()) for k, p, ok in plain for m in re.finditer(p, short) if ok(m[0]))
    pii.spans(text)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path()).toPandas()
    want = sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in ROWS)
    assert got.length.sum() == sum(want) and sorted(got[got.start == 0].doc_tokens) == want and got.doc_id.isna().any()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        n = s.length.sum()
        assert (s.offset.to_numpy() == np.r_[0, s.length.cumsum()[:-1]]).all() and (n == 2048 or n & (n - 1) == 0)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_words_are_tokenized_as_whole_texts():
    from tokenizers import Tokenizer

    t, tokens, r = Tokenizer.from_file(tokenizer_path()), packing.WordTokens(tokenizer_path()), np.random.RandomState(5)
    alphabet = list("abzAZ019 \t\n\r\x0b\x0c.,;:!?'\"-_()[]/@#$%&*+=<>~`^|\\") + [" ", "́", "é", "ß", "İ", "ﬁ", "中", "あ", "한", "𝒳", "😀", "​", " ", "’", "…", "\x1c", "\x85", "\x7f", "\x00", "don't", "ing", " the", "[unk]"]
    texts = ["".join(alphabet[k] for k in r.randint(0, len(alphabet), r.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(packing.LETTERS[k] for k in r.randint(0, len(packing.LETTERS), r.randint(0, 90))) for _ in range(1000)]
    for k in (*range(0, 300), *range(300, len(texts), 100)):
        some = texts[k : k + 1 + 99 * (k >= 300)] + [None, ""]
        for text, ids in zip(some, tokens.ids_of(some), strict=True):
            assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_fingerprints(docs, empty):
    got = phrases.fingerprinted(docs).collect()
    by = {r.doc_id: r for r in got}
    assert every(got) and by[1].fingerprint == by[2].fingerprint != by[4].fingerprint and by[6].fingerprint == by[None].fingerprint
    assert (by[1].n_chars, by[1].near_edited) == (0, 1.0) and by[5].n_chars == len(LONG) and all(0 <= r.near_next <= 1 for r in got)
    assert sum(r.near_next == 1 for r in got if r.doc_id == 7) == 1
    assert phrases.fingerprinted(empty).count() == 0
    assert phrases.fingerprinted(docs.filter("doc_id = 6")).first().near_next == 1


def test_toxicity(docs, labels, empty):
    got = toxicity.scored(docs, labels).collect()
    assert every(got) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert every(toxicity.scored(docs, labels.limit(0)).collect()) and toxicity.scored(empty, labels).count() == 0
    out = toxicity.accepted(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(r.predicted == 0 for r in got) and toxicity.accepted(empty, labels).count() == 0


def test_suffixes(docs, empty):
    got = suffix_dedup.removed(docs, texts=True).collect()
    assert every(got)
    data = [(i, (t or "").encode()) for i, t, _ in ROWS]
    seen = {}
    for _, b in data:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    want = []
    for i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((i is None, i or 0, len(b), int(gone.sum()), bytes(np.frombuffer(b, dtype=np.uint8)[~gone])))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == sorted(want)
    assert suffix_dedup.removed(empty).count() == 0


def test_lattice(spark, tmp_path):
    v = [float(k % 7 + 1) for k in range(32)]
    rows = [(1, v, 0), (2, [2 * x for x in v], 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0] * 32, 0), (8, [float("nan"), *v[1:]], 0), (9, [float("inf"), *v[1:]], 0), (10, [None, *v[1:]], 0), (11, v[:16], 0), (None, [-x for x in v], 0)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid int, rid string").write.parquet(f"{tmp_path}/v")
    table = spark.read.parquet(f"{tmp_path}/v")
    got = lattice.near_duplicates(table).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got if r.n_links) == [("1", 2, 1, True), ("2", 2, 1, False), ("2", 2, 1, False)]
    assert len(got) == len(rows) and all(r.kept and r.component_id == r.vec_id for r in got if not r.n_links)
    assert lattice.near_duplicates(table.filter("vec_id > 99")).count() == 0


def test_mixing(docs, empty):
    report = mixing.mix_report(docs).collect()
    assert every(report) and all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in report)
    assert sum(r.target for r in {(r.source_size, r.target): r for r in report}.values()) == pytest.approx(1.5 * sum(r.size for r in report))
    mix = mixing.mixed(docs).collect()
    assert sum(r.taken for r in mix) == sum(r.taken for r in report) and [r.virtual_finish for r in mix] == sorted(r.virtual_finish for r in mix)
    out = mixing.mixed_documents(docs)
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == len(mix)
    assert sum(len(r.text.split()) for r in rows if r.doc_id == 5) == sum(r.taken for r in mix if r.doc_id == 5)
    assert all((r["size"], r.target, r.copy, r.cum, r.n_chars) == (77, 7.5, 3, 4, len(r.text)) for r in rows)
    assert mixing.mix_report(empty).count() == mixing.mixed_documents(empty).count() == 0
    least = docs.select("doc_id", "text", "source")
    assert mixing.mixed_documents(least).columns == least.columns and mixing.mixed_documents(least).count() == len(mix)


def test_toxicity_sample_is_the_first_by_hash(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"))
    plain = rows.filter("doc_id is not null").orderBy(F.xxhash64("doc_id")).limit(300)
    got = toxicity.sampled(rows, 300, 5000)
    assert got.count() == 300 and {r.doc_id for r in got.collect()} == {r.doc_id for r in plain.collect()}


@pytest.fixture
def resplit(spark, tmp_path):
    """A table of eight files, and a call after which a new scan of it has one split instead of eight."""
    texts = [" ".join(f"t{k // 2} w{j}" for j in range(60)) for k in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.repartition(8, "doc_id").write.parquet(f"{tmp_path}/docs")
    yield spark.read.parquet(f"{tmp_path}/docs"), lambda: spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.unset("spark.sql.files.minPartitionNum")


def test_jaccard_does_not_depend_on_splits(resplit):
    docs, change = resplit
    out = jaccard_join.deduplicated(docs)
    change()
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 80, 2))


def test_jaccard_texts_do_not_depend_on_splits(resplit, monkeypatch):
    docs, change = resplit
    components = jaccard_join.lsh.components
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit(" end"))).otherwise(F.col("text")))
    monkeypatch.setattr(jaccard_join.lsh, "components", lambda *a: (change(), components(*a))[1])
    assert [(r.n_links, r.class_id) for r in jaccard_join.jaccard_join(edited).orderBy("doc_id").collect()] == [(1, k - k % 2) for k in range(80)]


def test_suffixes_do_not_depend_on_splits(resplit):
    docs, change = resplit
    out = suffix_dedup.removed(docs)
    change()
    assert all(r.n_removed == r.n_bytes for r in out.collect())


def test_special_tokens_are_found_in_raw_texts(spark, monkeypatch):
    from tokenizers import Tokenizer

    t, tokens, r = Tokenizer.from_file(tokenizer_path()), packing.WordTokens(tokenizer_path()), np.random.RandomState(6)
    special = ["<|startoftext|>", "<|endoftext|>"]
    parts = [*special, *special, *map(str.upper, special), "<|EndOfText|>", "<|endofte\u212at|>", "<|endoftext", "|>", "<|", "<", "'", "'s", "a", "Z", "9", " ", "\n", ".", ",", "é", "\u0301", "\u0130", "中"]
    texts = ["one two <|endoftext|> three", "<|ENDOFTEXT|>y", *("".join(parts[k] for k in r.randint(0, len(parts), r.randint(1, 12))) for _ in range(4000))]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for k in range(0, len(texts), 50):
        for text, got, ids in zip(texts[k : k + 50], tokens.ids_of(texts[k : k + 50]), want[k : k + 50], strict=True):
            assert got.tolist() == ids, repr(text)
    monkeypatch.setattr(packing, "WORDS_KEPT", 1)
    assert tokens.ids_of(texts[:1])[0].tolist() == want[0] and len(tokens.keys) == 3
    monkeypatch.undo()
    got = packing.pack(spark.createDataFrame(list(enumerate(texts[:200])), "doc_id long, text string"), tokenizer_path()).collect()
    assert {x.doc_id: x.doc_tokens for x in got} == {k: len(ids) + 1 for k, ids in enumerate(want[:200])}
    whole = [x for x in got if x.length == x.doc_tokens]
    assert len(whole) > 100 and all(x.ids_crc32 == zlib.crc32(np.array([*want[x.doc_id], 1], dtype="<u4").tobytes()) for x in whole)


@pytest.mark.parametrize("iban", ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "DE89 3704 0044 0532 0130 00", "NL91ABNA0417164300"])
@pytest.mark.parametrize("before", ["", "x ", "AB12 3456 7890 "])
@pytest.mark.parametrize("after", ["", " today", " EUR 50", " IBAN", " 2024", " EUROS 7 A", " IBAN BANK 12", ", BIC", " 4444 333 22 1"])
def test_ibans_before_capitals_and_digits(iban, before, after):
    at = len(before)
    assert pii.added_spans(before + iban + after) == [(at, 4, at + len(iban))]
    assert pii.masked_text(before + iban + after) == f"{before}[IBAN]{after}"


def test_wrong_ibans_and_long_runs():
    assert pii.added_spans("ES9221000418450200051332 EUR 50 xES9121000418450200051332") == []
    two = "ES9121000418450200051332 AT611904300234573201"
    assert pii.added_spans(two) == [(0, 4, 24), (25, 4, len(two))]
    pii.added_spans("AB12 " * 20_000 + "A" * 50_000)
