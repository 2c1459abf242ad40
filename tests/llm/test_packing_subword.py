import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeseek.llm import packing, subword

ODD = ["", None, " ", "a", "x <|endoftext|> y", "é́ 你好 😀\n\n\tz", "the " * 3000, "q" * 5000, "   lead", "trail   ", "▁ mark ▁▁"]


def docs(spark, texts=ODD):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start string")


def test_capacity_tree_finds_the_tightest():
    rng = random.Random(5)
    tree, plain = packing.CapacityTree(64), []
    for i in range(2000):
        if rng.random() < 0.5:
            c = rng.randint(1, 64)
            tree.push(c, i)
            plain.append(c)
        else:
            need = rng.randint(1, 64)
            got, fits = tree.pop_tightest(need), [c for c in plain if c >= need]
            assert (got[0] if got else None) == (min(fits) if fits else None)
            if got:
                plain.remove(got[0])


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(deadline=None, max_examples=60)
def test_best_fit_decreasing_fills_without_overlap(lengths):
    where, offset, opened = packing.best_fit_decreasing(lengths, 50)
    for w in range(opened):
        spans = sorted((o, o + n) for x, o, n in zip(where, offset, lengths, strict=True) if x == w)
        assert spans[0][0] == 0 and spans[-1][1] <= 50 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_pieces_hold_each_id_once(spark):
    window = 64
    rows = packing.pack(docs(spark).repartition(2), window=window, bin_tokens=2000).collect()
    slow = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(ODD):
        want = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(p.ids for p in pieces) == want.tobytes()
        assert [p.start for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces[:-1])])) and {p.doc_tokens for p in pieces} == {len(want)}
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces[:-1])])) and sum(p.length for p in pieces) <= window
    d = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(packing.pack(docs(spark))).collect()}
    assert d[0, 0] == zlib.crc32(np.array([1], "<u4").tobytes())


def test_padding_does_not_grow_with_partitions(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = (packing.pack(table.repartition(n)).select("doc_id", "start", "length", "sequence_id").collect() for n in (1, 60))
    windows = lambda rows: len({r.sequence_id for r in rows})
    assert sorted((r.doc_id, r.start, r.length) for r in few) == sorted((r.doc_id, r.start, r.length) for r in many)
    assert windows(many) == windows(few) < 1.02 * sum(r.length for r in many) / 2048 + 1


def test_packing_of_nothing(spark):
    assert packing.pack(docs(spark).limit(0)).count() == 0


def test_fast_ids_are_those_of_tokenizers():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    slow, fast = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abé ß'\n\t1 2你😀s.,!​") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def vocab():
    return subword.vocabulary(subword.model_path(None))


def texts_of(seed=1, n=400):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "a", "the", "é", "ß", "日", "本", "\t", "😀", "xxxxx", "Hello", "ing", "1", "23", ".", "ﬁ"]
    return [t or "" for t in ODD if "▁" not in (t or "")] + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n)]


def test_without_dropout_it_is_sentencepiece(vocab):
    sp = sentencepiece.SentencePieceProcessor(model_file=subword.model_path(None))
    texts = texts_of()
    assert [x.tolist() for x in subword.Encoder(vocab).encode(texts, [0] * len(texts))] == sp.encode(texts)


def test_rounds_and_agenda_agree_and_decode(vocab):
    texts = texts_of(2) + ["▁ mark ▁▁"]
    keys = list(range(len(texts)))
    a, b = (subword.Encoder(vocab, 0.4, long_unit=n).encode(texts, keys) for n in (48, 1))
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert [vocab.decode(x).decode() for x in a] == texts


def test_dropout_is_keyed(vocab):
    t = "segmentations of internationalization vary " * 20
    enc = lambda p, seed, doc: subword.Encoder(vocab, p).encode([t], [subword.document_key(seed, doc)])[0].tolist()
    assert enc(0.1, 1, 5) == enc(0.1, 1, 5) and len({tuple(enc(0.1, s, d)) for s, d in ((1, 5), (2, 5), (1, 6))}) == 3
    assert len(enc(0, 1, 5)) < len(enc(0.2, 1, 5)) < len(enc(1.0, 1, 5))


def test_encoding_and_decoding_frames(spark):
    d = docs(spark, ODD + ODD).withColumn("doc_id", F.col("doc_id") % len(ODD)).repartition(3)
    got = subword.decode(subword.encode(d, keep=(F.coalesce("text", F.lit("")).alias("kept"),)))
    rows = got.collect()
    assert len(rows) == 2 * len(ODD) and all(r.decoded.decode() == r.kept for r in rows)
    same = {}
    for r in rows:
        assert same.setdefault(r.doc_id, r.ids) == r.ids
    assert subword.decode(subword.encode(d.limit(0))).count() == 0
    assert subword.encode(spark.createDataFrame([(None, "x")], "doc_id long, text string")).count() == 1


def test_long_texts_are_encoded_in_stretches():
    rng = random.Random(12)
    text = "".join(rng.choice(["the ", "word", "é́", "你好", "\n\n", "q" * 70, " ", "😀", "abc"]) for _ in range(9000))
    v = subword.vocabulary(subword.model_path(None))
    for dropout in (0.0, 0.3):
        e = subword.Encoder(v, dropout)
        (whole,) = e.encode([text], [77])
        for stretch in (50, 3000, 10**6):
            assert np.array_equal(e.encode_long(text, 77, stretch), whole)
        assert len(e.encode_long("", 77)) == 0 and v.decode(whole) == text.encode()


def test_padding_is_little_at_the_real_window(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(df).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("s")).first()
    assert got.n > 0.99 * 2048 * got.s
