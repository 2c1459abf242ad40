import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import minhash, substrings
from lodeseek.llm.common import Scratch
from lodeseek.llm.graph import components

NULLS = [(900, None), (901, ""), (902, " \n\t"), (903, "Just four words here"), (904, "just FOUR words here"), (905, "just  four words here\x0b"), (906, "just four words"), (909, "nul a\x00b c"), (910, "nul a b\x00c"), (911, "nul a b c"), (907, "É kept as it is"), (908, "é kept as it is")]


def plain_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_components(rows):
    sets = [(i, plain_shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
    return " ".join(words)


def corpus(seed=11):
    """Families whose copies lie on both sides of the threshold, a large one among them, and passages in common."""
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows, passage = [], text(60)
    for n, size in ((120, 90), (60, 12), (300, 12), (20, 12), (9, 8)):
        base = text(n)
        rows += [varied(rng, base, rng.randint(0, max(1, n // 12))) for _ in range(size)]
    chain = text(80)
    for _ in range(15):
        rows.append(chain)
        chain = varied(rng, chain, 2)
    rows += [f"{text(25)} {passage} {text(25)}" for _ in range(30)] + [text(50) for _ in range(40)] + [rows[0]] * 20
    rng.shuffle(rows)
    return list(enumerate(rows)) + NULLS


def test_near_duplicates_are_those_of_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_shingles int, rep string").repartition(5)
    got = minhash.near_duplicates(df, Scratch(spark, "t")).collect()
    want = plain_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty, Scratch(spark, "t")).count() == 0
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (7, "A b c d e f g"), (None, "a b c d e f g"), (8, None), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(3, 3, True), (3, 3, True), (7, 3, False), (8, 8, True), (None, None, None), (None, None, None)], key=str)


def test_entries_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.concatenate((a[: len(a) * 6 // 7], np.unique(rng.integers(0, 2**63, len(a) // 7).astype(np.uint64))))
    j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    shares = []
    for salt in range(60):
        e = minhash.entries([minhash.mixed(a ^ np.uint64(salt)), minhash.mixed(b ^ np.uint64(salt))])
        shares.append((e[0] == e[1]).mean())
    assert abs(np.mean(shares) - j**minhash.R) < 0.05


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def plain_cut(rows):
    """By a set of all windows seen so far, in order of (doc_id, start); each id has one text."""
    out, seen = {}, set()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(w)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def repetitive(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages, line = [text(n) for n in (99, 100, 101, 150, 400)], text(60)
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            parts += [rng.choice((p, p[a:], line)), text(rng.randint(0, 90))]
        rows.append((i, "".join(parts)))
    rows += [(200, "a" * 350), (201, "a" * 120), (202, "ab" * 200), (203, ""), (204, None), (205, "x" * 99), (206, rows[3][1]), (207, rows[3][1] + rows[4][1]), (208, rows[5][1] * 4), (None, rows[6][1])]
    return rows


def lines(seed):
    """Lines that many texts share with other surroundings, shorter and longer than a window; an all but equal pair."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (45, 62, 70, 84, 91, 150)]
    rows = [(300 + i, text(rng.randint(0, 90)) + shared[i % 6] + text(rng.randint(0, 90))) for i in range(120)]
    return rows + [(500, rows[5][1][:130] + "#" + rows[5][1][130:]), (501, rows[5][1][:99] + "\x00\x00" + rows[5][1][99:]), (502, "\x00" * 250), (503, "x" + "\x00" * 240)]


@pytest.mark.parametrize("many, hot, chunk", [(substrings.MANY, substrings.HOT, substrings.CHUNK), (2, 3, 150), (3, 1, 1 << 20)])
def test_cuts_are_those_of_brute_force(spark, monkeypatch, many, hot, chunk):
    import lodeseek.llm.substrings as module

    rows = repetitive(many) + lines(hot)
    df = spark.createDataFrame([(i, t, "clash", 2, f"{i}k") for i, t in rows], "doc_id long, text string, doc string, spans int, n_bytes string").repartition(4)
    fork_set(monkeypatch, module, MANY=many, HOT=hot, CHUNK=chunk)
    got = substrings.deduplicate(df, Scratch(spark, "t"), keep=("doc", "spans", "n_bytes")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == plain_cut(rows)
    for r in got:
        assert (r.kept_text.encode() == bytes(r.kept) or "�" not in r.kept_text) and r.doc == "clash" and r.spans == 2


def fork_set(monkeypatch, module, **values):
    """Here; the functions that go to workers are pickled by name, so tests of the streams below run them here too."""
    for k, v in values.items():
        monkeypatch.setattr(module, k, v)


def cut_here(rows, parts=3):
    """The operator's streams without Spark: parse, settle, contexts, compare."""
    import pyarrow as pa

    by_id = {(-(2**63) if i is None else i): (t or "").encode() for i, t in rows}
    lots = [sorted(by_id.items())[k::parts] for k in range(parts)]
    table = lambda batches: pa.Table.from_batches(batches)
    parsed = table([x for lot in lots for x in substrings.parse(iter([pa.RecordBatch.from_pydict({"doc": pa.array([d for d, _ in lot], pa.int64()), "base": pa.array([0] * len(lot), pa.int64()), "text": [t for _, t in lot]})]))]).to_pandas()
    parsed["split"] = (parsed["shape"] & 255) == substrings.SPLIT
    parsed = parsed.sort_values(["split", "key", "phrase", "doc", "place"]).drop(columns="split")
    batches = [pa.RecordBatch.from_pandas(parsed[k : k + 37], preserve_index=False) for k in range(0, len(parsed), 37)]
    first = table(list(substrings.settle(iter(batches)))).to_pandas()
    gone = [(d, a, e) for d, a, e in first[(first["shape"] & 255) == substrings.REMOVED][["doc", "place", "ends"]].itertuples(index=False)]
    near = first[(first["shape"] & 255) == substrings.PLAIN].copy()
    sides = {1: near["ends"].to_numpy().view(np.uint64) >> np.uint64(32), 4: near["ends"].to_numpy() & 0xFFFFFFFF}
    for bit, part in sides.items():
        n = near.assign(part=part).groupby(["key", "part"])["doc"].transform("size").to_numpy()
        near["shape"] |= np.where((part != 0) & (n > 1), np.where(n > substrings.HOT, 2, 1), 0) * bit
    near = near[(near["shape"] & 255) > 0]
    bodies = []
    for doc, found in near.groupby("doc"):
        rows_ = [tuple(x) for x in found[["key", "place", "shape", "ends"]].itertuples(index=False)]
        kind = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int64()), ("shape", pa.int32()), ("ends", pa.int64())]))
        bodies.append(pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([0]), pa.array([by_id[doc]]), pa.array([[dict(zip(("key", "place", "shape", "ends"), x, strict=True)) for x in rows_]], kind)], names=["doc", "base", "text", "found"]))
    made = table(list(substrings.contexts(iter(bodies)))).sort_by([("route", "ascending"), ("doc", "ascending"), ("place", "ascending")]) if bodies else None
    if made is not None:
        gone += [x for b in substrings.compare(iter(made.to_batches(max_chunksize=11))) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    out = {}
    for i, t in rows:
        own, data = -(2**63) if i is None else i, (t or "").encode()
        mask = bytearray(len(data))
        for d, a, e in gone:
            if d == own:
                mask[a:e] = b"\x01" * (e - a)
        spans = sum(g and not (k and mask[k - 1]) for k, g in enumerate(mask))
        out[i] = (len(data), sum(mask), spans, bytes(b for b, g in zip(data, mask, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_streams_are_brute_force_however_they_split(monkeypatch, seed):
    rows = repetitive(seed) + lines(seed)
    fork_set(monkeypatch, substrings, MANY=(2, 3, 32)[seed % 3], HOT=(1, 4, 512)[seed // 2], GROUP_ROWS=(7, 500)[seed % 2], CHUNK=(128, 1 << 20)[seed % 2])
    assert cut_here(rows, 1 + seed % 4) == plain_cut(rows)


def test_cut_of_nothing_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert substrings.deduplicate(spark.createDataFrame([], schema), Scratch(spark, "t")).count() == 0
    text = hashlib.sha256(b"1").hexdigest() * 3
    rows = [(1, text[:150]), (1, text[:150]), (2, text[:130]), (2, text[:130])]
    got = substrings.deduplicate(spark.createDataFrame(rows, schema), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == sorted((i, n) for i, n in [(1, plain_cut([(1, text[:150])])[1][1])] * 2 + [(2, 130)] * 2)


def test_rows_without_an_id_of_their_own_are_documents_of_their_own(spark):
    """Nothing is cut from a row because of another's spans; what two such rows share stays in exactly one of them."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    alone, shared, twice = text(600), text(200), text(150)
    rows = [(None, alone), (None, twice + text(50) + twice), (None, shared + "1"), (None, "2" + shared), (7, text(300)), (7, shared + text(10)), (7, text(40) + twice), (8, shared), (8, shared)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Scratch(spark, "t"), keep=("text",)).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == 9 and by[None, alone].n_removed == 0 and by[rows[4]].n_removed == 0
    assert by[rows[1]].n_removed == 150 and sorted((by[rows[2]].n_removed, by[rows[3]].n_removed)) == [0, 200]
    assert (by[rows[5]].n_removed, by[rows[6]].n_removed, by[rows[7]].n_removed) == (200, 150, 200)


def test_phrases_cover_each_window_once_and_by_content():
    rng = random.Random(7)
    for data in (bytes(rng.choices(b"ab", k=700)), bytes(rng.choices(range(256), k=2000)), b"z" * 400):
        key, phrase, at, shape, ends = substrings.phrases(data)
        starts = [s for p, x in zip(at, shape, strict=True) for s in range(p - (x >> 16), p - (x >> 8 & 255) + 1)]
        assert starts == list(range(len(data) - 99))
        shifted = substrings.phrases(b"front" + data)
        assert set(phrase.tolist()[1:]) <= set(shifted[1].tolist())


def test_long_documents_are_parsed_in_chunks(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choices(b"abc ", k=9000))
    whole = substrings.phrases(data)
    monkeypatch.setattr(substrings, "CHUNK", 1000)
    cut = substrings.phrases(data)
    windows = lambda x: sorted(s for p, y in zip(x[2], x[3], strict=True) for s in range(p - (y >> 16), p - (y >> 8 & 255) + 1))
    assert windows(whole) == windows(cut) and set(whole[2].tolist()) == set(cut[2].tolist())


def edge_document(n=3000):
    """Over 1 MiB, with 100 bytes that repeat around the first chunk's end; and a short document that has them first."""
    rng = np.random.default_rng(20)
    letters = lambda k: rng.integers(97, 123, k, dtype=np.uint8).tobytes()
    first, long = letters(2000), bytearray(letters(substrings.CHUNK + n))
    for k, at in enumerate(range(substrings.CHUNK - 490, substrings.CHUNK + 480, 120)):
        long[at : at + 100] = first[200 * k : 200 * k + 100]
    return first, bytes(long)


def test_windows_at_the_edge_of_a_real_chunk():
    _, data = edge_document()
    assert len(data) > 1 << 20
    key, phrase, at, shape, ends = substrings.phrases(data)
    before, after = shape >> 16, shape >> 8 & 255
    assert (before >= after).all() and before.max() <= substrings.LENGTH - substrings.GRAM
    assert np.array_equal(np.concatenate([np.arange(p - b, p - a + 1) for p, b, a in zip(at, before, after, strict=True)]), np.arange(len(data) - 99))
    near = data[substrings.CHUNK - 700 :]  # the same place without an edge: the same trigger in each window
    trigger = lambda x, shift: {s + shift: (k, p + shift) for k, p, y in zip(x[0].tolist(), x[2].tolist(), x[3].tolist(), strict=True) for s in range(p - (y >> 16), p - (y >> 8 & 255) + 1)}
    whole, part = trigger((key, phrase, at, shape), 0), trigger(substrings.phrases(near), substrings.CHUNK - 700)
    assert all(whole[s] == got for s, got in part.items())


def test_repeats_across_the_edge_of_a_real_chunk_are_cut(spark):
    first, data = edge_document()
    rows = [(1, first.decode()), (2, data.decode())]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    want = plain_cut(rows)
    assert want[2][2] == 9
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_near_duplicates_of_long_texts_and_extra_columns(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    near = list(words)
    for _ in range(2000):
        near[rng.randrange(len(near))] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[60_000:])), (4, "a\x00b c"), (5, "a b\x00c")]
    df = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in rows], "doc_id long, text string, set_key string, component_id string, rep int")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5} and {i: c for i, (_, c) in plain_components(rows).items()} == got
