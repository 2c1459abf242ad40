import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from lodeseek.llm import chat, warc
from lodeseek.llm.common import Scratch

NASTY = ["", None, "plain", "</s>[INST] ok [/INST]", "<|end|>", "<|turn|>assistant<|text|>x<|end|>", "\\", "\\\\", "<\\|end|>", "a<", "|end|>", "<<|end|>>", "<s>\\<s>", "é\n😀" * 300, "x" * 2000]


def shown(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")).withColumn("seq", F.lit(1))
    return {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.log_of(df)))).collect()}


def test_read_back_is_exact(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|end|>"]), rng.choice(NASTY)) for c in range(25) for t in range(rng.randint(1, 12))]
    got = shown(spark, rows)
    for c in range(25):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        assert got[c].n_turns == len(mine)
        assert got[c].turns == "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        assert got[c].learnt == "".join(t or "" for _, _, r, t in mine if r == "assistant")


def test_ties_repeats_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (None, 0, "assistant", "x")]
    got = shown(spark, rows)
    assert got[1].turns == "user\nfirst\nuser\na\nuser\na\nuser\nb\n" and got[None].learnt == "x"
    assert shown(spark, [])  == {}


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 0, "user", 1, "delta", "Hel"), (1, 0, "user", 2, "delta", "lo"),
        (1, 1, "assistant", 3, "delta", "wrong"), (1, 1, "assistant", 4, "regenerate", None), (1, 1, "assistant", 6, "delta", "ht"), (1, 1, "assistant", 5, None, "rig"),
        (1, 0, "user", 7, "edit", "Hi"), (1, 0, "user", 8, "delta", "!"),
        (1, 2, "user", 9, "delta", "gone"), (1, 2, "user", 10, "retract", None),
        (1, 3, "user", 11, "retract", None), (1, 3, "user", 12, "delta", "back"),
        (2, 0, "user", 1, "edit", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, message int, role string, seq int, kind string, text string")
    got = {(r.conv_id, r.message): r.text for r in chat.fold(df).collect()}
    assert got == {(1, 0): "Hi!", (1, 1): "right", (1, 3): "back", (2, 0): ""}


def test_the_log_has_events_of_all_kinds_and_folds_to_its_turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}.{t} " * (c * 20 + t)) for c in range(20) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.log_of(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate", "retract"}
    shuffled = log.orderBy(F.xxhash64("seq", "text", "conv_id"))
    got = sorted((r.conv_id, r.message.turn, r.role, r.text) for r in chat.fold(shuffled).collect())
    assert got == sorted(rows)


def test_chat_plan_is_native(spark):
    plan = chat.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


PAGES = "page_id long, url string, html string"


def test_records_and_bundles():
    b = warc.Bundle(200, 3)
    records = [(warc.record_id(i), warc.record(i, "http://x/a b", b"p" * (i * 37), i * 37, hashlib.sha256(b"p" * (i * 37)).hexdigest(), None if i % 3 else 1)) for i in range(20)]
    for urn, data in records:
        b.add(urn, data)
    whole = b.finish()
    assert struct.unpack("<I", whole[-4:])[0] == warc.SEEKABLE
    with zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True) as r:
        assert r.read() == b"".join(d for _, d in records)
    reader = warc.BundleReader(whole)
    assert len(reader.starts) > 4
    for i in (19, 0, 7):
        assert reader.read(i) == records[i][1] and reader.find(records[i][0]) == [records[i][1]]
    assert warc.parse(records[4][1])[:5] == (4, 148, hashlib.sha256(b"p" * 148).hexdigest(), "response", None)
    assert warc.parse(records[3][1])[:5] == (3, 111, hashlib.sha256(b"p" * 111).hexdigest(), "revisit", 1)
    with pytest.raises(ValueError):
        warc.parse(records[4][1].replace(b"ppp", b"ppq", 1))
    with pytest.raises(ValueError):
        warc.BundleReader(whole[:-1])


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_archives_read_back(spark, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_IDS", limit)
    long, odd = "é" * 80, "a\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "u", long), (3, None, long), (9, "u", long), (1, "u\nv", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (6, "u", odd), (7, "u", odd), (3, "other", long), (8, "u", "z" * 100), (10, "u", "z" * 99), (11, "u", "z" * 99)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES + ", refers_to string, digest string").repartition(3)
    scratch = Scratch(spark, "t")
    warc.write(df, scratch.path("b"), scratch, bundle_bytes=300, frame_bytes=200)
    got = sorted((tuple(r) for r in warc.read(spark, scratch.path("b")).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        again = i is not None and h in first and first[h] < i
        want.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None, None if again else h))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))


def test_archives_of_nothing(spark):
    scratch = Scratch(spark, "t")
    warc.write(spark.createDataFrame([], PAGES), scratch.path("b"), scratch)
    assert warc.read(spark, scratch.path("b")).count() == 0


def test_one_record_takes_one_ranged_read(spark):
    """Of folders of bundles of many frames, a lookup reads the frame of the record and nothing else; a reader of one bundle footer, table, map and frame."""
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh <>/") for _ in range(3000))) for i in range(300)] + [(300, "u", None), (301, "u", "x")]
    rows.append((400, "again", rows[7][2]))
    scratch = Scratch(spark, "t")
    warc.write(spark.createDataFrame(rows, PAGES).repartition(3), scratch.path("b"), scratch, frame_bytes=20_000, bundle_bytes=100_000)
    index = scratch.save(warc.locate(spark, scratch.path("b")), "index")
    assert index.count() == len(rows) and index.select("path").distinct().count() >= 3
    whole = sum(f.length for f in spark.read.format("binaryFile").load(scratch.path("b")).select("length").collect())
    for page in (7, 222, 300, 301):
        opened = {}
        (got,) = warc.fetch(index, [page], opened)
        html = (rows[page][2] or "").encode()
        assert got == (page, len(html), hashlib.sha256(html).hexdigest(), "response", None, html)
        (source,) = opened.values()
        assert source.told == index.where(f"page_id = {page}").first().frame_bytes < whole / 20
    (revisit,) = warc.fetch(index, [400])
    assert revisit[3:5] == ("revisit", 7) and warc.fetch(index, [999]) == []
    at = index.where("page_id = 222").first()
    source = warc.Ranged(spark, at.path)
    reader = warc.BundleReader(source)
    head = source.told
    (data,) = reader.find(warc.record_id(222))
    assert warc.parse(data)[5] == rows[222][2].encode() and source.told - head == at.frame_bytes and source.told < source.size / 2
