import json
import os

import pytest
from pyspark.sql import functions as F

from lodeseek import Index, KeywordField, Schema, TextField
from lodeseek.cli import main
from lodeseek.errors import AlreadyClosedError, CorruptIndexError, IndexAlreadyExistsError, IndexNotFoundError, SchemaError, SchemaMismatchError, WriterAlreadyOpenError
from lodeseek.plans.query import MatchAllQuery, TermQuery
from lodeseek.sources.files import Files
from lodeseek.sources.writer import FlushPolicy
from lodeseek.streaming import ingest

S = Schema({"id": KeywordField(stored=True), "body": TextField(stored=True), "note": TextField()})


@pytest.fixture
def index(spark, tmp_path):
    with Index.create(spark, str(tmp_path / "ix"), S) as i:
        yield i


def found(reader, q=None):
    return sorted(h.stored_fields["id"] for h in reader.search(q or MatchAllQuery(), 100).hits)


def once(reader, q=None):
    with reader:
        return found(reader, q)


def test_create_and_open(spark, tmp_path):
    path = str(tmp_path / "ix")
    with pytest.raises(IndexNotFoundError):
        Index.open(spark, path)
    Index.create(spark, path, S).close()
    with pytest.raises(IndexAlreadyExistsError):
        Index.create(spark, path, S)
    i = Index.open(spark, path, S)
    assert i.schema == S and i.manifest().commit_generation == 0 and found(i.open_reader()) == []
    with pytest.raises(SchemaMismatchError):
        Index.open(spark, path, Schema({"x": TextField()}))
    i.close()
    with pytest.raises(AlreadyClosedError):
        i.open_reader()
    with open(f"{path}/schema.json", "w") as f:
        f.write("{}")
    with pytest.raises(SchemaMismatchError):
        Index.open(spark, path)


def test_life_of_an_index(spark, index):
    with index.writer(flush_policy=FlushPolicy(max_documents=2)) as w:
        with pytest.raises(WriterAlreadyOpenError):
            index.writer()
        with pytest.raises(SchemaError):
            w.add_document(id=1)
        assert [w.add_document(id=str(i), body=f"kafka b{i}", note=f"n{i}") for i in (1, 2)] == [0, 1]
        assert w.buffered_document_count == 2 and w.buffered_posting_count == 8
        assert w.add_document(id="3", body="kafka") == 0 and w.segment_generations == (1,)
        assert once(index.open_reader()) == []
        near = w.refresh()
        assert found(near) == ["1", "2", "3"] and near.commit_generation is None and w.segment_generations == (1, 2)
        assert w.delete_by_term("id", "2") == 1 and w.delete_by_term("id", "2") == 0
        assert found(near) == ["1", "2", "3"]
        near.close()
        w.add_document(id="9", body="soon gone")
        assert w.delete_by_term("body", "soon") == 1 and w.flush() is None
        for bad in (("nope", "x"), ("id", "")):
            with pytest.raises(ValueError):
                w.delete_by_term(*bad)
        m = w.commit()
        assert m.commit_generation == 1 and m.segments == (1, 2) and m.tombstones == 1
        assert w.commit().commit_generation == 2
    with index.open_reader() as old:
        with index.writer() as w:
            assert w.update_document(field="id", term="1", id="1", body="new text") == 1
            with pytest.raises(SchemaError):
                w.update_document(field="id", term="3", oops="x")
            w.commit()
            with w.refresh() as r:
                before = [(h.score, h.stored_fields["id"]) for h in r.search(TermQuery("body", "kafka")).hits]
            for bad in ((1,), (1, 1), (1, 99)):
                with pytest.raises(ValueError):
                    w.merge(bad)
            made = w.merge([3, 1])
            assert made.generation == 4 and made.max_doc == 1 and w.segment_generations == (4, 2)
            with w.refresh() as r:
                assert [(h.score, h.stored_fields["id"]) for h in r.search(TermQuery("body", "kafka")).hits] == before
                assert found(r, TermQuery("note", "n1")) == []
            w.commit()
        assert found(old) == ["1", "3"]
        assert index.collect_garbage() and not index.files.exists("segments/seg_000003")
        assert index.files.exists("segments/seg_000001"), "a reader still has it"
    with index.open_reader() as r:
        assert found(r) == ["1", "3"] and found(r, TermQuery("body", "text")) == ["1"]


def test_merge_keeps_what_is_not_stored_and_order(spark, index):
    with index.writer() as w:
        for part in (("1", "2"), ("3",), ("4",)):
            for i in part:
                w.add_document(id=i, body="same", note=f"only{i}")
            w.flush()
        w.delete_by_term("id", "2")
        assert w.merge((2, 1)).max_doc == 2 and w.segment_generations == (4, 3)
        w.commit()
    with index.open_reader() as r:
        assert [h.stored_fields["id"] for h in r.search(MatchAllQuery()).hits] == ["4", "1", "3"]
        assert found(r, TermQuery("note", "only3")) == ["3"]


def test_bulk_add_is_dense_and_equal(spark, index):
    rows = spark.range(0, 50, 1, 5).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("word w"), F.col("id") % 7).alias("body"))
    with index.writer() as w:
        assert w.add_dataframe(rows).max_doc == 50 and w.add_dataframe(rows.limit(0)) is None
        with pytest.raises(SchemaError):
            w.add_dataframe(rows.withColumn("id", F.col("id").cast("int")))
        w.commit()
    with index.open_reader() as r:
        assert sorted(x[1] for x in r.documents.collect()) == list(range(50))
        assert [h.stored_fields["id"] for h in r.search(MatchAllQuery(), 50).hits] == [str(i) for i in range(50)]
        assert r.search(TermQuery("body", "w3")).total_hits == 7
        index.verify()
        plan = r.live_postings.where("field = 'body' and term = 'w3'")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(term,w3)" in plan and "EqualTo(field,body)" in plan


def test_closing_neither_flushes_nor_commits(spark, index):
    w = index.writer()
    w.add_document(id="1")
    w.close()
    w.close()
    with pytest.raises(AlreadyClosedError):
        w.add_document(id="2")
    assert found(index.open_reader()) == [] and index.writer().close() is None


def test_failures_leave_the_old_state(spark, index, monkeypatch):
    with index.writer() as w:
        w.add_document(id="1", body="kept")
        w.commit()

        def broken(self, a, b):
            raise OSError("no rename")

        with monkeypatch.context() as m:
            m.setattr(Files, "rename", broken)
            w.add_document(id="2", body="later")
            with pytest.raises(OSError):
                w.commit()
            assert w.buffered_document_count == 1 and not [n for n in index.files.names("segments") if "tmp" in n]
        assert found(index.open_reader()) == ["1"]
        w.commit()
    assert found(index.open_reader()) == ["1", "2"]


def test_damage_is_noticed(spark, index):
    with index.writer() as w:
        w.add_document(id="1", body="kept")
        w.commit()
    root = index.files.root.removeprefix("file:")
    about = f"{root}/segments/seg_000001/segment.json"
    told = json.load(open(about))
    name = next(f for f in told["files"] if f.startswith("stored"))
    path = f"{root}/segments/seg_000001/{name}"
    data = bytearray(open(path, "rb").read())
    data[10] ^= 1
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    os.path.exists(crc) and os.remove(crc)
    open(path, "wb").write(data)
    with pytest.raises(CorruptIndexError):
        index.open_reader()
    open(path, "wb").write(bytes(data) + b"x")
    with pytest.raises(CorruptIndexError):
        index.segments.describe(1, deep=False)
    os.remove(about)
    with pytest.raises(CorruptIndexError):
        index.open_reader()


def test_stream_batches_are_added_once(spark, index, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("1", "a b")], "id string, body string").write.parquet(src)
    stream = lambda: spark.readStream.schema("id string, body string").parquet(src)
    ingest.start(stream(), index, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("2", "b c")], "id string, body string").write.mode("append").parquet(src)
    ingest.start(stream(), index, str(tmp_path / "cp")).awaitTermination()
    assert index.manifest().segments == (1, 2) and found(index.open_reader(), TermQuery("body", "b")) == ["1", "2"]
    again = spark.createDataFrame([("2", "b c")], "id string, body string")
    assert not ingest.add_batch(index, again, index.manifest().batch)
    assert index.manifest().segments == (1, 2)
    with index.writer() as w:
        assert w.commit().batch == 1


def test_command_line(spark, tmp_path, capsys):
    def run(*args):
        status = main([str(a) for a in args], spark)
        out = capsys.readouterr()
        return status, (json.loads(out.out) if out.out else out.err)

    schema, ix = tmp_path / "s.json", tmp_path / "ix"
    schema.write_text(json.dumps({"fields": S.to_dict()}))
    assert run("create", ix, "--schema", schema) == (0, {"index": str(ix), "status": "created"})
    for i, text in (("1", "Kafka <log>"), ("2", "kafka kafka")):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": i, "body": text}))
    assert run("add", ix, tmp_path / "1.json") == (0, {"added": 1, "commit_generation": 1})
    assert run("add", ix, tmp_path / "2.json") == (0, {"added": 1, "commit_generation": 2})
    status, got = run("search", ix, "kafka", "--default-field", "body", "--highlight", "body", "--top-k", 1)
    assert status == 0 and got["total_hits"] == 2 and got["hits"][0]["stored_fields"] == {"id": "2", "body": "kafka kafka"} and got["hits"][0]["highlights"] == {"body": "<em>kafka</em> <em>kafka</em>"}
    assert set(got["hits"][0]) == {"score", "segment_generation", "local_doc_id", "stored_fields", "highlights"}
    assert run("delete", ix, "id", "1") == (0, {"deleted": 1, "commit_generation": 3})
    assert run("merge", ix, 1, 2) == (0, {"merged_segment_generation": 3, "commit_generation": 4})
    for bad in (("search", ix, "the", "--default-field", "body"), ("create", ix, "--schema", schema), ("merge", ix, 3), ("add", ix, schema), ("search", tmp_path / "no", "x", "--default-field", "body")):
        status, err = run(*bad)
        assert status == 2 and err.startswith("error: ")


def test_relevance_corpus(spark, tmp_path):
    """Five documents whose scores follow from the formula by hand."""
    s = Schema({"title": TextField(stored=True, boost=2.0), "body": TextField(stored=True), "id": KeywordField(stored=True)})
    docs = [("d1", "kafka log basics", "kafka"), ("d2", "search ranking", "term frequency counts")]
    with Index.create(spark, str(tmp_path / "r"), s) as i:
        with i.writer() as w:
            for d, t, b in docs:
                w.add_document(id=d, title=t, body=b)
            w.commit()
        with i.open_reader() as r:
            top = r.search_text("title:ranking OR body:frequency", "body")
            assert [h.stored_fields["id"] for h in top.hits] == ["d2"]
            import math

            idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
            want = 2.0 * (idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * (2 / 2.5)))) + idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * (3 / 2.0)))
            assert top.hits[0].score == pytest.approx(want, abs=1e-12)


def test_a_changed_tombstone_file_is_noticed(spark, index):
    with index.writer() as w:
        for i in "12":
            w.add_document(id=i, body="kept")
        w.flush()
        assert w.delete_by_term("id", "2") == 1
        w.commit()
    root = index.files.root.removeprefix("file:")
    folder = f"{root}/tombstones/gen_000001"
    name = next(n for n in os.listdir(folder) if n.startswith("part-"))
    data = bytearray(open(f"{folder}/{name}", "rb").read())
    data[6] ^= 1
    os.path.exists(f"{folder}/.{name}.crc") and os.remove(f"{folder}/.{name}.crc")
    open(f"{folder}/{name}", "wb").write(data)
    with pytest.raises(CorruptIndexError):
        index.open_reader()


def test_digests_in_blocks_are_those_of_whole_files(spark, index, monkeypatch):
    from lodeseek.sources import store

    with index.writer() as w:
        w.add_document(id="1", body="kept")
        w.commit()
    whole = store.digests(index.files, "segments/seg_000001")
    monkeypatch.setattr(store, "WHOLE_BYTES", 0)
    assert store.digests(index.files, "segments/seg_000001") == whole and len(whole) == 3


def test_a_stream_takes_its_own_lock_over_and_merges_small_segments(spark, index):
    rows = lambda i: spark.createDataFrame([(f"{i}", f"word w{i % 3}")], "id string, body string")
    w = index.writer(owner="stream a")
    w.close = lambda: None  # a driver that was killed
    for other in (None, "stream b"):
        with pytest.raises(WriterAlreadyOpenError):
            index.writer(owner=other)
    for batch in range(5):
        assert ingest.add_batch(index, rows(batch), batch, "stream a", fan=2)
    assert not ingest.add_batch(index, rows(4), 4, "stream a", fan=2)
    with index.open_reader() as r:
        assert found(r) == list("01234") and found(r, TermQuery("body", "w1")) == ["1", "4"]
    assert len(index.manifest().segments) == 2  # of 4 documents and of 1


def test_many_segments_are_one_scan(spark, index):
    with index.writer() as w:
        for i in range(4):
            w.add_document(id=str(i), body="same")
            w.flush()
        w.commit()
    with index.open_reader() as r:
        plan = r.all_postings._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Union" not in plan
        assert [(h.segment_generation, h.stored_fields["id"]) for h in r.search(TermQuery("body", "same")).hits] == [(i + 1, str(i)) for i in range(4)]
