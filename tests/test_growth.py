"""Work that must not gather in one task, one batch or one plan as tables grow."""
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodeseek import Index, KeywordField, Schema, TextField
from lodeseek.functions import analysis
from lodeseek.operators import inversion
from lodeseek.plans.query import MatchAllQuery, TermQuery

S = Schema({"id": KeywordField(stored=True), "body": TextField(stored=True)})


def test_python_tokens_leave_before_all_texts_of_a_batch_are_analyzed(monkeypatch):
    monkeypatch.setattr(analysis, "PYTHON_CHARS", 10)
    monkeypatch.setattr(F, "pandas_udf", lambda f, kind: lambda text: f)
    seen = []

    class Tokenizer(analysis.StandardTokenizer):
        def tokenize(self, text):
            seen.append(text)
            return super().tokenize(text)

    run = analysis.python_column(analysis.Analyzer(Tokenizer()), None)
    made = run(iter([pd.Series(["one two", None, "three four", "five"]), pd.Series([], dtype=object), pd.Series(["six"])]))
    first = next(made)
    assert len(seen) == 2 and [x and [t[0] for t in x] for x in first] == [["one", "two"], None, ["three", "four"]]
    assert [[[t[0] for t in x] for x in part] for part in made] == [[["five"]], [["six"]]]


def test_postings_of_a_segment_are_not_exchanged(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    dealt = []
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, *a: dealt.append(a) or self)
    rows = spark.range(0, 20, 1, 4).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("word w"), F.col("id") % 3).alias("body"))
    with Index.create(spark, str(tmp_path / "ix"), S) as index, index.writer() as w:
        w.add_dataframe(rows)
        w.commit()
        index.verify()
        assert not dealt and index.open_reader().search(TermQuery("body", "w1")).total_hits == 7


def test_a_large_file_is_staged_in_short_ones(spark, tmp_path, monkeypatch):
    from lodeseek.sources import writer

    monkeypatch.setattr(writer, "STAGE_ROWS", 2)
    seen, read = [], inversion.dense_ids
    monkeypatch.setattr(inversion, "dense_ids", lambda df: seen.append(len(df.inputFiles())) or read(df))
    rows = spark.range(0, 20, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("word").alias("body"))
    with Index.create(spark, str(tmp_path / "ix"), S) as index, index.writer() as w:
        assert w.add_dataframe(rows).max_doc == 20 and seen[0] >= 10
        w.commit()
        with index.open_reader() as r:
            assert sorted(x[0] for x in r.documents.select("doc_id").collect()) == list(range(20))


def test_partitions_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(0, 20_000, 1, 1).write.parquet(path)
    few = inversion.spread(spark.read.parquet(path))
    assert few.rdd.getNumPartitions() == 4
    monkeypatch.setattr(inversion, "SPREAD_BYTES", 1 << 12)
    many = inversion.spread(spark.read.parquet(path))
    assert many.rdd.getNumPartitions() > 10 and many.count() == 20_000
    assert inversion.spread(spark.createDataFrame([(1,)], "a int")).rdd.getNumPartitions() == 4


def test_partitions_are_of_so_much_text_however_it_is_stored(spark, tmp_path, monkeypatch):
    from lodeseek.operators.snapshot import IndexSnapshot

    monkeypatch.setattr(inversion, "SPREAD_BYTES", 1 << 14)
    of = lambda df: [r[1] for r in df.groupBy(F.spark_partition_id()).agg(F.sum(F.length("body"))).collect()]
    path, text = str(tmp_path / "t"), F.lit("one text many times over " * 8).alias("body")
    spark.range(0, 2_000, 1, 1).select("id", text).write.parquet(path)  # 400 kB of texts, which Parquet stores once
    rows = spark.read.parquet(path)
    assert max(of(inversion.spread(rows))) <= 2 << 14 and inversion.spread(rows).count() == 2_000
    # enough partitions, of which one has nearly all
    uneven = spark.range(0, 100, 1, 100).select("id", F.lit("x").alias("body")).union(spark.range(100, 2_100, 1, 1).select("id", text))
    assert max(of(inversion.spread(uneven))) <= 2 << 14 and inversion.spread(uneven).count() == 2_100
    # and where most are empty
    hollow = rows.coalesce(1).union(spark.range(0, 0, 1, 100).select("id", text))
    assert max(of(inversion.spread(hollow))) <= 2 << 14
    # those that are small enough stay
    even = spark.range(0, 2_000, 1, 40).select("id", text)
    assert "RepartitionByExpression" not in inversion.spread(even)._jdf.queryExecution().optimizedPlan().toString() and inversion.spread(even) is even
    for made in (IndexSnapshot.of_documents(rows, Schema({"body": TextField()}), id_col="id"), IndexSnapshot.of_documents(rows.select("body"), Schema({"body": TextField()}))):
        assert made._made.rdd.getNumPartitions() > 20 and made.search(TermQuery("body", "many")).total_hits == 2_000


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """2,000 documents of two texts, which Parquet stores once each; kept in partitions of few of them."""
    d = str(tmp_path_factory.mktemp("repeated"))
    text = F.when(F.col("doc_id") % 2 == 0, "of that with and whist " * 8).otherwise("that by von " * 16)
    spark.range(0, 2_000, 1, 1).toDF("doc_id").select("doc_id", text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")).write.parquet(f"{d}/documents.parquet")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(inversion, "SPREAD_BYTES", 1 << 14)
        yield d


@pytest.mark.parametrize(("name", "rows"), [("bool_must", 1_000), ("bm25_custom_k1b", 2_000), ("bool_duplicate", 2_000), ("bool_must_not", 1_000), ("bool_must_should", 2_000), ("bool_nested", 2_000), ("bool_nested_by_joins", 2_000), ("bool_should", 2_000), ("bool_with_prefix", 1_000), ("collect_then_fetch", 10)])
def test_a_task_of_a_search_reads_so_much_text_however_it_is_stored(spark, repeated, name, rows):
    from lodeseek import queries

    frame = queries.QUERIES[name](spark, repeated)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert frame.count() == rows and "InMemoryTableScan" in plan and ("Scan parquet" in plan.split("InMemoryRelation")[0]) == (name == "collect_then_fetch")
    words = [r[1] for r in queries.documents(spark, repeated).norms.where("field = 'text'").groupBy(F.spark_partition_id()).agg(F.sum("length")).collect()]
    assert sum(words) == 1_000 * (40 + 48) and max(words) <= 8_000


def test_merge_renumbers_without_a_join_of_documents(spark, tmp_path):
    ids = lambda a, b: spark.range(a, b, 1, 3).select(F.col("id").cast("string").alias("id"), F.when((F.col("id") % 64).isin(0, 5, 63) | F.col("id").between(4090, 4200), "gone").otherwise("kept").alias("body"))
    with Index.create(spark, str(tmp_path / "ix"), S) as index, index.writer() as w:
        made = [w.add_dataframe(ids(0, 9000)).generation, w.add_dataframe(ids(9000, 9100)).generation]
        want = [r[0] for r in ids(0, 9100).where("body = 'kept'").collect()]
        assert w.delete_by_term("body", "gone") == 9100 - len(want)
        assert w.merge(made).max_doc == len(want)
        w.commit()
        index.verify()
        with index.open_reader() as r:
            assert [x[0] for x in r.documents.orderBy("doc_id").select("f_id").collect()] == want
            assert r.live_postings.where("field = 'id'").count() == len(want) and not r.live_postings.where("term = 'gone'").count()
            assert r.norms.where("field = 'body'").count() == len(want) == len(r.search(MatchAllQuery(), 10_000).hits)
        again = inversion.renumbered(None, {made[0]: 9000}, spark)
        plan = again(index.segments.open(made[0])["postings"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(segment" not in plan and "hashpartitioning(doc_id" not in plan


def test_an_index_lives_as_far_as_it_is_asked(spark):
    from lodeseek import queries

    d = "/root/testdata/sf0.001"
    queries._lives.clear()
    life = queries.stored_life(spark, d, "whole")
    assert "whole" in life and "without" not in life
    assert queries.QUERIES["lifecycle_counts"](spark, d).first()["live_docs"] == life["merged"].num_live_docs


def test_one_pass_makes_postings_and_norms(spark, monkeypatch):
    texts = [None, "", "the", " ,", "the cat\0the_2 Cat, THE cat", "ΟΔΟΣ ΟΔΟΣ, Σ İx 你好 É", "x" * 50 + " a b a", ". b a", "naïve ½ 3½ b"] * 3
    rows = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(texts)], "segment int, doc_id long, f_id string, f_body string").coalesce(1)
    for most in (1 << 22, 20):  # in one slice, in many
        monkeypatch.setattr(inversion, "SLICE_CHARS", most)
        made = inversion.inverted(rows, S)
        want, lengths = set(), set()
        for i, t in enumerate(texts):
            for name, an in (("id", analysis.KeywordAnalyzer()), ("body", analysis.StandardAnalyzer())):
                tokens = an.analyze(t or "")
                lengths.add((name, i, len(tokens)))
                for term in {x.term for x in tokens}:
                    places = tuple(x.position for x in tokens if x.term == term)
                    want.add((name, term, i, len(places), places if name == "body" else (), len(tokens)))
        got = inversion.postings_of(made).collect()
        assert {(r["field"], r["term"], r["doc_id"], r["tf"], tuple(r["positions"]) if r["field"] == "body" else (), r["dl"]) for r in got} == want and len(got) == len(want)
        norms = inversion.norms_of(made).collect()
        assert {(r["field"], r["doc_id"], r["length"]) for r in norms} == lengths and len(norms) == len(lengths)


def test_a_search_analyzes_texts_once_and_keeps_no_texts(spark):
    from lodeseek import queries

    d = "/root/testdata/sf0.001"
    queries._kept.clear()
    spark.catalog.clearCache()
    docs = queries.documents(spark, d)
    frame = queries.QUERIES["bool_must"](spark, d)
    frame.collect()
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs()
    assert kept.size() == 1 and "MapInArrow" in kept.values().toList().mkString()
    assert docs.num_live_docs == docs.documents.count()


def test_a_merge_without_dead_documents_adds_a_start_and_no_words(spark, tmp_path):
    rows = spark.range(0, 40, 1, 2).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("word w"), F.col("id") % 3).alias("body"))
    with Index.create(spark, str(tmp_path / "ix"), S) as index, index.writer() as w:
        made = [w.add_dataframe(rows.where(f"id % 2 = {i}")).generation for i in (1, 0)]
        plan = inversion.renumbered(None, {g: 20 for g in made}, spark)(index.segments.all(made)["postings"])._jdf.queryExecution().executedPlan().toString()
        assert "_words" not in plan and "regexp" not in plan
        assert w.merge(made).max_doc == 40
        w.commit()
        index.verify()
        with index.open_reader() as r:
            assert [x[0] for x in r.documents.orderBy("doc_id").select("f_id").collect()] == [str(i) for i in (*range(1, 40, 2), *range(0, 40, 2))]
            assert r.live_postings.where("field = 'id'").select("term", "doc_id").join(r.documents, "doc_id").where("term = f_id").count() == 40 == r.num_live_docs


def test_a_session_keeps_a_terms_postings_together(spark, monkeypatch):
    from lodeseek.operators.snapshot import IndexSnapshot

    unplaced = Schema({"id": KeywordField(stored=True), "body": TextField(stored=True), "bare": replace(TextField(stored=True), store_positions=False)})
    texts = [None, "", "the", "a b a c", "the cat\0the_2 Cat, THE cat", "ΟΔΟΣ ΟΔΟΣ, Σ İx 你好 É", "b a", "lone", "c c"] * 30
    rows = spark.createDataFrame([(i % 2, (i << 33) - 7, str(i), t, t) for i, t in enumerate(texts)], "segment int, doc_id long, f_id string, f_body string, f_bare string").coalesce(1)
    for most in (1 << 22, 20):
        monkeypatch.setattr(inversion, "SLICE_CHARS", most)
        for some in (rows.where("segment = 0"), rows, rows.where("f_id is null")):
            flat, made = inversion.inverted(some, unplaced), inversion.blocks(some, unplaced)
            for want, got in ((inversion.postings_of(flat), inversion.postings_in(made)), (inversion.norms_of(flat), inversion.norms_in(made))):
                assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.undo()
    docs = spark.range(0, 6000, 1, 1).select("id", F.concat(F.lit("x y z word"), F.col("id") % 7).alias("body"))
    index = IndexSnapshot.of_documents(docs, Schema({"body": TextField()}), id_col="id")
    assert index._made.where("term is not null").count() <= 10 * index._made.rdd.getNumPartitions() and index.live_postings.count() == 24_000
    # a term is looked for among blocks, before they are taken apart
    plan = index.live_postings.where("field = 'body' and term = 'x'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("= x)") < plan.index("MapInArrow")
