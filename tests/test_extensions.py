import json

import pytest
from pyspark.sql import functions as F

from lodeseek import KeywordField, MemoryIndex, Schema, TextField
from lodeseek.errors import SchemaError
from lodeseek.functions import metrics
from lodeseek.functions.analysis import Analyzer, StandardTokenizer, python_column
from lodeseek.functions.bm25 import BM25, PythonSimilarity
from lodeseek.operators import inversion
from lodeseek.plans.query import BooleanClause, BooleanQuery, Occur, TermQuery
from lodeseek.sources import relevance

S = Schema({"id": KeywordField(stored=True), "title": TextField(stored=True, boost=2.0), "body": TextField(stored=True)})


def test_any_similarity_can_be_given(spark):
    class Plain:
        def term_score(self, tf, df, n, dl, avgdl):
            return tf * 100 + df * 10 + n + dl / 1000

    m = MemoryIndex(spark, Schema({"body": TextField()}))
    for t in ("a a b", "a", "c"):
        m.add_document(body=t)
    assert [h.score for h in m.snapshot().search(TermQuery("body", "a"), similarity=PythonSimilarity(Plain())).hits] == [223.003, 123.001]
    one = m.snapshot().search(TermQuery("body", "a"), similarity=BM25(2.0, 0.0)).hits
    assert [h.score for h in m.snapshot().search(TermQuery("body", "a"), similarity=PythonSimilarity(BM25(2.0, 0.0))).hits] == [h.score for h in one]


def test_stages_without_columns(spark):
    class Reverse:
        def apply(self, tokens):
            return [type(t)(t.term[::-1], t.position, t.start, t.end) for t in tokens]

    an = Analyzer(StandardTokenizer(), (Reverse(),))
    df = spark.createDataFrame([("ab cd",), (None,)], "t string")
    assert [r[0] and [tuple(x) for x in r[0]] for r in df.select(python_column(an, F.col("t"))).collect()] == [[("ba", 0, 0, 2), ("dc", 1, 3, 5)], None]


def test_inversion_exchanges_nothing(spark):
    d = inversion.with_all_fields(spark.range(100).select(F.lit(1).alias("segment"), F.col("id").alias("doc_id"), F.lit("a b a").alias("f_body")), S)
    df = inversion.postings(d, S)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and df.where("term = 'a'").first()["positions"] == [0, 2]


def test_relevance_corpus(spark, tmp_path):
    docs = [{"id": "d1", "title": "kafka log", "body": "leader and follower replicas"}, {"id": "d2", "title": "ranking", "body": "term frequency"}, {"id": "d3", "title": "other", "body": "kafka once"}]
    parts = {"documents": docs, "queries": [{"id": "q1", "text": "title:kafka OR kafka", "default_field": "body"}, {"id": "q2", "text": '"follower replicas"', "default_field": "body"}], "qrels": {"q1": {"d1": 2, "d3": 1}, "q2": {"d1": 1}}}
    paths = []
    for k, v in parts.items():
        paths.append(tmp_path / f"{k}.json")
        paths[-1].write_text(json.dumps({k: v}))
    corpus = relevance.load(*paths)
    m = MemoryIndex(spark, S)
    for d in corpus.documents:
        m.add_document(**d)
    for q in corpus.queries:
        ranked = [h.stored_fields["id"] for h in m.search_text(q.text, q.default_field).hits]
        assert metrics.ndcg_at_k(ranked, corpus.qrels[q.id], 10) == 1.0 and metrics.precision_at_k(ranked, {"d1"}, 1) == 1.0
    for k, bad in (("qrels", {"q1": {}}), ("qrels", {"q1": {"d9": 1}, "q2": {}}), ("qrels", {"q1": {"d1": True}, "q2": {}}), ("documents", [docs[0], docs[0]]), ("documents", [{"id": 1}])):
        (tmp_path / f"{k}.json").write_text(json.dumps({k: bad}))
        with pytest.raises(ValueError):
            relevance.load(*paths)
        (tmp_path / f"{k}.json").write_text(json.dumps({k: parts[k]}))


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "body": "x y"}, {"id": "2"}]))
    assert relevance.read_documents(spark, str(tmp_path / "a.json"), S).count() == 2
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1}]))
    with pytest.raises(SchemaError):
        relevance.read_documents(spark, str(tmp_path / "b.json"), S)


def test_repeated_clauses_in_a_batch(spark):
    m = MemoryIndex(spark, Schema({"body": TextField()}))
    for t in ("a b", "b", ""):
        m.add_document(body=t)
    twice = BooleanQuery((BooleanClause(Occur.SHOULD, TermQuery("body", "b")),) * 2)
    got = {(r.query_id, r.doc_id): r.score for r in m.snapshot().batch_top({"one": TermQuery("body", "b"), "two": twice, "none": BooleanQuery((BooleanClause(Occur.MUST_NOT, TermQuery("body", "b")),))}).collect()}
    assert set(got) == {("one", 0), ("one", 1), ("two", 0), ("two", 1)} and got["two", 1] == 2 * got["one", 1]
