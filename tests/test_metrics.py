import pytest

from lodeseek.functions import metrics as M


def test_single_rankings():
    ranked, good = ("d1", "d2", "d3"), {"d2", "d3", "d4"}
    assert M.precision_at_k(ranked, good, 2) == 0.5 and M.precision_at_k(ranked, good, 10) == 0.2 and M.precision_at_k(ranked, good, 0) == 0.0
    assert M.recall_at_k(ranked, good, 2) == pytest.approx(1 / 3) and M.recall_at_k(ranked, set(), 2) == 0.0
    assert M.mean_reciprocal_rank([ranked, ranked], [good, {"x"}]) == 0.25 and M.mean_reciprocal_rank([], []) == 0.0
    assert M.ndcg_at_k(("a", "b"), {"a": 3, "b": 1}, 10) == 1.0 and M.ndcg_at_k(("b", "a"), {"a": 3, "b": 1}, 10) < 1 and M.ndcg_at_k(("a",), {"a": 0}, 1) == 0.0


def test_single_rankings_are_checked():
    for call in (lambda: M.precision_at_k(("a",), set(), -1), lambda: M.recall_at_k(("a",), set(), True), lambda: M.precision_at_k(("a", "a"), set(), 1), lambda: M.mean_reciprocal_rank([("a",)], []), lambda: M.ndcg_at_k(("a",), {"a": -1}, 1), lambda: M.ndcg_at_k(("a",), {"a": True}, 1)):
        with pytest.raises(ValueError):
            call()


def test_frames_agree_with_single_rankings(spark):
    rankings = {"q1": ["d1", "d2", "d3"], "q2": ["d9"], "q3": []}
    grades = {"q1": {"d2": 1, "d3": 2, "d4": 3}, "q2": {"d1": 1}, "q3": {"d1": 0}}
    queries = spark.createDataFrame([(q,) for q in rankings], "query_id string")
    runs = spark.createDataFrame([(q, d, i) for q, r in rankings.items() for i, d in enumerate(r, 1)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([(q, d, g) for q, r in grades.items() for d, g in r.items()], "query_id string, doc_id string, grade int")
    good = {q: {d for d, g in r.items() if g > 0} for q, r in grades.items()}
    for k in (1, 2, 10):
        for frame, one in ((M.precision, lambda q: M.precision_at_k(rankings[q], good[q], k)), (M.recall, lambda q: M.recall_at_k(rankings[q], good[q], k)), (M.ndcg, lambda q: M.ndcg_at_k(rankings[q], grades[q], k))):
            got = {r[0]: r[1] for r in frame(queries, runs, rel, k).collect()}
            assert got == pytest.approx({q: one(q) for q in rankings})
    assert {r[0]: r[1] for r in M.reciprocal_rank(queries, runs, rel).collect()} == {"q1": 0.5, "q2": 0.0, "q3": 0.0}


def test_frames_reject_repeated_documents_and_bad_grades(spark):
    queries = spark.createDataFrame([("q",)], "query_id string")
    runs = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id long, rank int")
    good = spark.createDataFrame([("q", 1, 1.0)], "query_id string, doc_id long, grade double")
    for grade in (-1.0, float("inf"), float("nan")):
        bad = spark.createDataFrame([("q", 1, grade)], good.schema)
        with pytest.raises(Exception, match="finite"):
            M.ndcg(queries, runs, bad, 5).collect()
    with pytest.raises(Exception, match="twice"):
        M.precision(queries, runs.unionByName(runs), good, 5).collect()
    assert M.precision(queries, runs, good, 2).first().precision == 0.5
