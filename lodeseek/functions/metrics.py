"""Relevance metrics: of one ranking in Python, and of many as DataFrames.

runs:  query_id, doc_id, rank (from 1).   qrels: query_id, doc_id, grade (0: not relevant).
Every query of ``queries`` (query_id) is counted, also one that found nothing. A run that
names a document twice, or a grade that isn't finite or is below 0, fails the job.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Mapping, Sequence
from collections.abc import Set as AbstractSet

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError("k must be an integer of 0 or more")


def _check_ranked(ranked: Sequence[Hashable]) -> None:
    if len(set(ranked)) < len(ranked):
        raise ValueError("a ranking names a document twice")


def precision_at_k(ranked: Sequence[Hashable], relevant: AbstractSet, k: int) -> float:
    _check_k(k)
    _check_ranked(ranked)
    return len(relevant.intersection(ranked[:k])) / k if k else 0.0


def recall_at_k(ranked: Sequence[Hashable], relevant: AbstractSet, k: int) -> float:
    _check_k(k)
    _check_ranked(ranked)
    return len(relevant.intersection(ranked[:k])) / len(relevant) if relevant else 0.0


def mean_reciprocal_rank(rankings: Sequence[Sequence[Hashable]], relevant: Sequence[AbstractSet]) -> float:
    if len(rankings) != len(relevant):
        raise ValueError("each ranking needs its relevant documents")
    total = 0.0
    for ranked, good in zip(rankings, relevant, strict=True):
        _check_ranked(ranked)
        hits = [i for i, d in enumerate(ranked, 1) if d in good]
        total += 1 / hits[0] if hits else 0.0
    return total / len(rankings) if rankings else 0.0


def _gain(grades: Sequence[float]) -> float:
    return sum((2.0**g - 1) / math.log2(i + 2) for i, g in enumerate(grades))


def ndcg_at_k(ranked: Sequence[Hashable], grades: Mapping[Hashable, float], k: int) -> float:
    _check_k(k)
    _check_ranked(ranked)
    for g in grades.values():
        if isinstance(g, bool) or not isinstance(g, (int, float)) or not math.isfinite(g) or g < 0:
            raise ValueError("grades must be finite numbers of 0 or more")
    best = _gain(sorted(map(float, grades.values()), reverse=True)[:k])
    return _gain([float(grades.get(d, 0)) for d in ranked[:k]]) / best if best else 0.0


def _graded(qrels: DataFrame) -> DataFrame:
    grade = F.col("grade").cast("double")
    good = grade.isNull() | ((grade >= 0) & (grade < float("inf")))
    return qrels.select("query_id", "doc_id", F.when(good, grade).otherwise(F.raise_error(F.lit("grades must be finite numbers of 0 or more")).cast("double")).alias("grade"))


def _once(runs: DataFrame) -> DataFrame:
    r = runs.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.count("*").alias("_n"))
    return r.select("query_id", "doc_id", F.when(F.col("_n") == 1, F.col("rank")).otherwise(F.raise_error(F.lit("a ranking names a document twice")).cast("int")).alias("rank"))


def _judged(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    runs = _once(runs)
    q = _graded(qrels).select(F.col("query_id").alias("_q"), F.col("doc_id").alias("_d"), "grade")
    return runs.join(q, (F.col("query_id") == F.col("_q")) & (F.col("doc_id") == F.col("_d")), "left").select("query_id", "rank", F.coalesce("grade", F.lit(0.0)).alias("grade"))


def _per_query(queries: DataFrame, found: DataFrame, value: str) -> DataFrame:
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce(value, F.lit(0.0)).alias(value))


def precision(queries: DataFrame, runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, precision."""
    _check_k(k)
    hits = F.count_if((F.col("rank") <= k) & (F.col("grade") > 0))
    return _per_query(queries, _judged(runs, qrels).groupBy("query_id").agg((hits / F.lit(float(max(k, 1)))).alias("precision")), "precision")


def recall(queries: DataFrame, runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, recall."""
    _check_k(k)
    hits = _judged(runs, qrels).groupBy("query_id").agg(F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias("hits"))
    good = qrels.where(F.col("grade") > 0).groupBy("query_id").agg(F.count("*").alias("good"))
    return _per_query(queries, hits.join(good, "query_id").select("query_id", (F.col("hits") / F.col("good").cast("double")).alias("recall")), "recall")


def reciprocal_rank(queries: DataFrame, runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, rr; their mean is the mean reciprocal rank."""
    first = F.min(F.when(F.col("grade") > 0, F.col("rank")))
    return _per_query(queries, _judged(runs, qrels).groupBy("query_id").agg((F.lit(1.0) / first).alias("rr")), "rr")


def ndcg(queries: DataFrame, runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg. Discounts come from a list made on the driver: the JVM's log2 differs in the last digits."""
    _check_k(k)
    if k == 0:
        return queries.select("query_id", F.lit(0.0).alias("ndcg"))
    discounts = F.array(*[F.lit(math.log2(i + 2)) for i in range(k)])
    gain = F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1.0) / F.get(discounts, F.col("rank").cast("int") - 1))
    got = _judged(runs, qrels).where(F.col("rank") <= k).groupBy("query_id").agg(gain.alias("got"))
    ideal = _graded(qrels).select("query_id", "grade").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade")))).where(F.col("rank") <= k)
    best = ideal.groupBy("query_id").agg(gain.alias("best")).where(F.col("best") > 0)
    return _per_query(queries, got.join(best, "query_id").select("query_id", (F.col("got") / F.col("best")).alias("ndcg")), "ndcg")
