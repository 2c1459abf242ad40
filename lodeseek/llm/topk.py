"""Exact top-k by inner product: Fagin's threshold algorithm.

Each shard keeps one list a dimension, sorted by component. A query reads its
lists from the end that its own component favours, a deepening stretch at a
time; every row met is scored in full, and the search stops when the bound, what
a row not met yet could score at most, is below the k-th score so far. (At equality
it goes on: an unmet row might tie with a smaller id.) Nothing but the bound ends
a search; where it never falls, all rows are met. Lists of larger query components
are read deeper in proportion, for they hold most of the bound.

How much the bound saves depends on the data: vectors whose components are few, or of
unequal weight, are mostly never met; for vectors that point every way alike in 64
dimensions the bound is far above any true score until each row has been met in some
list. Figures of both are in the README and the tests.

Components become floor(scale * x) and scores are exact integers: in doubles
where products can't leave their 53 bits, else in Python's integers. A score that
no long can hold is given as the nearest long, and a component whose floor none can
hold counts as the nearest long too.

Nulls: vectors null, empty or holding null or non-finite components, and rows
without an id, take no part. Vectors meet only those of their own length. Of rows
with equal ids the least vector takes part. Fewer candidates than k: all of them. Ties
go to smaller ids. An empty table, or one without queries, gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import best_k, search, usable
from .common import table

FIRST_DEPTH = 32
GROWTH = 1.5


def threshold_search(q: np.ndarray, own: int, ids: np.ndarray, m: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row numbers, scores) of the k best, and how many rows were met. order: a row a dimension, of row numbers by component, ascending."""
    n, dims = len(ids), np.flatnonzero(q != 0)
    weight = np.abs(q[dims]).astype(float)
    weight /= weight.max(initial=1)
    up = q[dims] > 0
    met = ids == own
    met_rows = 0
    rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=m.dtype)
    before, depth = np.zeros(len(dims), np.int64), FIRST_DEPTH
    while True:
        now = np.minimum(n, np.maximum(1, np.ceil(depth * weight)).astype(np.int64))
        new = np.zeros(n, dtype=bool)
        for d, rising, a, e in zip(dims.tolist(), up.tolist(), before.tolist(), now.tolist(), strict=True):
            new[order[d, n - e : n - a] if rising else order[d, a:e]] = True
        if not len(dims) or (now == n).any():  # a list has been read to its end, or a zero query scores all alike
            new[:] = True
        new &= ~met
        met |= new
        found = np.flatnonzero(new)
        met_rows += len(found)
        rows, scores = np.concatenate((rows, found)), np.concatenate((scores, m[found] @ q))
        top = best_k(ids[rows], scores, k)
        rows, scores = rows[top], scores[top]
        if met.all():
            return rows, scores, met_rows
        last = m[np.where(up, order[dims, n - now], order[dims, now - 1]), dims]
        if len(rows) == k and scores[-1] > last @ q[dims]:
            return rows, scores, met_rows
        before, depth = now, depth * GROWTH


def lists(k: int):
    """One shard's sorted lists, and the search that reads them."""

    def index(ids: np.ndarray, m: np.ndarray):
        whole = np.vectorize(int, otypes=[object])
        order = np.ascontiguousarray(np.argsort(m, axis=0, kind="stable").T.astype(np.int32))
        largest = np.abs(m).max(initial=0)

        def run(query_ids: np.ndarray, queries: np.ndarray):
            exact = max(largest, np.abs(queries).max(initial=0)) ** 2 * m.shape[1] < 2**52
            mine, theirs = (m, queries) if exact else (whole(m), whole(queries))
            out = ([], [], [])
            for own, q in zip(query_ids.tolist(), theirs, strict=True):
                rows, scores, _ = threshold_search(q, own, ids, mine, order, k)
                for x, y in zip(out, ([own] * len(rows), ids[rows].tolist(), [max(-(2**63), min(int(s), 2**63 - 1)) for s in scores]), strict=True):
                    x.extend(y)
            return out

        return run

    return index


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = 16384, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for each row that is_query (a condition on vec_id) picks, against all other rows."""
    rows = usable(vectors, id_col, vec_col).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    return search(rows, is_query, lists(k), k, "long", shard_rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
