"""Approximate nearest neighbours by collision counting on single projections.

Vectors are put on the unit sphere, where nearness by cosine is nearness by
distance, and projected on ``projections`` fixed random directions; a shard keeps
each projection as one sorted array. A query's window in each array is centred
on its own projection and grows by virtual rehashing: the radius R is multiplied
by ``growth``, and only what the windows gain is read. A vector that has fallen in at
least ``threshold`` of the windows is verified by its exact cosine. The search ends
when the k-th verified distance is within R: a nearer vector would have collided
with a probability of 0.68 in each window, so it would have been counted 87 times of
128 on average, with a spread of 5.3, and is missed if it was counted less than 84
times in every round. There is no cap on the verified; a last round, whose windows
take in everything, serves queries that never get that far.

Every row is indexed; nothing is fitted. Measured recall, and the share of vectors
that is verified, are in the tests and the README.

Nulls: vectors null, empty, zero or holding null or non-finite components, and
rows without an id, take no part. Vectors meet only those of their own length. Of
rows with equal ids the least vector takes part. Fewer candidates than k: all. Ties go
to smaller ids. Vectors are scaled by a power of two before they are measured, so tiny
and huge ones neither vanish nor overflow. An empty table, or one without queries,
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import best_k, search, usable
from .common import table

SEED = 20240229
FIRST_RADIUS = 0.3


def directions(dims: int, projections: int) -> np.ndarray:
    return np.random.default_rng(SEED + dims).standard_normal((dims, projections))


def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two each, which keeps all digits, and their lengths."""
    m = np.ldexp(m, -np.frexp(np.abs(m).max(1))[1][:, None])
    return m, np.sqrt((m * m).sum(1))


class Projections:
    """One shard's sorted arrays."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, projections: int, threshold: int, growth: float):
        self.ids, self.threshold = ids, threshold
        self.m, self.size = scaled(m)
        self.a = directions(m.shape[1], projections)
        at = ((self.m / self.size[:, None]) @ self.a).T
        self.order = np.argsort(at, axis=1, kind="stable")
        self.placed = np.take_along_axis(at, self.order, axis=1)
        self.radii = np.array([r for r in FIRST_RADIUS * growth ** np.arange(200) if r < 2] + [2.0])

    def windows(self, queries: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window starts and ends: by query, radius and projection."""
        centre = (queries / size[:, None]) @ self.a
        edge = lambda sign, side: np.stack([np.searchsorted(p, (c[:, None] + sign * self.radii).ravel(), side).reshape(len(c), -1) for p, c in zip(self.placed, centre.T, strict=True)], axis=2)
        return edge(-1, "left"), edge(1, "right")

    def search(self, own: int, q: np.ndarray, size: float, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Row numbers and cosines of the k nearest found, and how many rows were verified. lo, hi: by radius and projection."""
        n = len(self.ids)
        count, done = np.zeros(n, dtype=np.int64), self.ids == own
        rows, scores, verified = np.zeros(0, dtype=np.int64), np.zeros(0), 0

        def verify(found):
            nonlocal rows, scores, verified
            done[found] = True
            verified += len(found)
            rows = np.concatenate((rows, found))
            scores = np.concatenate((scores, (self.m[found] * q).sum(1) / (self.size[found] * size)))
            top = best_k(self.ids[rows], scores, k)
            rows, scores = rows[top], scores[top]

        a0 = b0 = lo[0]
        for radius, a1, b1 in zip(self.radii, lo, hi, strict=True):
            gained = [o[x:y] for o, x, y in zip(self.order, a1.tolist(), a0.tolist(), strict=True) if x < y] + [o[x:y] for o, x, y in zip(self.order, b0.tolist(), b1.tolist(), strict=True) if x < y]
            a0, b0 = a1, b1
            if gained:
                count += np.bincount(np.concatenate(gained), minlength=n)
                found = np.flatnonzero((count >= self.threshold) & ~done)
                if len(found):
                    verify(found)
            if len(rows) == k and 2 - 2 * scores[-1] <= radius * radius:
                return rows, scores, verified
        if len(rows) < k:
            verify(np.flatnonzero(~done))
        return rows, scores, verified


def projected(k: int, projections: int, threshold: int, growth: float):
    def index(ids: np.ndarray, m: np.ndarray):
        shard = Projections(ids, m, projections, threshold, growth)

        def run(query_ids: np.ndarray, queries: np.ndarray):
            queries, size = scaled(queries)
            lo, hi = shard.windows(queries, size)
            out = ([], [], [])
            for i, own in enumerate(query_ids.tolist()):
                rows, scores, _ = shard.search(own, queries[i], size[i], lo[i], hi[i], k)
                for x, y in zip(out, ([own] * len(rows), ids[rows].tolist(), scores.tolist()), strict=True):
                    x.extend(y)
            return out

        return run

    return index


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, projections: int = 128, threshold: int = 84, growth: float = 1.1, shard_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (cosine) for each row that is_query (a condition on vec_id) picks, against all other rows."""
    rows = usable(vectors, id_col, vec_col)
    rows = rows.where(F.exists("v", lambda x: x != 0))
    return search(rows, is_query, projected(k, projections, threshold, growth), k, "double", shard_rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
