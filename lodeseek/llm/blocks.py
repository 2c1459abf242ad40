"""A query set against all vectors, shard by shard.

Vectors are dealt by the hash of their id to shards of about ``shard_rows``: each
goes to one shard, once. Queries go to every shard. In a shard's task the vectors
come first, sorted by id; its index is built once, and the queries stream by it
in blocks. A task holds one shard and one block, whatever the tables' sizes. Each
shard gives every query its best rows, and those of all shards are merged by a
window over the query, which keeps k a task before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ready

QUERY_BLOCK = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vector (as doubles) of rows whose id and components are all there and finite, and which have components."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)


def matrix(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows sorted by id and vector; of rows with equal ids the first stays."""
    ids = np.concatenate([p.column(2).to_numpy() for p in parts])
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    flat = np.concatenate([p.column(4).flatten().to_numpy(zero_copy_only=False) for p in parts])
    return ids[first], np.ascontiguousarray(flat.reshape(len(ids), -1)[first])


def sharded(index: Callable, score_type: pa.DataType):
    """Rows (shard, q, vec_id, dims, v) sorted by shard, dims, q, vec_id and v in; (query_id, vec_id, score) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vectors, queries, rows, search, last = None, [], [], 0, None, None

        def answers():
            nonlocal queries, rows, search, last
            if queries and vectors and search is None:
                search = index(*matrix(vectors))
            if queries and search is not None:
                ids, m = matrix(queries)
                fresh = slice(int(len(ids) > 0 and ids[0] == last), None)  # a repeated id at a block's edge
                if len(ids[fresh]):
                    got = search(ids[fresh], m[fresh])
                    yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], score_type)], names=["query_id", "vec_id", "score"])
                last = ids[-1]
            queries, rows = [], 0

        for b in batches:
            shard, q, dims = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (dims[1:] != dims[:-1]) | (q[1:] != q[:-1]), [True])))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if key != (shard[x], dims[x]):
                    yield from answers()
                    key, vectors, search, last = (shard[x], dims[x]), [], None, None
                (queries if q[x] else vectors).append(b.slice(x, y - x))
                rows += (y - x) * bool(q[x])
                if rows >= QUERY_BLOCK:
                    yield from answers()
        yield from answers()

    return run


def search(vectors: DataFrame, is_query: Column, index: Callable, k: int, score_type: str, shard_rows: int) -> DataFrame:
    """index(ids, vectors) -> a function of (query ids, queries) that gives lists of query_id, vec_id and score, each query's own id left out."""
    ready(vectors.sparkSession)
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    dims = F.size("v").alias("dims")
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    columns = ["shard", "q", "vec_id", "dims", "v"]
    rows = vectors.select(shard, F.lit(False).alias("q"), "vec_id", dims, "v").select(*columns)
    queries = vectors.where(is_query).select(every, F.lit(True).alias("q"), "vec_id", dims, "v").select(*columns)
    dealt = rows.unionByName(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dims", "q", "vec_id", "v")
    best = dealt.mapInArrow(sharded(index, pa.float64() if score_type == "double" else pa.int64()), f"query_id long, vec_id long, score {score_type}")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]
