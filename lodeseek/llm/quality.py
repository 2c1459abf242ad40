"""Ordinal cumulative-link regression on graded ratings, over hashed text features.

P(grade >= k) = sigmoid(score - threshold_k): the weights behind the score are
shared by all grades and the thresholds are kept in order, so a document gets an
expected grade and tail probabilities to select by. Features are the distinct
words of a text, their shapes (case and attached signs) and how repetitive it
is, hashed to ``2**BITS`` weights; a score is their weighted sum divided by the
root of the number of distinct words.

Fitting uses a bounded sample of the rated rows (``sample_rows``, the ids with
the smallest hashes), on the driver; scoring runs over every document.

Nulls: rated rows with a null id or grade are not used, nor are grades outside
0..top. A null or empty text, or one without words, has no evidence of quality: its
expected grade is 0, its tails are 0 and it is rejected. Repeated rows are each
scored. Of a rated id's grades the least counts. Without any usable ratings the model
abstains: it keeps everything that has words, at the top grade. Very long texts are scored
whole. Further columns pass through, but for those named as the result's own. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ready, release, table

BITS, TOP = 20, 2
WORD_CACHE = 200_000
PREFIXES = (4, 5, 6, 7)
POWER = 0.25
EDGE = re.compile(r"^\W+|\W+$")


def bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode()) >> (64 - BITS)


def word_features(word: str) -> tuple[int, ...]:
    """A word's buckets: first that of its case and the signs around it; then its core in lower case and how that begins."""
    core = EDGE.sub("", word)
    case = "n" if not core or not core[0].isalpha() else "u" if len(core) > 1 and core.isupper() else "t" if core[0].isupper() else "l"
    signs = "".join(sorted({c for c in word if not c.isalnum() and c not in ",."}))
    shape = bucket(f"\x01{case}{signs}")
    low = core.lower()
    return (shape, *(bucket(f"\x04{low[:k]}") for k in PREFIXES if len(low) > k), bucket(low)) if core else (shape,)


def document_features(n: int, distinct: int) -> tuple[int, ...]:
    """How often a word repeats on average, in quarter powers of two, apart for short and long texts."""
    return (bucket(f"\x02{int(4 * np.log2(n / distinct))}"), bucket(f"\x03{min(int(np.log2(n)), 9)}"))


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one text."""
    words = text.split()
    kinds = set(words)
    if not kinds:
        return np.zeros(0, dtype=np.int32), np.zeros(0)
    found = [word_features(w) for w in kinds]
    shapes, shape_counts = np.unique(np.array([f[0] for f in found], dtype=np.int32), return_counts=True)
    ids, counts = np.unique(np.array([b for f in found for b in f[1:]], dtype=np.int32), return_counts=True)
    own = np.array(document_features(len(words), len(kinds)), dtype=np.int32)
    return np.concatenate((shapes, ids, own)), np.concatenate((shape_counts / len(kinds), counts / len(kinds) ** POWER, np.ones(len(own))))


class Sparse(dict):
    """Weights by bucket, 0 for the others."""

    def __missing__(self, bucket: int) -> float:
        return 0.0


class Model:
    """weights: a float per bucket, or None; thresholds: in ascending order, one for each grade above 0."""

    def __init__(self, weights: Sparse | np.ndarray | None, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: float) -> list[float]:
        return [1 / (1 + float(np.exp(min(t - score, 700)))) for t in self.thresholds]


def screened(ids: np.ndarray, row: np.ndarray, above: np.ndarray, least: float) -> np.ndarray:
    """For each bucket, whether the documents that have it differ in grade from the rest by a chi-square of least, at any threshold."""
    n, seen, passed = len(above), np.bincount(ids, minlength=1 << BITS), np.zeros(1 << BITS, dtype=bool)
    for tail in above.T:
        share = np.clip(tail.mean(), 1e-6, 1 - 1e-6)
        hits, rest = np.bincount(ids, tail[row], 1 << BITS), np.maximum(n - seen, 1)
        passed |= (hits - seen * share) ** 2 * n >= least * np.maximum(seen, 1) * rest * share * (1 - share)
    return passed


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int = TOP, l2: float = 1e-5, rounds: int = 300, rate: float = 0.2, least_chi2: float = 20) -> Model:
    """Full-batch Adam on the cumulative-link likelihood; gaps between thresholds are exponentials, so they stay in order."""
    if not len(rows) or len(set(grades.tolist())) < 2:
        return Model(None, np.zeros(top))
    ids, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    above = grades[:, None] >= np.arange(1, top + 1)  # whether each tail holds
    known = screened(ids, row, above, least_chi2)[ids]  # the others would be learnt by heart
    val, row, (used, idx) = val[known], row[known], np.unique(ids[known], return_inverse=True)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    base = -np.log(share / (1 - share))
    x = np.concatenate((np.zeros(len(used)), base[:1], np.log(np.maximum(np.diff(base), 1e-2))))
    m, v, n = np.zeros_like(x), np.zeros_like(x), len(used)
    for step in range(1, rounds + 1):
        w, gaps = x[:n], np.exp(x[n + 1 :])
        theta = x[n] + np.concatenate(([0], np.cumsum(gaps)))
        s = np.bincount(row, val * w[idx], len(rows))
        cdf = np.column_stack((np.ones(len(rows)), 1 / (1 + np.exp(np.clip(theta - s[:, None], -60, 60))), np.zeros(len(rows))))
        pick = np.arange(len(rows))
        hi, lo = cdf[pick, grades], cdf[pick, grades + 1]
        ds = (hi + lo - 1) / len(rows)  # of -log(hi - lo), whose plain quotients would lose all digits in the tails
        apart = -np.expm1(-np.concatenate(([np.inf], gaps, [np.inf])))[grades]
        own, over = (1 - hi) / np.maximum(1 - lo, 1e-300) / apart, lo / np.maximum(hi, 1e-300) / apart
        dtheta = np.array([own[grades == k].sum() - over[grades == k - 1].sum() for k in range(1, top + 1)]) / len(rows)
        after = np.cumsum(dtheta[::-1])[::-1]
        g = np.concatenate((np.bincount(idx, val * ds[row], n) + l2 * w, after[:1], after[1:] * gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(Sparse(zip(used.tolist(), x[:n].tolist(), strict=True)), x[n] + np.concatenate(([0], np.cumsum(np.exp(x[n + 1 :])))))


@lean
def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [vector(t or "") for t in b.column(0).to_pylist()]
        ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
        flat = lambda i, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*(f[i] for f in found), np.zeros(0)]).astype(kind)))
        yield pa.RecordBatch.from_arrays([flat(0, np.int32), flat(1, np.float32), *b.columns[1:]], names=["ids", "vals", "rid", "grade"])


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = 6000, top: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """ratings: id_col and an int grade. The sample, of at most sample_rows ids, is what is broadcast and collected; of a repeated id's texts the least is taken."""
    ready(docs.sparkSession)
    rated = ratings.select(F.col(id_col).alias("_rid"), F.col("grade").cast("int").alias("_grade")).where(F.col("_rid").isNotNull() & F.col("_grade").between(0, top))
    sample = rated.groupBy("_rid").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_rid"), "_rid").limit(sample_rows)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_id") == F.col("_rid")).groupBy(F.col("_rid").cast("long").alias("_rid"), "_grade").agg(F.min("_text").alias("_text")).select("_text", "_rid", "_grade")
    got = found.mapInArrow(featurize, "ids array<int>, vals array<float>, rid long, grade int").toArrow().combine_chunks()
    ids, vals, rid, grade = (got[c].combine_chunks() for c in got.column_names)
    flat, weights, ends = ids.flatten().to_numpy(), vals.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
    rows = [(flat[a:e], weights[a:e]) for a, e in zip(ends, ends[1:], strict=False)]
    # in the order of ids and contents, so that sums don't depend on the order of arrival
    order = sorted((i for i in range(len(rows)) if len(rows[i][0])), key=lambda i: (rid[i].as_py(), rows[i][0].tobytes()))
    model = fit([rows[i] for i in order], grade.to_numpy()[order].astype(np.int64), top) if order else fit([], np.zeros(0, dtype=np.int64), top)
    del got, ids, vals, flat, weights, rows
    release()
    return model


def scorer(model: Model, top: int):
    weights = model.weights

    class Weighed(dict):
        """What a word adds to the score, kept for words seen before: the real part by its core, the imaginary by its shape."""

        def __missing__(self, word: str) -> complex:
            if len(self) >= WORD_CACHE:
                self.clear()
            shape, *core = word_features(word)
            self[word] = w = complex(sum(weights[b] for b in core), weights[shape])
            return w

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Weighed()
        for b in batches:
            tails = []
            for text in b.column(0).to_pylist():
                words = (text or "").split()
                kinds = set(words)
                if not kinds:
                    tails.append([0.0] * top)
                elif weights is None:
                    tails.append([1.0] * top)
                else:
                    added = sum(map(cache.__getitem__, sorted(kinds)))
                    score = added.real / len(kinds) ** POWER + added.imag / len(kinds)
                    tails.append(model.tails(score + sum(weights[x] for x in document_features(len(words), len(kinds)))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(tails, pa.list_(pa.float64()))], names=[*b.schema.names[1:], "_tails"])

    return run


def score(docs: DataFrame, model: Model, select_grade: int = TOP, select_at: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probs (of grades 1..top) and kept; text_col is passed through, other columns too."""
    ready(docs.sparkSession)
    top = len(model.thresholds)
    own = [c for c in docs.columns if c not in ("expected_grade", "tail_probs", "kept")]
    names = [f"_c{i}" for i in range(len(own))]
    plain = docs.select(F.col(f"`{text_col}`").alias("_t"), *[F.col(f"`{c}`").alias(n) for c, n in zip(own, names, strict=True)])
    schema = ", ".join([*(f"{n} {plain.schema[n].dataType.simpleString()}" for n in names), "_tails array<double>"])
    got = plain.mapInArrow(scorer(model, top), schema)
    expected = F.round(F.aggregate("_tails", F.lit(0.0), lambda a, x: a + x), 9)
    return got.select(*[F.col(n).alias(c) for c, n in zip(own, names, strict=True)], expected.alias("expected_grade"), F.col("_tails").alias("tail_probs"), (F.element_at("_tails", select_grade) >= select_at).alias("kept"))


def grades(labels: DataFrame) -> DataFrame:
    """Three grades from the two marks: 0 toxic, 1 poor text, 2 good and clean.

    In this order one score can hold all three: a poor text's shapes and
    repetitions add up to a bounded amount, a toxic text's words do not.
    """
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, train(docs, grades(table(spark, sf_dir, "labels"))))
    tail = lambda k: F.round(F.element_at("tail_probs", k), 9)
    return got.select("doc_id", "expected_grade", tail(1).alias("p_grade_1"), tail(2).alias("p_grade_2"), "kept")
