"""Near-duplicate detection by MinHash with tensored banding, and exact verification.

A document is its set of distinct 5-word shingles (hashed to 64 bits). Documents
with equal sets are one class from the start, and only the class goes on. Each
class gets two small collections, A and B, of ``M`` entries; an entry combines
``R`` minhashes. Its M * M table keys are the pairs (A_i, B_j), so 2 * M * R minhashes
serve M * M tables of 2 * R rows each. With M = 12 and R = 2 a pair at a
similarity of 0.75 meets in some table but for a chance of 1e-4.

Two classes can only meet in a table if they share an A entry and a B entry;
so entries that no other class has are dropped before any table key is made.

In a table's bucket every class is compared with one head, the class whose entries
are the most common; in a family of copies that is the copy nearest to all, so
the work is linear in the family's size. Mates of one head that are in different
components after that may still be similar to each other. They are paired only
where exact bounds, from what each shares with the head and which shingles beyond
it they share, allow 0.75, and then compared on their full sets as well.

Nulls and ties: a null or wordless text has an empty set, and is linked with
nothing. A null doc_id is linked with nothing and gets a null component and kept.
Repeated rows are copies; rows of one doc_id that differ in text are one document
with several texts. Ties between heads go to the smaller id. A very long text is signed
whole; a task holds the shingles of ``DOCS_AT_ONCE`` texts, 8 bytes each. Further columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, pick, ready, table
from .graph import components

WORDS = 5
M, R = 12, 2
SIMILAR = 75
WORD_CACHE = 200_000
DOCS_AT_ONCE = 400

_rng = np.random.default_rng(8675309)
POSITION = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = _rng.integers(1, 2**63, 2 * M * R, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _rng.integers(1, 2**63, 2 * M * R, dtype=np.uint64)
ENTRY = _rng.integers(1, 2**63, R + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Only A-Z are lower-cased; words are split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    s = h[: n - WORDS + 1] * POSITION[0]
    for k in range(1, WORDS):
        s += mixed(h[k : n - WORDS + 1 + k]) * POSITION[k]
    return np.unique(mixed(s))


def entries(sets: list[np.ndarray]) -> np.ndarray:
    """The 2 * M entries of each set; sets are not empty. Each entry's value tells its number too."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), 2 * M), dtype=np.uint64)
    for e in range(2 * M):
        v = np.full(len(sets), e + 1, dtype=np.uint64) * ENTRY[R]
        for k in range(R):
            at = e * R + k
            v += mixed(np.minimum.reduceat((flat ^ OFFSET[at]) * FACTOR[at], starts)) * ENTRY[k]
        out[:, e] = mixed(v)
    return out


@lean
def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        texts = b.column(1)
        for at in range(0, b.num_rows, DOCS_AT_ONCE):
            sets = [shingles(t, hashes) for t in texts.slice(at, DOCS_AT_ONCE).to_pylist()]
            full = [s for s in sets if len(s)]
            made = iter(entries(full).view(np.int64)) if full else iter(())
            rows = [next(made).tolist() if len(s) else None for s in sets]
            key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, DOCS_AT_ONCE), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "entries"])


@lean
def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        for at in range(0, b.num_rows, DOCS_AT_ONCE):
            sets = [shingles(t, hashes).view(np.int64) for t in b.column(1).slice(at, DOCS_AT_ONCE).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, DOCS_AT_ONCE), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], names=["doc_id", "shingles"])


def compared(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """pairs: a, b. A written table of a, b, na, nb (set sizes), common (shingles in both) and rest (b's shingles that a hasn't), on full sets."""
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}_ids")
    sets = scratch.save(pick(docs, ids).mapInArrow(full_sets, "doc_id long, shingles array<long>"), f"{name}_sets")
    one = lambda c: sets.select(F.col("doc_id").alias(f"_{c}"), F.col("shingles").alias(f"s{c}"))
    j = pairs.join(one("b"), F.col("b") == F.col("_b")).join(one("a"), F.col("a") == F.col("_a"))
    rest = F.array_except("sb", "sa")
    out = j.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), rest.alias("rest")).withColumn("common", F.col("nb") - F.size("rest"))
    out = scratch.save(out, f"{name}_compared")
    scratch.drop(f"{name}_ids", f"{name}_sets")
    return out


def linked(t: DataFrame) -> DataFrame:
    """Of compared pairs those at SIMILAR or above, as u, v."""
    return t.where(100 * F.col("common") >= SIMILAR * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def apart(star: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of one head's bucket mates in different components that could be similar, judged by exact bounds.

    For mates x, y of a head, what they have in common is at most the lesser of
    what each has in common with the head, and what they share of their rests.
    Two mates thus need a rest shingle in common, or overlaps with the head that
    alone suffice. Mates outside the largest component meet the others; mates whose
    own shared shingles can't suffice with anyone are left out before they meet.
    """
    x = star.select("a", "b", F.col("nb").alias("n"), F.col("common").alias("c"), "rest").join(labels, F.col("b") == F.col("node"), "left").withColumn("label", F.coalesce("label", "b")).drop("node")
    parts = x.groupBy("a", "label").agg(F.count("*").alias("k")).groupBy("a").agg(F.max(F.struct("k", "label"))["label"].alias("main"), F.count("*").alias("parts"), F.sum("k").alias("mates"))
    # written, so that the join below has nothing but exchanges under it and a large head's rows can be split
    parts = scratch.save(parts.where("parts > 1").select(F.col("a").alias("_a"), "main", "mates"), "parts")
    x = x.join(parts, F.col("a") == F.col("_a")).drop("_a").withColumn("head", F.struct((-F.col("mates")).alias("k"), F.col("a").alias("i"))).drop("mates")
    heads = x.groupBy(F.col("b").alias("_b")).agg(F.collect_set("head").alias("heads"))
    x = scratch.save(x.join(heads, F.col("b") == F.col("_b")).drop("_b"), "mates")
    ask = lambda t: t.where("label <> main").select(*[F.col(c).alias(f"y_{c}") for c in t.columns])
    differ = (F.col("a") == F.col("y_a")) & (F.col("label") != F.col("y_label")) & ((F.col("label") == F.col("main")) | (F.col("y_b") < F.col("b")))
    here = F.array_min(F.array_intersect("heads", "y_heads")) == F.col("head")  # a pair meets at its largest head only
    need = 3 * (F.col("n") + F.col("y_n"))  # of 7 times what is in common, at 0.75
    least = F.least("c", "y_c")
    pair = [F.least("b", "y_b").alias("a"), F.greatest("b", "y_b").alias("b")]
    bare = x.drop("rest")
    by_head = bare.join(ask(bare), differ & (7 * least >= need) & here).select(*pair)

    s = x.select("a", "b", "n", "c", "label", "main", "head", "heads", F.explode("rest").alias("s"))
    both = s.groupBy("a", "s").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select(F.col("a").alias("_a"), F.col("s").alias("_s"))
    s = s.join(both, (F.col("a") == F.col("_a")) & (F.col("s") == F.col("_s"))).groupBy("a", "b", "n", "c", "label", "main", "head", "heads").agg(F.collect_list("s").alias("rest"))
    s = s.where(4 * (F.col("c") + F.size("rest")) >= 3 * F.col("n"))
    s = scratch.save(s.select("a", "b", "n", "c", "label", "main", "head", "heads", F.size("rest").alias("z"), F.explode("rest").alias("s")), "rests")
    enough = 7 * (least + F.least("z", "y_z")) >= need
    met = s.join(ask(s), differ & (F.col("s") == F.col("y_s")) & enough & here).groupBy("a", "b", "y_b", "n", "y_n", "c", "y_c").agg(F.count("*").alias("r"))
    by_rest = met.where(7 * (least + F.col("r")) >= need).select(*pair)
    return by_head.unionByName(by_rest).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept, for each row of docs."""
    ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.save(docs.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, entries array<long>"), "signed")
    some = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # equal sets have equal entries, so any row of a class tells them
    rows = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("entries").alias("entries"))
    classes = scratch.save(rows, "classes")

    each = scratch.save(classes.select("rep", F.posexplode("entries").alias("e", "entry")), "entries")
    shared = each.groupBy("entry").agg(F.count("*").alias("c")).where("c > 1").select(F.col("entry").alias("_entry"), "c")
    side = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("e", "entry"))))
    left = each.join(shared, F.col("entry") == F.col("_entry")).groupBy("rep").agg(F.sum("c").alias("known"), side(F.col("e") < M).alias("a"), side(F.col("e") >= M).alias("b"))
    left = left.where((F.size("a") > 0) & (F.size("b") > 0))
    keyed = left.select("rep", "known", F.explode("a").alias("x"), "b").select("rep", "known", "x", F.explode("b").alias("y"))
    keyed = scratch.save(keyed.select("rep", "known", F.xxhash64("x.entry", "y.entry").alias("key")), "keyed")

    heads = keyed.groupBy("key").agg(F.max(F.struct("known", -F.col("rep"))).alias("head"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("_key"), (-F.col("head.col2")).alias("head"))
    star = keyed.join(heads, F.col("key") == F.col("_key")).where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    star = compared(scratch.save(star, "star"), docs, scratch, "star")
    labels = scratch.save(components(linked(star), scratch, "near"), "labels")
    more = linked(compared(scratch.save(apart(star, labels, scratch), "apart"), docs, scratch, "apart"))
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more), scratch, "all")
    scratch.drop("entries", "keyed", "parts", "mates", "rests", "star_compared")

    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("set_key").alias("_key"), F.coalesce("label", "rep").alias("label"))
    out = signed.join(named, F.col("set_key") == F.col("_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "minhash"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), n AS (
  SELECT doc_id, len(s) AS n FROM s
), x AS (
  SELECT doc_id, unnest(s) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), e AS (
  SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, root) AS (
  SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id WHERE r.root < e.v
), m AS (
  SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id
)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(m.root, n.doc_id), n.doc_id) AS component_id, coalesce(least(m.root, n.doc_id), n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN m ON m.doc_id = n.doc_id
"""
