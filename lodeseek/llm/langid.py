"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over the known languages and
``und`` (no language): the text's likelihood under character-trigram models, the
language that the markup declares, the address suffix, and a prior for the host
that is smoothed towards its parent domain's and that towards all rows'. The
last three come from grouped aggregations over all rows: each row whose text
alone decides (posterior of ``VOTE_AT`` or more) votes once, a row's own vote is
taken out of its host's count, and counts are integers, so results don't depend
on the order of rows.

The trigram models are fitted on a bounded sample: the ``sample_per_lang`` ids
of each labelled language with the smallest hashes, one text (the least) of each. Every labelled
language has a model. From ``CELLS`` / ``BUCKETS`` languages on all models get fewer
buckets, so that together they stay within ``CELLS`` numbers.

Nulls: null or empty text has no likelihood and takes its host's prior; without
a letter it is ``und``. A null host, declaration or suffix is no evidence and
adds nothing. Repeated rows each count, but a repeated id only once in the sample. Of
languages of equal posterior the first by name wins, ``und`` last. A very long text is counted whole, in
stretches of ``CHUNK`` characters. Further columns are ignored, whatever their names. An
empty table gives no rows; without training rows every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_IDS, Scratch, lean, ready, table

BUCKETS = 1 << 16
#: Of all models together, 8 bytes each: 128 languages with all buckets.
CELLS = 1 << 23
CHUNK = 400_000
#: Trigrams of running text overlap and depend on each other: this share of their log-likelihood counts as independent.
TEMPER = 0.25
VOTE_AT = 0.9
UND = "und"


def buckets_for(langs: int) -> int:
    """A power of two."""
    return min(BUCKETS, 1 << max(CELLS // max(langs, 1), 2).bit_length() - 1)


def trigrams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """trigram_buckets in stretches of CHUNK."""
    low = f" {text} ".lower()
    for at in range(0, max(len(low) - 2, 1), CHUNK):
        yield _buckets(low[at : at + CHUNK + 2], buckets)


def trigram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each three characters of the text in lower case, with a space before and after; none with a digit, for numbers and keys have no language."""
    return np.concatenate(list(trigrams(text, buckets)))


def _buckets(low: str, buckets: int) -> np.ndarray:
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F)
    digit = c - np.uint32(48) < 10
    return (h >> np.uint32(33 - buckets.bit_length()))[~(digit[:-2] | digit[1:-1] | digit[2:])]


def counting(langs: list[str], buckets: int):
    number = {x: i for i, x in enumerate(langs)}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), buckets), dtype=np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for grams in trigrams(text or "", buckets):
                    counts[number[lang]] += np.bincount(grams, minlength=buckets)
        lang, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[lang, at], pa.int64())], names=["lang", "bucket", "n"])

    return run


def fit(docs: DataFrame, sample_per_lang: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket and language); the last column is und's: all trigrams alike."""
    ready(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).where(F.col("_l").isNotNull() & F.col("_i").isNotNull())
    # ids and not rows, so that one repeated id doesn't narrow the range below
    sizes = {r[0]: max(r[1], 1) for r in known.where(F.col("_l") != UND).groupBy("_l").agg(F.approx_count_distinct("_i", 0.02)).collect()}
    langs, buckets = sorted(sizes), buckets_for(len(sizes))
    # about one and a half times as many of each language as are wanted, by the range of their hash; only those are ranked
    h = F.pmod(F.xxhash64("_i"), F.lit(1 << 30))
    ahead = reduce(lambda c, x: c.when(F.col("_l") == x, h <= F.lit(min(1 << 30, (3 * sample_per_lang << 29) // sizes[x]))), langs, F.when(F.lit(False), False))
    some = known.where(ahead).select("_l", "_i").distinct()
    ranked = some.select("_l", "_i", F.row_number().over(W.partitionBy("_l").orderBy(h, "_i")).alias("_r")).where(F.col("_r") <= sample_per_lang)
    ids = ranked.select(F.col("_l").alias("_sl"), F.col("_i").alias("_si"))
    small = sum(min(n, sample_per_lang) for n in sizes.values()) <= BROADCAST_IDS
    sample = known.join(F.broadcast(ids) if small else ids, (F.col("_i") == F.col("_si")) & (F.col("_l") == F.col("_sl")), "left_semi").groupBy("_l", "_i").agg(F.min("_t").alias("_t"))
    got = sample.select("_t", "_l").mapInArrow(counting(langs, buckets), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), buckets))
    counts[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    share = (counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * buckets)
    return langs, np.ascontiguousarray(np.log(np.vstack((share, np.full((1, buckets), 1 / buckets))).T))


def likelihoods(model: np.ndarray):
    """Adds to rows (text first) the tempered log-likelihoods, relative to the largest."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, model.shape[1]))
            for i, text in enumerate(b.column(0).to_pylist()):
                if text:
                    for grams in trigrams(text, len(model)):  # the two ways differ in the order of addition only
                        out[i] += model[grams].sum(0) if len(grams) < 2000 else np.bincount(grams, minlength=len(model)) @ model
            out = TEMPER * (out - out.max(1, keepdims=True, initial=-np.inf)) if len(out) else out
            ends = pa.array(np.arange(b.num_rows + 1) * model.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[*b.schema.names[1:], "ll"])

    return run


def normalized(logs: Column) -> Column:
    """Probabilities from logarithms."""
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def counts_of(vote: Column, k: int) -> Column:
    return F.array(*[F.sum(F.when(vote == i, 1).otherwise(0)).cast("double") for i in range(k)])


def smoothed(counts: Column, prior: Column, strength: float) -> Column:
    """Dirichlet posterior mean of counts with a prior of the given strength."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + strength * p) / (total + strength))


def fuse(evidence: DataFrame, langs: list[str], host_strength: float = 5.0, parent_strength: float = 20.0, trust: float = 20.0) -> DataFrame:
    """evidence: key columns, host, parent, declared, suffix, letters, ll. Adds lang, posterior, text_lang and kept."""
    k, names = len(langs) + 1, F.array(*[F.lit(x) for x in [*langs, UND]])
    alone = normalized(F.col("ll"))
    best = lambda p: F.array_position(p, F.array_max(p)).cast("int") - 1
    e = evidence.withColumn("_alone", alone).withColumn("_text", best(F.col("_alone")))
    e = e.withColumn("_vote", F.when(F.col("letters") & (F.array_max("_alone") >= VOTE_AT), F.col("_text")).otherwise(-1))
    flat = F.array(*[F.lit(1.0 / k)] * k)
    voted = e.where(F.col("_vote") >= 0)
    hosts = voted.where(F.col("host").isNotNull()).groupBy("host", "parent").agg(counts_of(F.col("_vote"), k).alias("_hn"))
    added = F.array(*[F.sum(F.col("_hn")[i]) for i in range(k)])
    parents = hosts.groupBy("parent").agg(added.alias("_pn"))
    every = voted.groupBy().agg(F.coalesce(counts_of(F.col("_vote"), k), F.array(*[F.lit(0.0)] * k)).alias("_n")).select(smoothed(F.coalesce("_n", F.array(*[F.lit(0.0)] * k)), flat, float(k)).alias("_all"))
    row = every.first()
    overall = F.array(*[F.lit(float(x)) for x in (row[0] if row and row[0] and None not in row[0] else [1.0 / k] * k)])
    # one row a host or parent; where those are few, AQE makes broadcast joins of these by their measured size, else it splits hot hosts
    priors = hosts.join(parents.withColumn("_pp", smoothed(F.col("_pn"), overall, parent_strength)).select(F.col("parent").alias("_p"), "_pp"), F.col("parent") == F.col("_p"), "left")
    priors = priors.select(F.col("host").alias("_h"), "_hn", F.coalesce("_pp", overall).alias("_pp"))

    def seen(col: str) -> DataFrame:
        """log P(value | language), up to what is common to all languages, by value."""
        n = voted.where(F.col(col).isNotNull()).groupBy(col).agg(counts_of(F.col("_vote"), k).alias("_n"))
        share = smoothed(F.col("_n"), overall, trust)
        return n.select(F.col(col).alias(f"_{col}"), F.zip_with(share, overall, lambda s, o: F.log(s / o)).alias(f"_{col}_log"))

    own = F.array(*[F.when(F.col("_vote") == i, 1.0).otherwise(0.0) for i in range(k)])
    j = e.join(priors, F.col("host") == F.col("_h"), "left")
    without = F.zip_with(F.col("_hn"), own, lambda n, o: n - o)
    j = j.withColumn("_prior", F.coalesce(F.when(F.col("_h").isNotNull(), smoothed(without, F.col("_pp"), host_strength)), overall))
    for col in ("declared", "suffix"):
        j = j.join(seen(col), F.col(col) == F.col(f"_{col}"), "left")
    none = F.array(*[F.lit(0.0)] * k)
    logs = F.zip_with("ll", "_prior", lambda a, p: a + F.log(p))
    for col in ("declared", "suffix"):
        logs = F.zip_with(logs, F.coalesce(f"_{col}_log", none), lambda a, x: a + x)
    j = j.withColumn("_post", normalized(logs)).withColumn("_best", best(F.col("_post")))
    lang = F.when(F.col("letters"), F.element_at(names, F.col("_best") + 1)).otherwise(UND)
    post = F.when(F.col("letters"), F.round(F.array_max("_post"), 6)).otherwise(1.0)
    keys = [c for c in evidence.columns if c not in ("host", "parent", "declared", "suffix", "letters", "ll")]
    return j.select(*keys, lang.alias("lang"), post.alias("posterior"), F.when(F.col("letters"), F.element_at(names, F.col("_text") + 1)).otherwise(UND).alias("text_lang"), ((lang != UND) & (post >= 0.5)).alias("kept"))


def evidence(rows: DataFrame, model: np.ndarray, keys: list[str]) -> DataFrame:
    """rows: keys, text, host, parent, declared, suffix; the text gives way to its likelihoods."""
    ready(rows.sparkSession)
    rest = [*keys, "host", "parent", "declared", "suffix"]
    plain = rows.select("text", *rest, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = ", ".join([*(f"{c} {plain.schema[c].dataType.simpleString()}" for c in rest), "letters boolean, ll array<double>"])
    return plain.mapInArrow(likelihoods(model), schema)


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents have their source for a host, and no markup or address."""
    no = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), no.cast("long").alias("page_id"), "text", F.concat(F.lit("source:"), "source").alias("host"), F.lit("source:").alias("parent"), no.alias("declared"), no.alias("suffix"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages: visible text; html lang; the host, its registered domain, and its last label."""
    # what is left open runs to the end, and a tag holds no <: so no place is searched twice
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>|&[a-z0-9#]{1,10};", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    given = lambda c: F.when(c != "", c)
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), text.alias("text"), given(host).alias("host"), given(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("parent"), given(declared).alias("declared"), given(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"))


def identify(rows: DataFrame, langs: list[str], model: np.ndarray, keys: list[str], scratch: Scratch) -> DataFrame:
    """Likelihoods are written once, without the texts, and read by the aggregations and the fusion."""
    return fuse(scratch.save(evidence(rows, model, keys), "evidence"), langs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; a row has either a doc_id or a page_id."""
    docs = table(spark, sf_dir, "documents")
    langs, model = fit(docs)
    rows = of_documents(docs).unionByName(of_pages(table(spark, sf_dir, "pages")))
    return identify(rows, langs, model, ["doc_id", "page_id"], Scratch(spark, "langid"))
