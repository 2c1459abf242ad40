"""Documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet in the shared
folder and read again, so a lost executor costs at most a stage's own tasks. All
stages but the last return the columns of documents and nothing else; extra
columns of the input are left behind at the first.

Documents are told apart by id. A row without an id, or whose id has several texts, is a
document of its own, known by a number made of its id and text (``keyed``) and judged as any other.
A row that is repeated, id and text, is one document; one row of it is left after the
near-duplicates' stage. Empty tables go through all stages and give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import langid, minhash, packing, quality, substrings
from lodeseek.llm.common import Scratch, pick, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the fitted stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the top grade, good and clean, is under a half; and those without words."""
    model = quality.train(docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.score(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with _key: the id, or, for rows that have none or share it with other texts, 2**62 and 62 bits of a hash of id and text.

    So of near-duplicates one that has an id of its own stays first.
    """
    h = F.xxhash64("text")
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b")
    several = scratch.save(ids.select("doc_id"), "several")
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    if several.isEmpty():
        return docs.withColumn("_key", F.coalesce("doc_id", made))
    one = pick(docs, several, "left_anti").withColumn("_key", F.coalesce("doc_id", made))
    return one.select(*docs.columns, "_key").unionByName(pick(docs, several).select(*docs.columns, made.alias("_key")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in none of the known languages, or in none with a posterior of a half; lang becomes the language found.

    Of a repeated row's languages, which only other sources can make differ, the greatest by name counts.
    """
    langs, model = langid.fit(docs)
    scratch = Scratch(spark, "language")
    docs = keyed(docs, scratch)
    found = langid.identify(langid.of_documents(docs.drop("doc_id").withColumnRenamed("_key", "doc_id")), langs, model, ["doc_id"], scratch)
    found = scratch.save(found.groupBy(F.col("doc_id").alias("_id")).agg(F.max("lang").alias("found"), F.max("kept").alias("kept")), "found")
    # what changes is short: documents to drop, and those whose lang is another
    known = docs.select("_key", "lang").join(found, F.col("_key") == F.col("_id"))
    drop = scratch.save(known.where("not kept").select("_key").distinct(), "drop")
    relabel = scratch.save(known.where("kept and not (lang <=> found)").select("_id", "found").distinct(), "relabel")
    kept = pick(docs, drop, "left_anti", "_key")
    small = relabel.count() <= 100_000  # chooses the join alone
    out = kept.join(F.broadcast(relabel) if small else relabel, F.col("_key") == F.col("_id"), "left")
    return out.withColumn("lang", F.coalesce("found", "lang")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest key (see keyed) of each group of near-duplicates, and one row of each document.

    Of a repeated row's other columns that differ, the smallest stay.
    """
    scratch = Scratch(spark, "near")
    docs = keyed(docs, scratch)
    found = minhash.near_duplicates(docs, scratch, id_col="_key")
    drop = scratch.save(found.where("not kept").select("doc_id").distinct(), "drop")
    kept = pick(docs, drop, "left_anti", "_key")
    # only rows whose key is there again are shuffled with their texts
    again = scratch.save(kept.groupBy("_key").count().where("count > 1").select("_key"), "again")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = pick(kept, again, id_col="_key").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*")
    return pick(kept, again, "left_anti", "_key").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes and more that also stand earlier; drops documents of which nothing is left.

    Half a character at the edge of a cut goes too, so what stays is text.
    """
    got = substrings.deduplicate(docs, Scratch(spark, "substrings"), keep=("lang", "source", "n_chars"))
    whole = F.col("n_removed") == 0
    left = got.where(whole | (F.length("kept_text") > 0))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.length("kept_text")).cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids: one row per piece."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if last:
            scratch.drop(last)
        last = name.replace(" ", "_")
    return docs
