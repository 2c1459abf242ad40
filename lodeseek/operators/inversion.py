"""Documents to inverted-index tables, as plain DataFrame transformations.

documents: segment int, doc_id long, one nullable string column f_NAME a field (so that
           a field may have any name).
postings:  segment, field, term, doc_id, tf, positions, dl. dl, the field's length in
           the document, rides along, so scoring joins nothing.
norms:     segment, field, doc_id, length; a row for each document and indexed field.
blocks:    segment, field, term, doc_id, dl, place, doc_ids, starts, numbers: both of the above,
           as a session keeps them. A row has a term's postings in some SLICE_CHARS of texts:
           in numbers, for each document from its start on, tf, dl and the positions; a word
           that is there once has doc_id, dl and place instead, for most terms are such and
           arrays cost more than they hold. Where term is null, numbers are lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import JOINT, TERM_TYPE, analyzer_named
from ..schema import Schema

KEYS = ("segment", "doc_id")
#: Of rows, which are mostly texts; their postings take some four times as much in memory.
SPREAD_BYTES = 28 << 20
#: Of texts inverted at a time.
SLICE_CHARS = 1 << 22
#: Of one Arrow batch of postings.
OUT_ROWS = 1 << 15
#: Documents of one row of renumbered()'s table: 64 words of 64 bits.
BLOCK_BITS = 12


def field_terms(schema: Schema, name: str) -> Column:
    """Indexed terms and positions of one field; empty where the field is left out."""
    return F.coalesce(analyzer_named(schema[name].analyzer_name).terms(F.col(f"`f_{name}`")), F.array().cast(TERM_TYPE))


def inverted(docs: DataFrame, schema: Schema) -> DataFrame:
    """Postings and norms in one pass: where term is null, a row is a document's norm, with its length as dl."""

    def rows(segment, doc_id, name, keep_places, terms, dl, term, doc, at, tf, places):
        names, n, m = ["segment", "field", "term", "doc_id", "tf", "positions", "dl"], len(doc_id), len(at)
        yield pa.record_batch([segment, pa.array([name] * n, pa.string()), pa.nulls(n, pa.string()), doc_id, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), pa.array(dl)], names=names)
        if m:
            ends, doc_at = np.append(at, len(places)).astype(np.int32), pa.array(doc)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(places)) if keep_places else pa.ListArray.from_arrays(pa.array(np.zeros(m + 1, np.int32)), pa.array([], pa.int32()))
            yield pa.record_batch([segment.take(doc_at), pa.array([name] * m, pa.string()), terms.take(pa.array(term)), doc_id.take(doc_at), pa.array(tf), lists, pa.array(dl[doc])], names=names)

    return _grouped(docs, schema, rows, "segment int, field string, term string, doc_id long, tf int, positions array<int>, dl int")


def blocks(docs: DataFrame, schema: Schema) -> DataFrame:
    """The same a term at a time: some fifth as many rows, whose terms aren't repeated."""

    def rows(segment, doc_id, name, keep_places, terms, dl, term, doc, at, tf, places):
        names, n, m = ["segment", "field", "term", "doc_id", "dl", "place", "doc_ids", "starts", "numbers"], len(doc_id), len(at)

        def lists(values, ends, none):
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=pa.array(none))

        one, own = np.zeros(1, bool), np.array([0, n])
        yield pa.record_batch([segment.slice(0, 1), pa.array([name]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), lists(doc_id, own, one), lists(pa.array([], pa.int32()), own * 0, one), lists(pa.array(dl), own, one)], names=names)
        if not m:
            return
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        counts = np.diff(np.append(first, m))
        lone = (counts == 1) & (tf[first] == 1)
        here = np.where(lone, doc[first], 0)
        # what is left, for the arrays
        many = np.repeat(~lone, counts)
        places_of, ends = places[np.repeat(many, tf)] if keep_places else places[:0], np.append(0, np.cumsum(counts * ~lone))
        tf_of, doc_of = tf[many], doc[many]
        widths = np.append(0, np.cumsum(2 + tf_of * keep_places))
        start = widths[:-1]
        numbers = np.empty(widths[-1], dtype=np.int32)
        numbers[start], numbers[start + 1] = tf_of, dl[doc_of]
        numbers[np.arange(len(places_of)) + 2 * np.repeat(np.arange(1, len(tf_of) + 1), tf_of * keep_places)] = places_of
        starts = start - np.repeat(widths[ends[:-1]], counts * ~lone)
        k = len(first)
        yield pa.record_batch([segment.take(pa.array(np.zeros(k, np.int64))), pa.array([name] * k, pa.string()), terms.take(pa.array(term[first])), doc_id.take(pa.array(here, mask=~lone)), pa.array(dl[here], mask=~lone), pa.array(places[at[first]], mask=~(lone & keep_places)), lists(doc_id.take(pa.array(doc_of)), ends, lone), lists(pa.array(starts.astype(np.int32)), ends, lone), lists(pa.array(numbers), widths[ends], lone)], names=names)

    return _grouped(docs, schema, rows, "segment int, field string, term string, doc_id long, dl int, place int, doc_ids array<long>, starts array<int>, numbers array<int>")


def _grouped(docs: DataFrame, schema: Schema, made_of: Callable, columns: str) -> DataFrame:
    """What made_of gives, as Arrow, for the postings of a field in some texts of one segment. It goes to executors by itself, without this package.

    Rows are made where the texts are. Spark cuts and lower-cases the words; they are grouped by Arrow
    and numpy over some SLICE_CHARS of texts at a time, sorted by field, term and document there.
    So memory doesn't grow with a partition, and a cached batch holds few terms and is passed over by its statistics.
    """
    kinds, texts = [], []
    for n in schema.indexed:
        made = analyzer_named(schema[n].analyzer_name).joined(F.col(f"`f_{n}`"))
        kinds.append((n, schema[n].store_positions, None if made is None else sorted(made[1])))
        texts.append(field_terms(schema, n) if made is None else made[0])
    rows = docs.select(*KEYS, *[c.alias(f"_{i}") for i, c in enumerate(texts)])
    joint, most, batch_rows = JOINT, SLICE_CHARS, OUT_ROWS

    def words_of(column, dropped):
        """Of all documents together: distinct terms in order, and of each word its document, its term's place and its position."""
        n = len(column)
        if dropped is None:
            lists, tokens = column, column.flatten()
            words, places = tokens.field("term"), tokens.field("position").to_numpy(zero_copy_only=False)
        else:
            lists = pc.split_pattern(column.fill_null(""), joint)
            words, places = lists.flatten(), None
        lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        docs = np.repeat(np.arange(n, dtype=np.int64), lengths)
        coded = pc.dictionary_encode(words)
        order = pc.sort_indices(coded.dictionary).to_numpy()
        terms = coded.dictionary.take(pa.array(order))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[coded.indices.to_numpy(zero_copy_only=False)]
        if places is None:  # counted among what is a word; nothing is one where the text ends or begins with other characters
            word = codes != (0 if len(terms) and terms[0].as_py() == "" else -1)
            before = np.cumsum(word) - word
            firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            places = before - np.repeat(before[firsts[lengths > 0]], lengths[lengths > 0])
            keep = ~pc.is_in(terms, value_set=pa.array(["", *dropped], pa.string())).to_numpy(zero_copy_only=False)[codes]
            docs, codes, places = docs[keep], codes[keep], places[keep]
        return terms, docs, codes, places.astype(np.int32)

    def field_rows(segment, doc_id, column, name, keep_places, dropped):
        n = len(column)
        terms, docs, codes, places = words_of(column, dropped)
        dl = np.bincount(docs, minlength=n).astype(np.int32)
        key = codes * n + docs
        order = np.sort(codes * len(codes) + np.arange(len(codes))) % max(1, len(codes))  # as a stable argsort of codes, but faster; documents and positions rise already
        key, places = key[order], places[order]
        at = np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
        tf = np.diff(np.append(at, len(key))).astype(np.int32)
        return made_of(segment, doc_id, name, keep_places, terms, dl, key[at] // n, key[at] % n, at, tf, places)

    def run(batches):
        for b in batches:
            sizes = np.zeros(b.num_rows, dtype=np.int64)
            for c, (_, _, dropped) in zip(b.columns[2:], kinds, strict=True):
                sizes += pc.fill_null(pc.list_value_length(c) if dropped is None else pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            part, segment = (np.cumsum(sizes) - sizes) // most, b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (segment[1:] != segment[:-1])) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                s = b.slice(i, j - i)
                for c, kind in zip(s.columns[2:], kinds, strict=True):
                    for out in field_rows(s.column(0), s.column(1), c, *kind) if j > i else ():
                        for at in range(0, out.num_rows, batch_rows):
                            yield out.slice(at, batch_rows)

    return rows.mapInArrow(run, columns)


def postings(docs: DataFrame, schema: Schema) -> DataFrame:
    """Frequency and ascending positions of each term in each document."""
    return postings_of(inverted(docs, schema))


def postings_of(made: DataFrame) -> DataFrame:
    return made.where("term is not null")


def norms_of(made: DataFrame) -> DataFrame:
    return made.where("term is null").select("segment", "field", "doc_id", F.col("dl").alias("length"))


def postings_in(made: DataFrame) -> DataFrame:
    """Of blocks. What is asked of field and term reaches the blocks before they are taken apart."""
    each = made.where("term is not null").select("segment", "field", "term", F.col("dl").alias("_dl"), "place", "starts", "numbers", F.posexplode(F.coalesce("doc_ids", F.array("doc_id"))).alias("_i", "doc_id"))
    lone, at = F.col("starts").isNull(), F.get("starts", "_i")
    end = F.coalesce(F.get("starts", F.col("_i") + 1), F.size("numbers"))
    positions = F.when(~lone, F.slice("numbers", at + 3, end - at - 2)).when(F.col("place").isNotNull(), F.array("place")).otherwise(F.array().cast("array<int>"))
    return each.select("segment", "field", "term", "doc_id", F.when(lone, 1).otherwise(F.get("numbers", at)).alias("tf"), positions.alias("positions"), F.when(lone, F.col("_dl")).otherwise(F.get("numbers", at + 1)).alias("dl"))


def norms_in(made: DataFrame) -> DataFrame:
    each = made.where("term is null").select("segment", "field", "numbers", F.posexplode("doc_ids").alias("_i", "doc_id"))
    return each.select("segment", "field", "doc_id", F.get("numbers", "_i").alias("length"))


def norms(docs: DataFrame, schema: Schema) -> DataFrame:
    """Analyzed lengths, 0 too; a pass of its own over the texts that groups nothing, for whom needs no postings."""
    per_field = F.array(*[F.struct(F.lit(n).alias("field"), F.size(field_terms(schema, n)).alias("length")) for n in schema.indexed])
    return docs.select(*KEYS, F.explode(per_field).alias("f")).select("segment", "f.field", "doc_id", "f.length")


def stored(docs: DataFrame, schema: Schema) -> DataFrame:
    return docs.select(*KEYS, *[F.col(f"`f_{n}`") for n in schema.stored])


def named(df: DataFrame, *more) -> DataFrame:
    """Field columns under their inner names, after the columns in more."""
    return df.select(*more, *[F.col(f"`{c}`").alias(f"f_{c}") for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, and in partitions of some SPREAD_BYTES of what is in its rows: a table in one file, or in few, would be analyzed by few tasks, and a task's postings would grow with the table.

    The bytes are counted by partition, in a pass over lengths: the size of files says little where texts repeat, and
    neither it nor the number of partitions tells that one of them has most rows.
    """
    held = {f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")}
    lengths = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") if c in held else F.lit(0) for c in df.columns]
    size = sum(lengths, F.lit(8 * len(lengths)).cast("long"))
    sizes = [n for _, n in df.groupBy(F.spark_partition_id()).agg(F.sum(size)).collect()]
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // SPREAD_BYTES))
    return df.repartition(wanted) if len(sizes) < wanted or max(sizes) > 2 * SPREAD_BYTES else df


def with_all_fields(df: DataFrame, schema: Schema) -> DataFrame:
    """The schema's columns, null where df has none."""
    have = set(df.columns)
    return df.select(*[c for c in KEYS if c in have], *[F.col(f"`f_{n}`") if f"f_{n}" in have else F.lit(None).cast("string").alias(f"f_{n}") for n in schema])


def numbered(df: DataFrame) -> DataFrame:
    """df with _at, which rises with its partitions and rows. To be written before dense_ids reads it."""
    return df.withColumn("_at", F.monotonically_increasing_id())


def dense_ids(at: DataFrame) -> DataFrame:
    """doc_id 0.. in the order of _at, by counts per partition; no window over all rows in one partition."""
    counts = sorted((int(r[0]), r[1]) for r in at.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = at.sparkSession.createDataFrame(starts, "_part long, _start long")  # a row a partition
    own = at.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_part"))
    return own.withColumn("doc_id", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")


def renumbered(dead: DataFrame | None, sizes: Mapping[int, int], spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Gives tables of some segments (sizes: their documents, in order) without the dead documents, and the others' doc_id 0.. in order over all segments.

    No join of a table's rows with documents: who is dead is a bit, 64 words of them a row with the
    counts of the dead before each, and how many live before each 4,096 documents is known to the
    driver. So the broadcast table takes some two bits a document. Where nobody is dead, it has no words.
    """
    word, block = F.shiftright("doc_id", 6).bitwiseAND(63).cast("int"), F.shiftright("doc_id", BLOCK_BITS)
    bit = lambda of: F.call_function("shiftleft", F.lit(of).cast("long"), F.col("doc_id").bitwiseAND(63).cast("int"))
    words = spark.createDataFrame([], "_s int, _b long, _words array<long>, _ranks array<int>")
    if dead is not None:
        found = dead.where(F.col("segment").isin(*sizes)).groupBy(F.col("segment").alias("_s"), block.alias("_b"), word.alias("w")).agg(F.bit_or(bit(1)).alias("bits"))
        each = found.groupBy("_s", "_b").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
        each = each.select("_s", "_b", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("_words"))
        ranks = F.transform("_words", lambda _, i: F.aggregate(F.slice("_words", F.lit(1), i), F.lit(0), lambda a, w: a + F.bit_count(w)))
        words = each.withColumn("_ranks", ranks)
    gone = {(r[0], r[1]): r[2] for r in words.select("_s", "_b", F.aggregate("_words", F.lit(0), lambda a, w: a + F.bit_count(w))).collect()}
    starts, total = [], 0
    for segment, n in sizes.items():
        for b in range(-(-n >> BLOCK_BITS)):
            starts.append((segment, b, total))
            total += min(1 << BLOCK_BITS, n - (b << BLOCK_BITS)) - gone.get((segment, b), 0)
    blocks = spark.createDataFrame(starts, "_s int, _b long, _start long")
    if gone:
        blocks = blocks.join(words, ["_s", "_b"], "left")

    def again(df: DataFrame) -> DataFrame:
        own = df.join(F.broadcast(blocks), (F.col("segment") == F.col("_s")) & (block == F.col("_b")))
        at = F.col("_start") + F.col("doc_id").bitwiseAND((1 << BLOCK_BITS) - 1)
        if not gone:
            return own.withColumn("doc_id", at).drop("_s", "_b", "_start")
        mine = F.get("_words", word)
        live = own.where(F.col("_words").isNull() | (mine.bitwiseAND(bit(1)) == 0))
        before = F.coalesce(F.get("_ranks", word) + F.bit_count(mine.bitwiseAND(F.bitwise_not(bit(-1)))), F.lit(0))
        return live.withColumn("doc_id", at - before).drop("_s", "_b", "_start", "_words", "_ranks")

    return again


def validate(parts: dict[str, DataFrame], max_doc: int) -> list[str]:
    """What is wrong with a segment's tables, by aggregates over them; empty if nothing is."""
    p = parts["postings"]
    n = p.agg(
        F.count_if((F.col("doc_id") < 0) | (F.col("doc_id") >= max_doc)).alias("a document out of range"),
        F.count_if((F.col("tf") < 1) | ((F.size("positions") > 0) & (F.size("positions") != F.col("tf")))).alias("a frequency that isn't its positions"),
        F.count_if(F.when(F.size("positions") > 1, F.exists(F.sequence(F.lit(1), F.size("positions") - 1), lambda i: F.get("positions", i) <= F.get("positions", i - 1)))).alias("positions that don't rise"),
        F.count_if(F.coalesce(F.col("term"), F.lit("")) == "").alias("an empty term"),
    ).first()
    d = parts["stored"].agg(F.count("*"), F.countDistinct("doc_id")).first()
    wrong = [k for k, v in n.asDict().items() if v]
    return wrong + ["documents that aren't dense"] * (d[0] != max_doc or d[1] != max_doc)
