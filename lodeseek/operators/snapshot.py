"""A point in time of an index: its tables, statistics and searches.

Built from explicit frames (of fixed paths, or of the session), so later commits
don't show. Statistics are two small aggregates, kept on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import AlreadyClosedError
from ..functions.bm25 import BM25
from ..functions.highlight import check_fields, highlight
from ..plans import compiler
from ..plans.parser import parse_query
from ..plans.query import Query
from ..schema import Schema
from . import inversion, matching

DOC = ["segment", "doc_id"]


@dataclass(frozen=True)
class SearchHit:
    score: float
    segment_generation: int
    local_doc_id: int
    stored_fields: Mapping[str, str]
    highlights: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class TopDocs:
    total_hits: int
    hits: tuple[SearchHit, ...]


@dataclass(frozen=True)
class CorpusStats:
    live_docs: int
    average_lengths: Mapping[str, float]

    def average_length(self, name: str) -> float:
        return self.average_lengths.get(name, 0.0)


class IndexSnapshot:
    """tables: postings, norms, stored. deleted: segment, doc_id, or None. made: what postings and norms are both parts of, if it is one frame."""

    def __init__(self, schema: Schema, tables: Mapping[str, DataFrame], deleted: DataFrame | None = None, commit_generation: int | None = None, on_close=None, made: DataFrame | None = None):
        self.schema, self.commit_generation, self._tables, self._deleted, self._on_close = schema, commit_generation, dict(tables), deleted, on_close
        self.spark: SparkSession = tables["stored"].sparkSession
        self._closed, self._frequencies, self._made = False, {}, made

    @classmethod
    def of_documents(cls, docs: DataFrame, schema: Schema, id_col: str | None = None, segment: int = 0) -> IndexSnapshot:
        """An index in the session. docs: the schema's string columns, and a unique long id_col or else dense ids in order."""
        if id_col is None:
            schema.check_columns(docs.schema)
            d = inversion.dense_ids(inversion.numbered(inversion.named(docs)).cache())
            own = d.withColumn("segment", F.lit(segment))
            dealt = inversion.spread(own)
        else:
            schema.check_columns(docs.drop(id_col).schema)
            own, dealt = [x.select(F.lit(segment).alias("segment"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(f"f_{c}") for c in docs.columns if c != id_col]) for x in (docs, inversion.spread(docs))]
        made = inversion.blocks(inversion.with_all_fields(dealt, schema), schema)
        tables = {"postings": inversion.postings_in(made), "norms": inversion.norms_in(made), "stored": inversion.stored(inversion.with_all_fields(own, schema), schema)}
        return cls(schema, tables, made=made)

    def _kept(self, stored: bool = True) -> list[DataFrame]:
        inverted = [self._tables["postings"], self._tables["norms"]] if self._made is None else [self._made]
        return inverted + [self._tables["stored"]] * stored

    def cache(self, stored: bool = True) -> IndexSnapshot:
        """stored=False: texts that can be read again, as from files, aren't kept a second time."""
        for t in self._kept(stored):
            t.cache()
        return self

    def uncache(self) -> IndexSnapshot:
        for t in self._kept():
            t.unpersist()
        return self

    # lifecycle

    def _open(self) -> None:
        if self._closed:
            raise AlreadyClosedError("this reader is closed")

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            if self._on_close:
                self._on_close()

    def __enter__(self) -> IndexSnapshot:
        self._open()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # tables

    def _live(self, name: str) -> DataFrame:
        self._open()
        t = self._tables[name]
        return t if self._deleted is None else t.join(self._deleted, DOC, "left_anti")

    @property
    def all_postings(self) -> DataFrame:
        self._open()
        return self._tables["postings"]

    @property
    def live_postings(self) -> DataFrame:
        return self._live("postings")

    @property
    def norms(self) -> DataFrame:
        return self._live("norms")

    @property
    def documents(self) -> DataFrame:
        return self._live("stored")

    def postings(self, name: str, term: str) -> DataFrame:
        return self.live_postings.where((F.col("field") == name) & (F.col("term") == term)).select(*DOC, "tf", "positions")

    def term_dictionary(self, name: str, prefix: str = "") -> DataFrame:
        """Distinct terms of all segments, deleted documents' included."""
        return self.all_postings.where((F.col("field") == name) & F.col("term").startswith(prefix)).select("term").distinct()

    def terms_with_prefix(self, name: str, prefix: str, limit: int | None = None) -> list[str]:
        found = self.term_dictionary(name, prefix).orderBy("term")
        return [r[0] for r in (found.limit(limit) if limit else found).collect()]

    def document(self, segment: int, doc_id: int) -> dict[str, str]:
        here = (F.col("segment") == segment) & (F.col("doc_id") == doc_id)
        row = self.documents.where(here).first()
        if row is None:
            gone = self._tables["stored"].where(here).first() is not None
            raise KeyError(f"deleted: {segment}/{doc_id}") if gone else IndexError(f"no such document: {segment}/{doc_id}")
        return {n: row[f"f_{n}"] for n in self.schema.stored if row[f"f_{n}"] is not None}

    def field_length(self, name: str, segment: int, doc_id: int) -> int:
        row = self.norms.where((F.col("field") == name) & (F.col("segment") == segment) & (F.col("doc_id") == doc_id)).first()
        return row["length"] if row else 0

    # statistics

    @cached_property
    def _lengths(self) -> dict[str, tuple[int, int, int]]:
        """By indexed field: summed lengths, documents with a length, live documents."""
        return {r[0]: tuple(r[1:]) for r in self.norms.groupBy("field").agg(F.sum("length"), F.count_if(F.col("length") > 0), F.count("*")).collect()}

    @cached_property
    def num_live_docs(self) -> int:
        """By the norms, which are narrow and have a row for each document and indexed field."""
        return max((n for _, _, n in self._lengths.values()), default=0) if self.schema.indexed else self.documents.count()

    @cached_property
    def max_doc(self) -> int:
        self._open()
        return self._tables["stored"].count()

    @cached_property
    def stats(self) -> CorpusStats:
        return CorpusStats(self.num_live_docs, {f: s / n for f, (s, n, _) in self._lengths.items() if n})

    def doc_frequencies(self, pairs: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Live documents with each (field, term): one job for those not asked for before."""
        new = pairs - self._frequencies.keys()
        if new:
            by_field: dict[str, list[str]] = {}
            for f, t in sorted(new):
                by_field.setdefault(f, []).append(t)
            pick = compiler._any([(F.col("field") == f) & F.col("term").isin(*t) for f, t in by_field.items()])
            got = {(r[0], r[1]): r[2] for r in self.live_postings.where(pick).groupBy("field", "term").count().collect()}
            self._frequencies.update({p: got.get(p, 0) for p in new})
        return {p: self._frequencies[p] for p in pairs}

    def _weights(self, similarity):
        def weights(pairs):
            for f, _ in pairs:
                self.schema[f]  # an unknown field can't be scored
            df, stats = self.doc_frequencies(pairs), self.stats
            return lambda f, t: (similarity.idf(df[f, t], stats.live_docs), self.schema[f].boost, stats.average_length(f)), similarity.column

        return weights

    # search

    def rewrite(self, query: Query, max_terms: int = compiler.MAX_TERMS) -> Query:
        return compiler.rewrite(query, self.terms_with_prefix, max_terms)

    def match(self, query: Query) -> DataFrame:
        """segment, doc_id of all matches, by joins and set operations."""
        return matching.match(query, self.live_postings, self.documents)

    def score_by_joins(self, query: Query, similarity=None) -> DataFrame:
        query = self.rewrite(query)
        sim = similarity or BM25()

        def weigh(f, t):
            return self._weights(sim)({(f, t)})[0](f, t)

        return matching.score(query, self.live_postings, self.documents, weigh, sim.column)

    def scored(self, query: Query, similarity=None, max_terms: int = compiler.MAX_TERMS) -> DataFrame:
        """segment, doc_id, score of all matches."""
        return compiler.scored(self.spark, self.rewrite(query, max_terms), self.live_postings, self.documents, self._weights(similarity or BM25()))

    def top(self, query: Query, top_k: int = 10, similarity=None) -> DataFrame:
        """The top_k matches, best first; ties by segment, then document."""
        return self.scored(query, similarity).orderBy(F.desc("score"), "segment", "doc_id").limit(top_k)

    def fetched(self, winners: DataFrame, query: Query | None = None, highlight_fields: tuple[str, ...] = ()) -> DataFrame:
        """Stored fields f_NAME (and highlights _em_NAME) of some winners: the narrow side, at most top_k rows, is broadcast."""
        out = self.documents.join(F.broadcast(winners), DOC)
        return out.select("score", *DOC, *[F.col(f"`f_{n}`") for n in self.schema.stored], *[highlight(F.col(f"`f_{n}`"), query, n).alias(f"_em_{n}") for n in highlight_fields])

    def search(self, query: Query, top_k: int = 10, highlight_fields: tuple[str, ...] = (), similarity=None) -> TopDocs:
        self._open()
        if not isinstance(top_k, int) or top_k < 0:
            raise ValueError("top_k must be an integer of 0 or more")
        check_fields(self.schema, tuple(highlight_fields))
        query = self.rewrite(query)
        found = self.scored(query, similarity)
        if top_k == 0:
            return TopDocs(found.count(), ())
        # hits are counted as they pass by on the way to the top
        seen = Observation()
        top = found.observe(seen, F.count("*").alias("n"), F.count_if(F.isnan("score") | (F.abs("score") == float("inf"))).alias("bad")).orderBy(F.desc("score"), *DOC).limit(top_k).collect()
        counts = seen.get if top else {"n": 0, "bad": 0}
        if counts["bad"]:
            raise ValueError("a score isn't finite")
        if not top:
            return TopDocs(0, ())
        winners = self.spark.createDataFrame(top, "segment int, doc_id long, score double")
        rows = self.fetched(winners, query, tuple(highlight_fields)).collect()
        rows.sort(key=lambda r: (-r["score"], r["segment"], r["doc_id"]))
        some = lambda r, names, mark="f_": {n: r[mark + n] for n in names if r[mark + n] is not None}
        return TopDocs(counts["n"], tuple(SearchHit(r["score"], r["segment"], r["doc_id"], some(r, self.schema.stored), some(r, highlight_fields, "_em_")) for r in rows))

    def search_text(self, source: str, default_field: str, top_k: int = 10, highlight_fields: tuple[str, ...] = ()) -> TopDocs:
        return self.search(parse_query(source, self.schema, default_field), top_k, highlight_fields)

    def batch_top(self, queries: Mapping[str, Query], top_k: int = 10) -> DataFrame:
        """query_id, segment, doc_id, score, rank for many queries: one scan for all, then a ranking window."""
        rewritten = {i: self.rewrite(q) for i, q in sorted(queries.items())}
        every = compiler.scored_many(self.spark, rewritten, self.live_postings, self.documents, self._weights(BM25()))
        w = W.partitionBy("query_id").orderBy(F.desc("score"), *DOC)
        return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
