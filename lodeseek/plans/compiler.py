"""From a prefix-free or prefixed query to one DataFrame plan.

Leaves get slots: a term, each term of a phrase, a whole prefix. One filtered scan of
the postings meets a small broadcast table of the leaf terms (bounded by the query
and the prefix limit), gives each posting its score, and one aggregation by
document pivots the slots. Match and score are then Column expressions over the
slots, so the plan's width follows the query and not the expansion of prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError, TooManyTermsError
from .query import MATCH_NOTHING, BooleanClause, BooleanQuery, MatchAllQuery, Occur, PhraseQuery, PrefixQuery, Query, TermQuery

MAX_TERMS = 1024
DOC = ("segment", "doc_id")


def check_limit(max_terms: int) -> None:
    if isinstance(max_terms, bool) or not isinstance(max_terms, int) or max_terms < 1:
        raise ValueError("max_terms must be a positive integer")


def rewrite(query: Query, terms_with_prefix, max_terms: int = MAX_TERMS) -> Query:
    """Prefixes become the terms they stand for. terms_with_prefix(field, prefix, limit) gives sorted terms."""
    check_limit(max_terms)
    if isinstance(query, PrefixQuery):
        terms = terms_with_prefix(query.field, query.prefix, max_terms + 1)
        if len(terms) > max_terms:
            raise TooManyTermsError(query.field, query.prefix, max_terms)
        made = [TermQuery(query.field, t) for t in terms]
        if len(made) < 2:
            return made[0] if made else MATCH_NOTHING
        return BooleanQuery(tuple(BooleanClause(Occur.SHOULD, t) for t in made))
    if isinstance(query, BooleanQuery):
        return BooleanQuery(tuple(BooleanClause(c.occur, rewrite(c.query, terms_with_prefix, max_terms)) for c in query.clauses))
    if isinstance(query, (TermQuery, PhraseQuery, MatchAllQuery)):
        return query
    raise QueryError(f"unknown query: {query!r}")


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def _all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


def term_group(query: BooleanQuery) -> tuple[str, list[str]] | None:
    """A disjunction of plain terms of one field, as prefixes become: it can share one slot."""
    c = query.clauses
    if len(c) > 8 and all(x.occur is Occur.SHOULD and isinstance(x.query, TermQuery) for x in c):
        terms = [x.query.term for x in c]
        if len({x.query.field for x in c}) == 1 and terms == sorted(set(terms)):
            return c[0].query.field, terms
    return None


@dataclass
class Slots:
    """Leaf terms by slot, and how each slot is aggregated."""

    leaves: list[tuple[str, str, int]] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)

    def add(self, name: str, terms: list[str], kind: str) -> int:
        slot = len(self.kinds)
        self.kinds.append(kind)
        self.leaves.extend((name, t, slot) for t in terms)
        return slot


def _compile(query: Query, slots: Slots) -> tuple[Column, Column]:
    """(matches, score where it matches) over the slots' columns."""
    zero = F.lit(0.0)
    if isinstance(query, MatchAllQuery):
        return F.lit(True), zero
    if isinstance(query, TermQuery):
        s = F.col(f"s{slots.add(query.field, [query.term], 'term')}")
        return s.isNotNull(), F.coalesce(s, zero)
    if isinstance(query, PhraseQuery):
        own = [slots.add(query.field, [t], "phrase") for t in query.terms]
        first = F.col(f"p{own[0]}")
        ok = F.exists(first, lambda x: _all([F.array_contains(F.col(f"p{i}"), x + gap) for i, gap in zip(own[1:], query.places[1:], strict=True)] or [F.lit(True)]))
        ok = F.coalesce(_all([F.col(f"s{i}").isNotNull() for i in own]) & ok, F.lit(False))
        return ok, reduce(lambda a, i: a + F.coalesce(F.col(f"s{i}"), zero), own, zero)
    if isinstance(query, BooleanQuery):
        if group := term_group(query):
            s = F.col(f"s{slots.add(group[0], group[1], 'terms')}")
            return s.isNotNull(), F.coalesce(s, zero)
        parts = [(c.occur, *_compile(c.query, slots)) for c in query.clauses]
        of = lambda occur: [m for o, m, _ in parts if o is occur]
        must, should, never = of(Occur.MUST), of(Occur.SHOULD), of(Occur.MUST_NOT)
        ok = _all(must) if must else _any(should) if should else F.lit(False)
        if never:
            ok = ok & ~_any(never)
        score = reduce(lambda a, x: a + F.when(x[1], x[2]).otherwise(zero), [p for p in parts if p[0] is not Occur.MUST_NOT], zero)
        return ok, score
    raise QueryError(f"unknown query: {query!r}")


def positive_match_all(query: Query) -> bool:
    """Whether documents without any leaf term could match."""
    if isinstance(query, MatchAllQuery):
        return True
    if isinstance(query, BooleanQuery):
        return any(positive_match_all(c.query) for c in query.clauses if c.occur is not Occur.MUST_NOT)
    return False


def matching_nothing(query: Query) -> bool:
    """Decided without data: only MUST_NOT clauses, or a MUST that matches nothing."""
    if not isinstance(query, BooleanQuery):
        return False
    must = [c.query for c in query.clauses if c.occur is Occur.MUST]
    should = [c.query for c in query.clauses if c.occur is Occur.SHOULD]
    return any(map(matching_nothing, must)) or (not must and all(map(matching_nothing, should)))


def scored(spark: SparkSession, query: Query, postings: DataFrame, live: DataFrame, weights) -> DataFrame:
    """segment, doc_id, score of all matches of a rewritten query.

    postings, live: without deleted documents. weights(pairs) gives a function of
    (field, term) to (idf, boost, avgdl), and similarity(idf, tf, dl, avgdl).
    """
    return scored_many(spark, {"": query}, postings, live, weights).select(*DOC, "score")


def scored_many(spark: SparkSession, queries: dict[str, Query], postings: DataFrame, live: DataFrame, weights) -> DataFrame:
    """query_id, segment, doc_id, score: one scan and one aggregation serve all the queries."""
    queries = {i: q for i, q in queries.items() if not matching_nothing(q)}
    if not queries:
        return live.select(F.lit("").alias("query_id"), *DOC, F.lit(0.0).alias("score")).where(F.lit(False))
    slots = Slots()
    compiled = {i: _compile(q, slots) for i, q in queries.items()}
    pivot = _pivot(spark, slots, postings, weights) if slots.leaves else None
    if any(map(positive_match_all, queries.values())):
        pivot = live.select(*DOC) if pivot is None else live.select(*DOC).join(pivot, list(DOC), "left")
    elif pivot is None:
        pivot = live.select(*DOC)
    if len(compiled) == 1:
        ((i, (ok, score)),) = compiled.items()
        return pivot.where(F.coalesce(ok, F.lit(False))).select(F.lit(i).alias("query_id"), *DOC, score.alias("score"))
    each = F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(i).alias("query_id"), score.alias("score"))) for i, (ok, score) in compiled.items()])
    return pivot.select(*DOC, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.query_id", *DOC, "x.score")


def _pivot(spark: SparkSession, slots: Slots, postings: DataFrame, weights) -> DataFrame:
    weigh, similarity = weights({(f, t) for f, t, _ in slots.leaves})
    rows = [(f, t, s, *weigh(f, t)) for f, t, s in slots.leaves]
    leaf = spark.createDataFrame(rows, "l_field string, l_term string, slot int, idf double, boost double, avgdl double")
    by_field: dict[str, set[str]] = {}
    for f, t, _ in slots.leaves:
        by_field.setdefault(f, set()).add(t)
    # the join alone would prune nothing: these reach the scan
    found = postings.where(_any([(F.col("field") == f) & F.col("term").isin(*sorted(t)) for f, t in sorted(by_field.items())]))
    j = found.join(F.broadcast(leaf), (F.col("field") == F.col("l_field")) & (F.col("term") == F.col("l_term")))
    j = j.withColumn("w", F.col("boost") * similarity(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl")))
    aggs = []
    for i, kind in enumerate(slots.kinds):
        mine = F.col("slot") == i
        if kind == "terms":  # added in the order of terms, as their disjunction would be
            each = F.array_sort(F.collect_list(F.when(mine, F.struct("term", "w"))))
            aggs.append(F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x["w"])).alias(f"s{i}"))
        else:
            aggs.append(F.max(F.when(mine, F.col("w"))).alias(f"s{i}"))
        if kind == "phrase":
            aggs.append(F.max(F.when(mine, F.col("positions"))).alias(f"p{i}"))
    return j.groupBy(*DOC).agg(*aggs)
