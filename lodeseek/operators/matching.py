"""Queries by joins and set operations: a second way to the same matches and scores.

Every node becomes a DataFrame of documents, as cursors would walk them:
conjunction is an inner join, disjunction a union with an aggregation, exclusion a
left anti join. It serves as a check on the pivot plan and as operators of their
own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.query import BooleanQuery, MatchAllQuery, Occur, PhraseQuery, PrefixQuery, Query, TermQuery

DOC = ["segment", "doc_id"]


def conjunction(parts: list[DataFrame]) -> DataFrame:
    """Documents in all of the parts; none of no parts."""
    if not parts:
        raise ValueError("a conjunction of nothing has no documents to take them from")
    return reduce(lambda a, b: a.join(b.select(*DOC).distinct(), DOC, "left_semi"), parts[1:], parts[0].select(*DOC).distinct())


def disjunction(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*DOC) for p in parts]).distinct()


def excluding(required: DataFrame, excluded: DataFrame) -> DataFrame:
    return required.join(excluded.select(*DOC), DOC, "left_anti")


def term_documents(postings: DataFrame, field: str, term: str) -> DataFrame:
    return postings.where((F.col("field") == field) & (F.col("term") == term)).select(*DOC, "tf", "positions", "dl")


def phrase_documents(postings: DataFrame, q: PhraseQuery) -> DataFrame:
    parts = [term_documents(postings, q.field, t).select(*DOC, F.col("positions").alias(f"p{i}")) for i, t in enumerate(q.terms)]
    j = reduce(lambda a, b: a.join(b, DOC), parts)
    inside = lambda x: reduce(lambda a, b: a & b, [F.array_contains(F.col(f"p{i}"), x + g) for i, g in enumerate(q.places)])
    return j.where(F.exists("p0", inside)).select(*DOC)


def match(query: Query, postings: DataFrame, live: DataFrame) -> DataFrame:
    """The documents that match."""
    if isinstance(query, MatchAllQuery):
        return live.select(*DOC)
    if isinstance(query, TermQuery):
        return term_documents(postings, query.field, query.term).select(*DOC)
    if isinstance(query, PhraseQuery):
        return phrase_documents(postings, query)
    if isinstance(query, PrefixQuery):
        return postings.where((F.col("field") == query.field) & F.col("term").startswith(query.prefix)).select(*DOC).distinct()
    if isinstance(query, BooleanQuery):
        of = lambda occur: [match(c.query, postings, live) for c in query.clauses if c.occur is occur]
        must, should, never = of(Occur.MUST), of(Occur.SHOULD), of(Occur.MUST_NOT)
        if not must and not should:
            return live.select(*DOC).where(F.lit(False))
        found = conjunction(must) if must else disjunction(should)
        return excluding(found, disjunction(never)) if never else found
    raise QueryError(f"unknown query: {query!r}")


def score(query: Query, postings: DataFrame, live: DataFrame, weigh, similarity) -> DataFrame:
    """Matches with scores, each child's added in clause order where it matches."""
    if isinstance(query, MatchAllQuery):
        return live.select(*DOC, F.lit(0.0).alias("score"))
    if isinstance(query, TermQuery):
        idf, boost, avgdl = weigh(query.field, query.term)
        s = F.lit(boost) * similarity(F.lit(idf), F.col("tf"), F.col("dl"), F.lit(avgdl))
        return term_documents(postings, query.field, query.term).select(*DOC, s.alias("score"))
    if isinstance(query, PhraseQuery):
        parts = [score(TermQuery(query.field, t), postings, live, weigh, similarity) for t in query.terms]
        return _added(phrase_documents(postings, query), parts)
    if isinstance(query, BooleanQuery):
        parts = [score(c.query, postings, live, weigh, similarity) for c in query.clauses if c.occur is not Occur.MUST_NOT]
        return _added(match(query, postings, live), parts)
    raise QueryError(f"can't score: {query!r}")


def _added(found: DataFrame, parts: list[DataFrame]) -> DataFrame:
    out = found.withColumn("score", F.lit(0.0))
    for p in parts:
        out = out.join(p.withColumnRenamed("score", "_s"), DOC, "left").select(*DOC, (F.col("score") + F.coalesce("_s", F.lit(0.0))).alias("score"))
    return out
