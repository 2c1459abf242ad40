"""Matched words and phrases in <em> marks, all else HTML-escaped, as a Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import BooleanQuery, Occur, PhraseQuery, Query, TermQuery
from ..schema import Schema
from .analysis import STOPWORDS, WORD, bound

#: Characters and what stands for them in HTML, the ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def check_fields(schema: Schema, names: tuple[str, ...]) -> None:
    if len(set(names)) != len(names):
        raise ValueError("a field to highlight is named twice")
    for n in names:
        if n not in schema or not (schema[n].stored and schema[n].tokenized and schema[n].analyzer_name == "standard"):
            raise ValueError(f"only stored text fields can be highlighted: {n}")


def wanted(query: Query, field: str) -> tuple[set[str], list[PhraseQuery]]:
    """Terms and phrases of the field outside of what is forbidden."""
    if isinstance(query, TermQuery) and query.field == field:
        return {query.term}, []
    if isinstance(query, PhraseQuery) and query.field == field:
        return set(), [query]
    terms: set[str] = set()
    phrases: list[PhraseQuery] = []
    if isinstance(query, BooleanQuery):
        for c in query.clauses:
            if c.occur is not Occur.MUST_NOT:
                t, p = wanted(c.query, field)
                terms |= t
                phrases += p
    return terms, phrases


def escaped(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def highlight(text: Column, query: Query, field: str) -> Column:
    """query: rewritten. Null for null.

    Works on the text's words and the gaps between them, in one pass each; words have
    no sign that HTML would read. A word's number is its position, so a phrase's terms are looked up at
    their distances. Spans that share a word are one mark; others never touch, for a gap is between them.
    """
    terms, phrases = wanted(query, field)
    phrases = [p for p in phrases if not STOPWORDS.intersection(p.terms)]  # a stop word isn't indexed
    terms -= STOPWORDS

    def begins(low: Column, p: PhraseQuery) -> Callable[[Column, Column], Column]:
        return lambda w, i: reduce(lambda a, b: a & b, [F.coalesce(F.get(low, i + at) == term, F.lit(False)) for term, at in zip(p.terms, p.places, strict=True)])

    def marked(x: Column) -> Column:
        words, low, gaps = x["words"], x["low"], x["gaps"]
        found = [F.transform(low, begins(low, p)) for p in phrases]
        starts = F.struct(*[f.alias(f"p{k}") for k, f in enumerate(found)]) if found else F.struct(F.lit(0).alias("none"))

        def pieces(starts: Column) -> Column:
            def any_start(i: Column, from_: int) -> Column:
                """Whether a phrase that began up to the phrase's length less from_ words before covers word i, and from_ words after it."""
                seen = [F.coalesce(F.get(starts[f"p{k}"], i - back), F.lit(False)) & (i >= back) for k, p in enumerate(phrases) for back in range(p.places[-1] + 1 - from_)]
                return reduce(lambda a, b: a | b, seen, F.lit(False))

            def piece(w: Column, i: Column) -> Column:
                on = any_start(i, 0) | (F.get(low, i).isin(*sorted(terms)) if terms else F.lit(False))
                opened, closed = on & ~any_start(F.greatest(i - 1, F.lit(0)), 1), on & ~any_start(i, 1)
                opened = F.when(i == 0, on).otherwise(opened)
                return F.concat(escaped(F.get(gaps, i)), F.when(opened, "<em>").otherwise(""), w, F.when(closed, "</em>").otherwise(""))

            return F.concat(F.array_join(F.transform(words, piece), ""), escaped(F.get(gaps, F.size(words))))

        return bound(starts, pieces)

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    parts = bound(F.struct(words.alias("words"), F.split(text, WORD, -1).alias("gaps")), lambda x: F.struct(x["words"].alias("words"), F.transform(x["words"], F.lower).alias("low"), x["gaps"].alias("gaps")))
    return F.when(text.isNotNull(), bound(parts, marked))
