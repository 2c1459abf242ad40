"""Query objects: term, phrase, prefix, match-all and boolean."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from ..errors import QueryError


class Query:
    """Any of the classes below."""


class Occur(Enum):
    MUST = "MUST"
    SHOULD = "SHOULD"
    MUST_NOT = "MUST_NOT"


def _filled(value: object, what: str) -> None:
    if not isinstance(value, str) or not value:
        raise QueryError(f"{what} must be a string that isn't empty")


@dataclass(frozen=True)
class TermQuery(Query):
    """Documents with exactly this term, as it is indexed."""

    field: str
    term: str

    def __post_init__(self) -> None:
        _filled(self.field, "a query's field")
        _filled(self.term, "a term")


@dataclass(frozen=True)
class PhraseQuery(Query):
    """Terms at given distances from the first; one after the other by default."""

    field: str
    terms: tuple[str, ...]
    positions: tuple[int, ...] | None = None
    slop: int = 0

    def __post_init__(self) -> None:
        _filled(self.field, "a query's field")
        object.__setattr__(self, "terms", tuple(self.terms))
        if not self.terms:
            raise QueryError("a phrase needs a term")
        for t in self.terms:
            _filled(t, "a phrase's term")
        if self.slop != 0 or isinstance(self.slop, bool):
            raise QueryError("only a slop of 0 is known")
        if self.positions is not None:
            p = tuple(self.positions)
            object.__setattr__(self, "positions", p)
            if len(p) != len(self.terms) or any(isinstance(x, bool) or not isinstance(x, int) for x in p) or p[0] != 0 or any(a >= b for a, b in zip(p, p[1:], strict=False)):
                raise QueryError("positions must begin at 0 and rise, one for each term")

    @property
    def places(self) -> tuple[int, ...]:
        return tuple(range(len(self.terms))) if self.positions is None else self.positions


@dataclass(frozen=True)
class PrefixQuery(Query):
    """Documents with any term that begins so."""

    field: str
    prefix: str

    def __post_init__(self) -> None:
        _filled(self.field, "a query's field")
        _filled(self.prefix, "a prefix")


@dataclass(frozen=True)
class MatchAllQuery(Query):
    """All documents, at a score of 0."""


@dataclass(frozen=True)
class BooleanClause:
    occur: Occur
    query: Query

    def __post_init__(self) -> None:
        if not isinstance(self.occur, Occur):
            raise QueryError("a clause needs an Occur")
        if not isinstance(self.query, Query):
            raise QueryError("a clause needs a query")


@dataclass(frozen=True)
class BooleanQuery(Query):
    """All MUST; without any, at least one SHOULD; never a MUST_NOT. MUST_NOT alone match nothing."""

    clauses: tuple[BooleanClause, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "clauses", tuple(self.clauses))
        if not self.clauses:
            raise QueryError("a boolean query needs a clause")
        if any(not isinstance(c, BooleanClause) for c in self.clauses):
            raise QueryError("a boolean query is made of clauses")


#: What no document matches.
MATCH_NOTHING = BooleanQuery((BooleanClause(Occur.MUST_NOT, MatchAllQuery()),))


def leaves(query: Query) -> list[Query]:
    """Leaf queries from left to right, repeats included."""
    return [x for c in query.clauses for x in leaves(c.query)] if isinstance(query, BooleanQuery) else [query]
