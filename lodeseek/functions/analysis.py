"""Text to terms, twice: as Column expressions for data and as Python for query texts.

A token is (term, position, start, end); positions count before stop words go, so
gaps stay; offsets are characters. Words are runs of letters, numbers and
underscores as Unicode has them, by the same classes in both forms. Lower-casing
comes after cutting, for it may change lengths.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
OTHER = r"[^\p{L}\p{N}_]+"
#: The stop words of the standard analyzer.
STOPWORDS = frozenset({"the"})
BLOCK = 16
#: Between the words of a joined text; in no word.
JOINT = "\0"
PYTHON_CHARS = 1 << 18
TOKEN_TYPE = "array<struct<term:string,position:int,start:int,end:int>>"
TERM_TYPE = "array<struct<term:string,position:int>>"


@dataclass(frozen=True)
class Token:
    term: str
    position: int
    start: int
    end: int

    def __post_init__(self) -> None:
        if not self.term or self.position < 0 or self.start < 0 or self.end < self.start:
            raise ValueError("a token needs a term, and a position and offsets in order")


class Tokenizer(Protocol):
    def tokenize(self, text: str) -> Iterable[Token]: ...

    def column(self, text: Column) -> Column: ...


class TokenFilter(Protocol):
    def apply(self, tokens: Iterable[Token]) -> Iterable[Token]: ...

    def column(self, tokens: Column) -> Column: ...


def _word_char(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def _token(term: Column, position: Column, start: Column, end: Column) -> Column:
    return F.struct(term.alias("term"), position.cast("int").alias("position"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, n: a + n)


def _sums(values: Column, size: int) -> Column:
    """Of each size values."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(size)), lambda at: _total(F.slice(values, at + 1, size)))


def _before(values: Column) -> Column:
    """Of each value the sum of those before it. Arrays are copied when they grow, so only one of a 4,096th of their number grows."""
    def upto(sums: Column, i: Column, size: int) -> Column:
        return _total(F.slice(sums, F.floor(i / size).cast("int") * size + 1, i % size))

    def scan(a: Column, n: Column) -> Column:
        return F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    far = lambda wide: F.aggregate(_sums(wide, 64), empty, scan, lambda a: a["out"])
    each = lambda wide, far: F.transform(values, lambda _, i: F.get(far, F.floor(i / 4096).cast("int")) + upto(wide, F.floor(i / 64).cast("int"), 64) + upto(values, i, 64))
    return bound(_sums(values, 64), lambda wide: bound(far(wide), lambda far: each(wide, far)))


class StandardTokenizer:
    def tokenize(self, text: str) -> list[Token]:
        out, start = [], None
        for i, c in enumerate(text + " "):
            if _word_char(c):
                start = i if start is None else start
            elif start is not None:
                out.append(Token(text[start:i], len(out), start, i))
                start = None
        return out

    def column(self, text: Column) -> Column:
        """Offsets are running sums over gaps and words: within a block of BLOCK words, and over blocks."""
        words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)

        def placed(x: Column) -> Column:
            words, lengths = x["w"], x["n"]

            def tokens(starts: Column) -> Column:
                def token(w: Column, i: Column) -> Column:
                    block = F.floor(i / BLOCK).cast("int")
                    end = F.get(starts, block) + _total(F.slice(lengths, block * BLOCK + 1, i % BLOCK + 1))
                    return bound(end, lambda e: _token(w, i, e - F.length(w), e))

                return F.transform(words, token)

            return bound(bound(_sums(lengths, BLOCK), _before), tokens)

        # after the last word there is a gap more
        lengths = lambda w, g: F.zip_with(w, F.slice(g, 1, F.size(w)), lambda w, g: F.length(w) + F.length(g))
        pair = bound(F.struct(words.alias("w"), gaps.alias("g")), lambda x: F.struct(x["w"].alias("w"), lengths(x["w"], x["g"]).alias("n")))
        return F.when(text.isNotNull(), bound(pair, placed))

    def joined(self, text: Column) -> Column:
        """The words with one JOINT between them, and one before or after them where the text has other characters there."""
        return F.regexp_replace(text, OTHER, JOINT)

    def terms(self, text: Column, of: Callable[[Column], Column]) -> Column:
        """of(word) and positions only: what the index needs, in time proportional to the text."""
        return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w, i: F.struct(of(w).alias("term"), i.alias("position")))


class KeywordTokenizer:
    def tokenize(self, text: str) -> list[Token]:
        return [Token(text, 0, 0, len(text))] if text else []

    def column(self, text: Column) -> Column:
        return F.when(text != "", F.array(_token(text, F.lit(0), F.lit(0), F.length(text)))).otherwise(F.array().cast(TOKEN_TYPE))

    def terms(self, text: Column, of: Callable[[Column], Column]) -> Column:
        return F.when(text != "", F.array(F.struct(of(text).alias("term"), F.lit(0).alias("position")))).otherwise(F.array().cast(TERM_TYPE))


class LowercaseFilter:
    def apply(self, tokens: Iterable[Token]) -> list[Token]:
        return [Token(t.term.lower(), t.position, t.start, t.end) for t in tokens]

    def word(self, term: Column) -> Column:
        return F.lower(term)

    def joined(self, text: Column) -> Column:
        return F.lower(text)

    def column(self, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: t.withField("term", self.word(t["term"])))


class StopwordFilter:
    def __init__(self, stopwords: Iterable[str]):
        self.stopwords = frozenset(stopwords)

    def apply(self, tokens: Iterable[Token]) -> list[Token]:
        return [t for t in tokens if t.term not in self.stopwords]

    def column(self, tokens: Column) -> Column:
        return F.filter(tokens, lambda t: ~t["term"].isin(*sorted(self.stopwords))) if self.stopwords else tokens


class Analyzer:
    """A tokenizer, then filters in order."""

    def __init__(self, tokenizer: Tokenizer, filters: Iterable[TokenFilter] = ()):
        self.tokenizer, self.filters = tokenizer, tuple(filters)

    def analyze(self, text: str) -> tuple[Token, ...]:
        return tuple(reduce(lambda tokens, f: f.apply(tokens), self.filters, self.tokenizer.tokenize(text)))

    def column(self, text: Column) -> Column:
        """An array of tokens; null for null."""
        return reduce(lambda tokens, f: f.column(tokens), self.filters, self.tokenizer.column(text))

    def joined(self, text: Column) -> tuple[Column, frozenset[str]] | None:
        """The terms as one string, JOINT between them, and those that are to be left out when positions have been counted; None where filters don't allow it."""
        n = next((i for i, f in enumerate(self.filters) if not hasattr(f, "joined")), len(self.filters))
        if not hasattr(self.tokenizer, "joined") or not all(type(f) is StopwordFilter for f in self.filters[n:]):
            return None
        return reduce(lambda t, f: f.joined(t), self.filters[:n], self.tokenizer.joined(text)), frozenset().union(*(f.stopwords for f in self.filters[n:]))

    def terms(self, text: Column) -> Column:
        """An array of (term, position), without offsets. First filters that change single words do so as these are cut: each pass over an array of structs costs more than the cutting."""
        if not hasattr(self.tokenizer, "terms"):
            return F.transform(self.column(text), lambda t: F.struct(t["term"].alias("term"), t["position"].cast("int").alias("position")))
        n = next((i for i, f in enumerate(self.filters) if not hasattr(f, "word")), len(self.filters))
        made = self.tokenizer.terms(text, lambda w: reduce(lambda w, f: f.word(w), self.filters[:n], w))
        return reduce(lambda tokens, f: f.column(tokens), self.filters[n:], made)


def python_column(analyzer: Analyzer, text: Column) -> Column:
    """Tokens of an analyzer with stages that have no Column form, by an Arrow-batched UDF.

    A batch's texts are analyzed and sent back some PYTHON_CHARS at a time, for tokens take a hundred times the memory of their characters.
    """
    most = PYTHON_CHARS

    def analyze(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made, chars = [], 0
            for t in texts:
                made.append(None if t is None else [(x.term, x.position, x.start, x.end) for x in analyzer.analyze(t)])
                chars += 0 if t is None else len(t)
                if chars >= most:
                    yield pd.Series(made)
                    made, chars = [], 0
            if made:
                yield pd.Series(made)

    return F.pandas_udf(analyze, TOKEN_TYPE)(text)


def StandardAnalyzer(stopwords: Iterable[str] = STOPWORDS) -> Analyzer:
    return Analyzer(StandardTokenizer(), (LowercaseFilter(), StopwordFilter(stopwords)))


def KeywordAnalyzer() -> Analyzer:
    return Analyzer(KeywordTokenizer())


ANALYZERS: dict[str, Callable[[], Analyzer]] = {"standard": StandardAnalyzer, "keyword": KeywordAnalyzer}


def analyzer_named(name: str) -> Analyzer:
    if name not in ANALYZERS:
        raise ValueError(f"unknown analyzer: {name}")
    return ANALYZERS[name]()
