"""Documents from JSON, and relevance corpora: documents, queries and graded judgements that belong together."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import Schema


def read_documents(spark: SparkSession, path: str, schema: Schema, multi_line: bool = True) -> DataFrame:
    """JSON objects as documents; SchemaError where a field is unknown or isn't a string throughout."""
    rows = spark.read.option("multiLine", multi_line).json(path)
    schema.check_columns(rows.schema)
    return rows


@dataclass(frozen=True)
class JudgedQuery:
    id: str
    text: str
    default_field: str


@dataclass(frozen=True)
class RelevanceCorpus:
    documents: tuple[Mapping[str, str], ...]
    queries: tuple[JudgedQuery, ...]
    qrels: Mapping[str, Mapping[str, int]]

    def __post_init__(self) -> None:
        ids, names = [d["id"] for d in self.documents], [q.id for q in self.queries]
        if len(set(ids)) < len(ids) or len(set(names)) < len(names):
            raise ValueError("an id is used twice")
        if set(self.qrels) != set(names):
            raise ValueError("queries and judgements are not of the same ids")
        for q, grades in self.qrels.items():
            if not set(grades) <= set(ids):
                raise ValueError(f"unknown documents are judged for {q}")
            if any(isinstance(g, bool) or not isinstance(g, int) or g < 0 for g in grades.values()):
                raise ValueError(f"a grade of {q} isn't an integer of 0 or more")


def load(documents: Path, queries: Path, qrels: Path) -> RelevanceCorpus:
    """Three JSON files, of {"documents": [...]}, {"queries": [...]} and {"qrels": {query: {document: grade}}}."""
    read = lambda p: json.loads(Path(p).read_text(encoding="utf-8"))
    docs = read(documents)["documents"]
    if any(not isinstance(v, str) for d in docs for v in d.values()):
        raise ValueError("a document's field isn't a string")
    return RelevanceCorpus(tuple(docs), tuple(JudgedQuery(**q) for q in read(queries)["queries"]), read(qrels)["qrels"])
