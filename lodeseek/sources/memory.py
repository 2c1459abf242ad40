"""An index that lives in the session only."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.snapshot import IndexSnapshot, TopDocs
from ..plans.query import Query
from ..schema import Schema


class MemoryIndex:
    def __init__(self, spark: SparkSession, schema: Schema):
        self.spark, self.schema, self._docs, self._made = spark, schema, [], None

    def add_document(self, **values: object) -> int:
        self._docs.append(self.schema.check_document(values))
        self._made = None
        return len(self._docs) - 1

    def snapshot(self) -> IndexSnapshot:
        if self._made is None:
            names = list(self.schema)
            rows = [(i, *(d.get(n) for n in names)) for i, d in enumerate(self._docs)]
            df = self.spark.createDataFrame(rows, ", ".join(["_id long", *(f"`{n}` string" for n in names)]))
            self._made = IndexSnapshot.of_documents(df, self.schema, id_col="_id").cache()
        return self._made

    def search(self, query: Query, top_k: int = 10) -> TopDocs:
        return self.snapshot().search(query, top_k)

    def search_text(self, source: str, default_field: str, top_k: int = 10) -> TopDocs:
        return self.snapshot().search_text(source, default_field, top_k)
