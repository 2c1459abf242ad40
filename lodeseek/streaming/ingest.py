"""Continuous ingest: each micro-batch becomes one segment and one commit.

The commit's manifest holds the batch's number, so a batch is in together with
its number or not at all; one that comes again after a failure is passed over. A driver
that was killed leaves the writer's lock behind; the same stream, known by its checkpoint
(which Spark lets one query use at a time), takes it over.

Segments are merged as they gather: as soon as ``fan`` of them are of one size class, a
power of ``fan`` documents, they become one of the next. So an index of n batches
has some fan * log(n) segments, and a document is rewritten log(n) times.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Index
from ..sources.writer import IndexWriter

FAN = 8


def compact(writer: IndexWriter, fan: int = FAN) -> int:
    """How many merges were made."""
    sizes, made = {g: writer.index.segments.describe(g, deep=False)["max_doc"] for g in writer.segment_generations}, 0
    while True:
        classes: dict[int, list[int]] = defaultdict(list)
        for g in writer.segment_generations:
            size, level = sizes[g], 0
            while size >= fan:
                size, level = size // fan, level + 1
            classes[level].append(g)
        full = next((gs for _, gs in sorted(classes.items()) if len(gs) >= fan), None)
        if full is None:
            return made
        merged = writer.merge(full)
        sizes[merged.generation], made = merged.max_doc, made + 1


def add_batch(index: Index, rows: DataFrame, batch: int, owner: str | None = None, fan: int = FAN) -> bool:
    """Adds and commits a batch unless it, or a later one, is in already."""
    if batch <= index.manifest().batch:
        return False
    with index.writer(owner=owner) as w:
        w.add_dataframe(rows)
        compact(w, fan)
        w.commit(batch)
    return True


def start(stream: DataFrame, index: Index, checkpoint: str, trigger: dict | None = None, fan: int = FAN) -> StreamingQuery:
    """stream: the schema's string columns. Runs until stopped, or (by default) until what is there has been taken."""
    index.schema.check_columns(stream.schema)
    return stream.writeStream.foreachBatch(lambda rows, batch: add_batch(index, rows, batch, f"stream {checkpoint}", fan)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
