"""Best-fit decreasing packing of tokenized documents into fixed windows.

Each partition is packed by itself, so there is no shuffle; small partitions are
put together first, until there are ``PART_TOKENS`` for each, by the measured size of
the table (a pass over the texts' lengths). So what the ends of partitions leave
open doesn't grow with their number. A partition's rows are tokenized as they stream by, overlong documents are first cut into full
windows (each a sequence of its own), and the rest pieces are kept until
``bin_tokens`` of them are there. They are then placed, longest first, into the
open window with the least capacity that still suffices; a segment tree indexed
by remaining capacity finds it. Memory holds at most one bin and one document.

Nulls: a null text counts as empty; its document is the end id alone. A null
document id is carried through. Extra columns are ignored, whatever their names. Repeated
rows are packed as often as they occur. Pieces of equal length are placed by document id,
then start. A very long text is tokenized whole. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ready, table

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


#: About so many ids for each partition that is packed by itself: 1,000 windows of 2,048, of which its end leaves one or two open.
PART_TOKENS = 2_000_000


class CapacityTree:
    """Segment tree over capacities 0..window: which have an open window, and the least such one from a given length on."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def push(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def pop_tightest(self, length: int) -> tuple[int, int] | None:
        """(capacity, window id) of the tightest open window that holds length, taken out; None if there is none."""
        count, i = self.count, length + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until a right sibling has an open window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(window number, offset) of each length, and how many windows were opened."""
    tree, where, offset, opened = CapacityTree(window), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.pop_tightest(lengths[i])
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, where[i] = found
        offset[i] = window - capacity
        if capacity > lengths[i]:
            tree.push(capacity - lengths[i], where[i])
    return where, offset, opened


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, as tokenizers gives them for byte_bpe_50k.json.

    The same vocabulary is also there as ranks for tiktoken, which is four times
    as fast and gives the same ids; a text with a special token's string goes to
    tokenizers, which knows it. Any other vocabulary is left to tokenizers.
    """
    exact = lambda text: np.array(tokenizer_of(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    if path != str(public_tokenizers.path("byte_bpe_50k.json")):
        return exact
    import tiktoken

    with open(path) as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: exact(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), dtype="<u4")


def packer(window: int, end_id: int, path: str, bin_tokens: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], dtype="<u4")
        base, ready_rows, pending, held, rows_tokens = TaskContext.get().partitionId() << 40, [], [], 0, 0

        def flush():
            nonlocal base, pending, held
            pending.sort(key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]))
            where, offset, opened = best_fit_decreasing([p[2] for p in pending], window)
            ready_rows.extend((*p, base + w, o) for p, w, o in zip(pending, where, offset, strict=True))
            base, pending, held = base + opened, [], 0

        def out():
            nonlocal ready_rows, rows_tokens
            cols = list(zip(*ready_rows, strict=True)) if ready_rows else [()] * len(ARROW)
            ready_rows, rows_tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, ARROW.types, strict=True)], schema=ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encode(text or ""), end))
                n = len(ids)
                full = n - n % window
                for s in range(0, full, window):
                    ready_rows.append((doc, s, window, ids[s : s + window].tobytes(), n, base, 0))
                    base += 1
                if full < n:
                    pending.append((doc, full, n - full, ids[full:].tobytes(), n))
                    held += n - full
                rows_tokens += full
                if held >= bin_tokens:
                    flush()
                if len(ready_rows) >= 5000 or rows_tokens >= bin_tokens:
                    yield out()
        flush()
        yield out()

    return run


def partitions_for(rows: DataFrame, text: str, per: int) -> int:
    """How many partitions of per ids the rows can fill: about 4 bytes an id, and each document's end."""
    n = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    return max(1, (n["bytes"] // 4 + n["rows"]) // per)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, tokenizer: str | None = None, bin_tokens: int = 8_000_000) -> DataFrame:
    """One row per piece: its ids (little-endian uint32), where it lies in its document and in its sequence."""
    ready(df.sparkSession)
    path = str(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    rows = df.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t"))
    rows = rows.coalesce(partitions_for(rows, "_t", min(bin_tokens, PART_TOKENS)))
    return rows.mapInArrow(packer(window, end_id, path, bin_tokens), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
