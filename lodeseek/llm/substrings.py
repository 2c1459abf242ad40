"""Exact substring deduplication by prefix-free parsing.

Every byte is removed that is covered by a string of ``LENGTH`` bytes which also
starts earlier: in a document with a smaller id, or earlier in the same one.
Strings never cross documents and are judged on the input.

Parsing. A rolling hash is taken of each ``GRAM`` bytes. In each window of ``LENGTH``
bytes the gram with the least hash, the leftmost of equals, is its trigger, so
equal windows have the same trigger at the same offset. The windows that share a
trigger lie side by side; what they cover together is the trigger's phrase. Each
window lies whole in one phrase, so no suffix that is to be compared runs on into
the next phrase, and no phrase is a part of another with the same trigger's windows.

Parse. One row per phrase occurrence (trigger's hash, phrase's fingerprint, 64 bits
each), sorted by trigger, phrase and place. Of each phrase the first occurrence
stays and all later ones are removed, whole windows at a time, without looking
inside: that is what makes highly repetitive text cheap.

Dictionary. What is left is one occurrence of each phrase. Two phrases can share a
window only if they have the same trigger and the same ``HALF`` bytes on one side of
it; such phrases meet with their bytes. Their suffixes from the trigger on are sorted
by letter, and their reversed prefixes up to it; common prefixes of neighbours in
these two suffix arrays tell the classes of equal windows at every offset, byte by
byte. Places put each class in corpus order; the first stays.

Skew. Occurrences of a phrase that a task sees again are passed on as removed, in
joined runs, without joining their group; a trigger with many phrases in one task is
split by phrase. A context that over ``HOT`` phrases share is split into its windows,
repeats in one task passed on as removed. Sorting is Spark's, which spills; sorted
rows stream by. Texts are shuffled only for documents that need a second look.

Documents are rows: rows that share an id but differ in text, and rows without an
id, are documents of their own, in an order of their own within the id (numbered in
``place`` above bit 31: 2**32 texts at one id). Repeated rows (id and text) are one document,
with one result. A null id comes before all others. A null text counts as empty. A
text's length is bounded by Spark's strings alone: long ones are parsed in chunks
with the windows that cross their edges, and equal what one piece would give.
Further columns are ignored, whatever their names, or carried through where ``keep``
names them, unless they have a name of the result's. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, pick, ready, table

LENGTH, GRAM = 100, 32
HALF = (LENGTH - GRAM) // 2
CHUNK = 1 << 20
#: A trigger with so many different phrases in one task is split by phrase.
MANY = 32
#: A context on one side of a trigger that more different phrases share is split into windows.
HOT = 512
BATCH_BYTES = 8_000_000
#: Bits of place that are the place in the text; those above number the texts of one id.
TEXT_BITS = 31
GROUP_ROWS = 30_000
NULL_ID = -(2**63)
PLAIN, REMOVED, SPLIT, MARKER = 0, 1, 2, 3

_rng = np.random.default_rng(1597463007)
LANES = _rng.integers(1, 2**63, GRAM // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Low bits of a hash that give way to a gram's place in its chunk; a chunk has LENGTH - GRAM grams more than CHUNK.
PLACE = np.uint64((1 << 21) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_powers: list[np.ndarray] = []


def power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, made once a process."""
    n = CHUNK + 2 * LENGTH
    if not _powers or len(_powers[0]) < n:
        _powers[:] = powers(n, int(BASE)), powers(n, pow(int(BASE), -1, 2**64))
    return _powers[0], _powers[1]


def eights(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    out = np.empty(len(data) - 7, dtype=np.uint64)
    for o in range(min(8, len(out))):
        out[o::8] = np.frombuffer(data, dtype="<u8", offset=o, count=(len(data) - o) // 8)
    return out


def phrases(data: bytes) -> tuple[np.ndarray, ...]:
    """Of one document: trigger hash, phrase fingerprint, trigger place, shape (how far before it the first and last window start), ends."""
    found = [_phrases(data[a : a + CHUNK + LENGTH - 1], a) for a in range(0, max(len(data) - LENGTH + 1, 0), CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)


def _phrases(data: bytes, base: int) -> tuple[np.ndarray, ...]:
    m = mixed(eights(data) ^ BASE)
    n = len(data) - GRAM + 1
    h = m[:n] * LANES[0]
    for i in range(1, GRAM // 8):
        h += m[8 * i : 8 * i + n] * LANES[i]
    h = mixed(h)
    least = h & ~PLACE | np.arange(n, dtype=np.uint64)
    span = 1
    width = LENGTH - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(data) - LENGTH + 1], least[width - span :]) if span < width else least
    at = (least & PLACE).astype(np.int64)  # the trigger of each window
    lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    hi = np.append(lo[1:], len(at)) - 1
    at = at[lo]
    body = prints(m)
    shape = ((hi - lo) << 8 | (at - lo)).astype(np.uint64)
    phrase = mixed(body(lo, hi + LENGTH) + mixed(shape * BASE + BASE))
    # a window holds the trigger and either HALF bytes more before it or HALF after it
    before, after = at - lo, at - hi
    left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    far, near = before >= HALF, after < HALF
    left[far] = body(at[far] - HALF, at[far] + GRAM) >> np.uint64(33)
    right[near] = body(at[near], at[near] + GRAM + HALF) >> np.uint64(33)
    ends = (left + far.astype(np.uint64)) << np.uint64(32) | (right + near.astype(np.uint64))  # 0: no such windows
    return h[at], phrase, at + base, before << 16 | after << 8, ends


def prints(m: np.ndarray):
    """Fingerprints of the bytes from a to b, for arrays of such places, from the mixed eights of a text."""
    up, down = power_tables()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(m * up[: len(m)])))
    return lambda a, b: mixed((sums[b - 7] - sums[a]) * down[a] + (b - a).astype(np.uint64) * BASE)


SCHEMA = "key long, phrase long, doc long, place long, shape int, ends long"
NAMES = ["key", "phrase", "doc", "place", "shape", "ends"]
TYPES = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int64]


def rows_of(*columns: np.ndarray) -> pa.RecordBatch:
    """shape: how far before the place the first window starts << 16 | the last << 8 | flag. Of REMOVED rows, place to ends is the span."""
    return pa.RecordBatch.from_arrays([pa.array(c.view(t) if c.dtype == np.uint64 else c.astype(t, copy=False)) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def joined(doc: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, in order, with those that overlap or touch made one."""
    if not len(a):
        return doc, a, e
    order = np.lexsort((a, doc))
    doc, a, e = doc[order], a[order], e[order]
    by_end = np.lexsort((e, doc))
    rank = np.empty(len(e), np.int64)
    rank[by_end] = np.arange(len(e))
    e = e[by_end[np.maximum.accumulate(rank)]]  # the furthest end so far in the same document
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (a[1:] > e[:-1])))
    return doc[new], a[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


def removed_rows(doc, place, shape) -> tuple[np.ndarray, ...]:
    """Columns of REMOVED rows for the windows of phrases."""
    doc, a, e = joined(doc, place - (shape >> 16), place - (shape >> 8 & 255) + LENGTH)
    zero = np.zeros(len(a), np.int64)
    return zero, zero, doc, a, zero + REMOVED, e


def routed(key, phrase, doc, place, shape, ends) -> pa.RecordBatch:
    """Rows for the shuffle: repeats within this lot become removed spans; triggers of many phrases are to be split by phrase."""
    order = np.lexsort((place, doc, phrase, key))
    key, phrase, doc, place, shape, ends = (x[order] for x in (key, phrase, doc, place, shape, ends))
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    first = new_key | np.concatenate(([True], phrase[1:] != phrase[:-1]))
    run = np.cumsum(new_key) - 1
    kinds = np.bincount(run, first)[run] >= MANY
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = ~first & ((doc != doc[lead]) | (place != place[lead]))  # a repeated row at the first's own place is no repeat
    mark = key[new_key & kinds]
    zero = np.zeros(len(mark), np.int64)
    lead_rows = (key[first], phrase[first], doc[first], place[first], shape[first] | np.where(kinds, SPLIT, PLAIN)[first], ends[first])
    marks = (mark, zero.view(np.uint64), zero, zero, zero + MARKER, zero.view(np.uint64))
    gone = removed_rows(doc[again], place[again], shape[again])
    view = lambda x: x.view(np.int64) if x.dtype == np.uint64 else x
    return rows_of(*(np.concatenate(tuple(map(view, x))) for x in zip(lead_rows, marks, gone, strict=True)))


@lean
def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, base (the text's number, in place) and text in."""
    held: list = []
    size = 0

    def out():
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return routed(*cols)

    for b in batches:
        for doc, base, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if text and len(text) >= LENGTH:
                key, phrase, at, shape, ends = phrases(text)
                held.append((key, phrase, np.full(len(at), doc, dtype=np.int64), at + base, shape, ends))
                size += len(text)
                if size >= BATCH_BYTES:
                    yield out()
                    size = 0
    if held:
        yield out()


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parse rows in; out come removed spans (REMOVED), and (PLAIN) first occurrences of phrases whose trigger has others.

    Carries only the last key, phrase and first place, and one first occurrence of which it isn't known yet whether its trigger has others.
    """
    last = None  # key, phrase and whether split, of the last row
    lead_at = (0, 0)  # doc and place of the last phrase's first
    waiting: tuple | None = None
    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        gone = (cols[4] & 255) == REMOVED
        if gone.any():
            yield rows_of(*(x[gone] for x in cols))
            cols = [x[~gone] for x in cols]
        key, phrase, shape = cols[0], cols[1], cols[4]
        if not len(key):
            continue
        split = (shape & 255) == SPLIT
        before = last or (~key[0], 0, False)
        new_key = np.concatenate(([key[0] != before[0] or split[0] != before[2]], (key[1:] != key[:-1]) | (split[1:] != split[:-1])))
        first = new_key | np.concatenate(([phrase[0] != before[1]], phrase[1:] != phrase[:-1]))
        last = (key[-1], phrase[-1], split[-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        ours = lead >= 0
        at = tuple(np.where(ours, cols[i][lead], lead_at[i - 2]) for i in (2, 3))
        lead_at = (at[0][-1], at[1][-1])
        again = ~first & ((cols[2] != at[0]) | (cols[3] != at[1]))  # a repeated row at the first's own place is no repeat
        if again.any():
            yield rows_of(*removed_rows(cols[2][again], cols[3][again], shape[again]))
        cols, alone = [x[first] for x in cols], new_key[first]
        if waiting is not None:
            cols = [np.concatenate((np.array([w], dtype=x.dtype), x)) for w, x in zip(waiting[0], cols, strict=True)]
            alone = np.concatenate(([waiting[1]], alone))
        if not len(alone):
            continue
        flag = cols[4] & 255
        shares = (~alone | ~np.append(alone[1:], True) | (flag == SPLIT)) & (flag != MARKER)
        shares[-1] = False
        waiting = (tuple(x[-1] for x in cols), bool(alone[-1]))
        if shares.any():
            some = [x[shares] for x in cols]
            some[4] = some[4] & ~255
            yield rows_of(*some)
    if waiting is not None:
        row, alone = waiting
        flag = row[4] & 255
        if (not alone or flag == SPLIT) and flag != MARKER:
            yield rows_of(*(np.array([row[i] & ~255 if i == 4 else row[i]]) for i in range(6)))


def flag_of(shape="shape"):
    return F.col(shape).bitwiseAND(255)


def settled(rows: DataFrame) -> DataFrame:
    split = (flag_of() == SPLIT).alias("split")
    route = F.when(flag_of() == SPLIT, F.xxhash64("key", "phrase")).when(flag_of() == REMOVED, F.xxhash64("doc", "place")).otherwise(F.col("key"))
    return rows.repartition(route).sortWithinPartitions(split, "key", "phrase", "doc", "place").mapInArrow(settle, SCHEMA)


def alike(phrases_: DataFrame, scratch: Scratch) -> DataFrame:
    """Of phrases that share a trigger, those that also share HALF bytes on one side of it with a different phrase.

    The low bits of shape tell for the left side (0 to 2) and, above, the right: not shared, shared,
    shared by over HOT. The lists of shared sides are written, so that the joins have
    nothing but exchanges under them and a common line's rows can be split.
    """
    side = {"left": F.shiftright("ends", 32), "right": F.col("ends").bitwiseAND(0xFFFFFFFF)}
    p = phrases_.select("*", *[v.alias(k) for k, v in side.items()])
    for k in side:
        n = p.where(f"{k} <> 0").groupBy(F.col("key").alias("_k"), F.col(k).alias("_e")).agg(F.count("*").alias("_n")).where("_n > 1")
        n = scratch.save(n.select("_k", "_e", F.when(F.col("_n") > HOT, 2).otherwise(1).alias("_how")), f"shared_{k}")
        p = p.join(n, (F.col("key") == F.col("_k")) & (F.col(k) == F.col("_e")), "left").withColumn(f"_{k}", F.coalesce("_how", F.lit(0))).drop("_k", "_e", "_how")
    return p.where("_left + _right > 0").select("key", "doc", "place", F.col("shape").bitwiseOR(F.col("_left")).bitwiseOR(F.col("_right") * 4).alias("shape"), "ends")


#: A row of the dictionary: route, whose it is, the offsets lo to hi of the windows to compare, and their bytes with the trigger at REACH; or, with a body of null, a removed span from place to e.
REACH = LENGTH - GRAM
WIDTH = REACH + LENGTH
BODY_SCHEMA = "route long, doc long, place long, lo int, hi int, body binary, e long"


def body_rows(route, doc, place, lo, hi, body, e) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((route, doc, place, lo, hi, body, e), kinds, strict=True)], names=["route", "doc", "place", "lo", "hi", "body", "e"])


def body_of(text: bytes, place: int, lo: int, hi: int) -> bytes:
    return (b"\0" * (REACH - hi) + text[place - hi : place - lo + LENGTH]).ljust(WIDTH, b"\0")


@lean
def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, base, text and its phrases (key, place, shape, ends) in; rows of the dictionary out."""
    held: list[tuple] = []
    hot: list[tuple] = []
    hot_rows = 0

    def flush_hot():
        """Of equal windows of this lot the first goes on, the others are removed."""
        win = np.array([h[0] for h in hot], dtype=f"S{LENGTH}")
        doc, place, far = (np.array([h[i] for h in hot], dtype=np.int64) for i in (1, 2, 3))
        order = np.lexsort((place, doc, win))
        w = win[order]
        new = np.concatenate(([True], w[1:] != w[:-1]))
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        gone = order[~new & ((doc[order] != doc[lead]) | (place[order] != place[lead]))]
        d, a, e = joined(doc[gone], place[gone] - far[gone], place[gone] - far[gone] + LENGTH)
        n = len(a)
        yield body_rows(mixed(d.view(np.uint64) + a.view(np.uint64) * BASE).view(np.int64), d, a, [0] * n, [0] * n, [None] * n, e)
        first = order[new]
        for at in range(0, len(first), 5000):
            some = first[at : at + 5000]
            bodies = [b"\0" * (REACH - hot[i][3]) + hot[i][0] + b"\0" * hot[i][3] for i in some]
            yield body_rows([hot[i][4] for i in some], doc[some], place[some], far[some], far[some], bodies, [0] * len(some))
        hot.clear()

    def flush():
        yield body_rows(*zip(*held, strict=True))
        held.clear()

    for b in batches:
        for doc, base, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            v = found.values
            key, place, shape, ends = (v.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            place = place - base
            before, after, left, right = shape >> 16, shape >> 8 & 255, shape & 3, shape >> 2 & 3
            for side, how, part, lo, hi in ((1, left, ends.view(np.uint64) >> np.uint64(32), np.maximum(after, HALF), before), (2, right, ends.view(np.uint64) & np.uint64(0xFFFFFFFF), after, np.minimum(before, HALF - 1))):
                use = (how > 0) & (lo <= hi)
                routes = mixed((mixed(key.view(np.uint64) ^ BASE) + part) * LANES[1] + np.uint64(side)).view(np.int64)
                for i in np.flatnonzero(use & (how == 1)).tolist():
                    p, x, y = int(place[i]), int(lo[i]), int(hi[i])
                    held.append((int(routes[i]), doc, p + base, x, y, body_of(text, p, x, y), 0))
                many = np.flatnonzero(use & (how == 2))
                for i in many.tolist():
                    p, k = int(place[i]), int(key[i])
                    for d in range(int(lo[i]), int(hi[i]) + 1):
                        w = text[p - d : p - d + LENGTH]
                        hot.append((w, doc, p + base, d, hash_of(w, k)))
                hot_rows = len(hot)
            if len(held) >= 5000:
                yield from flush()
            if hot_rows >= 100_000:
                yield from flush_hot()
                hot_rows = 0
    if held:
        yield from flush()
    if hot:
        yield from flush_hot()


def hash_of(window: bytes, key: int) -> int:
    return xxhash.xxh3_64_intdigest(window, seed=key & (2**63 - 1)) - 2**63


def common(sorted_rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it; of the first 0."""
    same = sorted_rows[1:] == sorted_rows[:-1]
    n = np.where(same.all(1), sorted_rows.shape[1], same.argmin(1)) if len(same) else np.zeros(0, np.int64)
    return np.concatenate((np.zeros(min(1, len(sorted_rows)), np.int64), n))


def suffix_order(group: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and then by letter, and what each has in common with the one before, in letters; across groups -1."""
    whole = np.ascontiguousarray(np.concatenate((group.astype(">u4").view(np.uint8).reshape(-1, 4), letters), axis=1))
    order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
    return order, np.where((n := common(whole[order])) >= 4, n - 4, -1)


def repeated(group: np.ndarray, doc: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, bodies: np.ndarray) -> np.ndarray:
    """Whether the window of each row (in corpus order within its group) at each offset is also one of an earlier row."""
    gone = np.zeros((len(group), REACH + 1), dtype=bool)
    (right, right_common), (left, left_common) = (suffix_order(group, x) for x in (bodies[:, REACH:], bodies[:, REACH - 1 :: -1]))
    classes = np.empty((2, len(group)), np.int64)
    for d in range(REACH + 1):
        at = np.flatnonzero((lo <= d) & (d <= hi))
        if len(at) < 2:
            continue
        classes[0, right] = np.cumsum(right_common < LENGTH - d)
        classes[1, left] = np.cumsum(left_common < d)
        kind = classes[0, at] * (len(group) + 1) + classes[1, at]
        order = np.argsort(kind, kind="stable")
        new = np.concatenate(([True], kind[order][1:] != kind[order][:-1]))
        lead, own = at[order[np.flatnonzero(new)[np.cumsum(new) - 1]]], at[order]
        gone[own, d] = ~new & ((doc[own] != doc[lead]) | (place[own] != place[lead]))
    return gone


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the dictionary, sorted by route, document and place, in; removed spans (doc, a, e) out. Holds whole routes, of HOT rows or a row a task each."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def out(doc, a, e):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, a, e)], names=["doc", "a", "e"])

    def judged(t: pa.Table) -> pa.RecordBatch:
        route, doc, place, lo, hi = (t.column(c).to_numpy() for c in ("route", "doc", "place", "lo", "hi"))
        bodies = np.frombuffer(b"".join(t.column("body").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
        group = np.cumsum(np.concatenate(([False], route[1:] != route[:-1])))
        gone = np.pad(repeated(group, doc, place, lo, hi, bodies), ((0, 0), (1, 1)))
        i, first = np.nonzero(gone[:, 1:] & ~gone[:, :-1])
        _, last = np.nonzero(gone[:, :-1] & ~gone[:, 1:])
        return out(doc[i], place[i] - (last - 1), place[i] - first + LENGTH)

    for b in batches:
        spans = pa.compute.is_null(b.column(5))
        if pa.compute.any(spans).as_py():
            some = b.filter(spans)
            yield out(some.column(1), some.column(2), some.column(6))
            b = b.filter(pa.compute.invert(spans))
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= GROUP_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            route = t.column("route").to_numpy()
            cut_at = int(np.searchsorted(route, route[-1]))  # the last route may go on
            if cut_at:
                yield judged(t.slice(0, cut_at))
                t = t.slice(cut_at)
            held, rows = t.to_batches(), t.num_rows
    if held:
        yield judged(pa.Table.from_batches(held))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (doc, base, a, e), sorted, in; one row per text with its joined spans out. Holds one text's."""
    now, mine = None, []

    def out():
        a, e = (np.concatenate(x) for x in zip(*mine, strict=True))
        spans = pa.StructArray.from_arrays([pa.array(a), pa.array(e)], names=["a", "e"])
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), spans)], names=["doc", "base", "spans"])

    for b in batches:
        doc, base, a, e = (c.to_numpy() for c in b.columns)
        edges = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (base[1:] != base[:-1]), [True])))
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if now != (doc[x], base[x]):
                if mine:
                    yield out()
                now, mine = (doc[x], base[x]), []
            p, q = a[x:y], e[x:y]
            if mine:  # its last span may go on
                p, q = np.append(mine[-1][0][-1:], p), np.append(mine[-1][1][-1:], q)
                mine[-1] = (mine[-1][0][:-1], mine[-1][1][:-1])
            mine.append(joined(np.zeros_like(p), p, q)[1:])
    if mine:
        yield out()


CUT_SCHEMA = "n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"
CUT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
OWN = ("n_bytes", "n_removed", "n_spans", "kept", "kept_text")


@lean
def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, spans (null: none) and further columns in."""
    for b in batches:
        rows = []
        for text, spans in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            v = spans.values
            gone = list(zip(v.field(0).to_pylist(), v.field(1).to_pylist(), strict=True)) if v is not None else []
            edges = [0, *(x for r in gone for x in r), len(text)]
            parts = [text[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True)]
            rows.append((len(text), sum(e - a for a, e in gone), len(gone), b"".join(parts), "".join(p.decode("utf-8", "ignore") for p in parts)))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(CUT_TYPES), CUT_TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays([*cols, *b.columns[2:]], names=[*OWN, *b.schema.names[2:]])


def spans_of(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs: doc, base, text (binary). A written table of doc, base and spans: where to cut."""
    first = scratch.save(settled(docs.mapInArrow(parse, SCHEMA)), "parse")
    near = scratch.save(alike(first.where(flag_of() == PLAIN), scratch), "near")
    ids = scratch.save(near.select("doc").distinct(), "near_ids")
    base = lambda c: F.shiftleft(F.shiftright(c, TEXT_BITS), TEXT_BITS)
    by_text = near.groupBy(F.col("doc").alias("_doc"), base("place").alias("_base")).agg(F.collect_list(F.struct("key", "place", "shape", "ends")).alias("found"))
    texts = pick(docs, ids, id_col="doc").join(by_text, (F.col("doc") == F.col("_doc")) & (F.col("base") == F.col("_base"))).select("doc", "base", "text", "found")
    bodies = texts.mapInArrow(contexts, BODY_SCHEMA).repartition("route").sortWithinPartitions("route", "doc", "place")
    second = bodies.mapInArrow(compare, "doc long, a long, e long")
    removed = first.where(flag_of() == REMOVED).select("doc", F.col("place").alias("a"), F.col("ends").alias("e")).unionByName(second)
    removed = removed.select("doc", base("a").alias("base"), F.col("a") - base("a"), F.col("e") - base("a")).toDF("doc", "base", "a", "e")
    out = removed.repartition("doc", "base").sortWithinPartitions("doc", "base", "a", "e").mapInArrow(runs, "doc long, base long, spans array<struct<a:long,e:long>>")
    out = scratch.save(out, "spans")
    scratch.drop("parse", "near", "near_ids", "shared_left", "shared_right")
    return out


def numbered(plain: DataFrame, scratch: Scratch) -> DataFrame:
    """plain with base: 0, but of different texts that share an id, or have none, the number of each, above TEXT_BITS.

    Only rows of such ids are shuffled. The numbers are written with the texts' digests before
    they are used, so a task that is run again finds them as they were.
    """
    shared = scratch.save(plain.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "shared_ids")
    if shared.isEmpty():
        return plain.withColumn("base", F.lit(0).cast("long"))
    digest = F.sha2("text", 256)
    kinds = pick(plain.select("doc", digest.alias("_digest")), shared, id_col="doc").distinct()
    at = scratch.save(kinds.withColumn("_at", F.monotonically_increasing_id()), "kinds_at")
    counts, total, starts = sorted((r[0], r[1]) for r in at.groupBy(F.shiftright("_at", 33)).count().collect()), 0, []
    for part, n in counts:  # a row a partition
        starts.append((int(part), total))
        total += n
    starts = plain.sparkSession.createDataFrame(starts, "_part long, _start long")
    number = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    kinds = at.join(F.broadcast(starts), F.shiftright("_at", 33) == F.col("_part")).select(F.col("doc").alias("_d"), F.col("_digest").alias("_g"), F.shiftleft(number, TEXT_BITS).alias("base"))
    kinds = scratch.save(kinds, "kinds")
    some = pick(plain, shared, id_col="doc").withColumn("_digest", digest)
    some = some.join(kinds, (F.col("doc") == F.col("_d")) & (F.col("_digest") == F.col("_g"))).drop("_d", "_g", "_digest")
    return scratch.save(pick(plain, shared, "left_anti", "doc").withColumn("base", F.lit(0).cast("long")).unionByName(some), "numbered")


def deduplicate(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (the bytes that stay), kept_text and the columns named in keep, for each row of docs.

    kept_text leaves out half characters at the edges of a cut.
    """
    ready(docs.sparkSession)
    keep = [c for c in keep if c not in (*OWN, id_col)]
    more = [f"_keep{i}" for i in range(len(keep))]
    plain = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), *[F.col(f"`{c}`").alias(m) for c, m in zip(keep, more, strict=True)])
    plain = numbered(plain, scratch)
    spans = spans_of(plain.select("doc", "base", "text"), scratch)
    hit = scratch.save(spans.select("doc").distinct(), "hit")
    no = F.lit(0).cast("long")
    rest = pick(plain, hit, "left_anti", "doc").select(F.octet_length("text").cast("long").alias("n_bytes"), no.alias("n_removed"), no.alias("n_spans"), F.col("text").alias("kept"), F.col("text").cast("string").alias("kept_text"), "doc", *more)
    same = (F.col("doc") == F.col("_doc")) & (F.col("base") == F.col("_base"))
    j = pick(plain, hit, id_col="doc").join(spans.withColumnsRenamed({"doc": "_doc", "base": "_base"}), same, "left").select("text", "spans", "doc", *more)
    kinds = "".join(f", {c} {j.schema[c].dataType.simpleString()}" for c in ("doc", *more))
    out = rest.unionByName(j.mapInArrow(cut, CUT_SCHEMA + kinds))
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias(id_col), *OWN, *[F.col(m).alias(c) for c, m in zip(keep, more, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = deduplicate(table(spark, sf_dir, "documents"), Scratch(spark, "substrings"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n, [h[o:o + 4095] FOR o IN range(1, len(h) + 1, 2048)] AS parts FROM d
), b AS (
  SELECT doc_id, n, unnest(parts) AS part, (generate_subscripts(parts, 1) - 1) * 1024 AS base FROM p
), w AS (
  SELECT doc_id, base + s AS s, part[2 * s + 1:2 * s + 200] AS w
  FROM (SELECT doc_id, base, part, unnest(range(0, least(1024, len(part) // 2 - 99))) AS s FROM b WHERE len(part) >= 200)
), g AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM w
), c AS (
  SELECT doc_id, s, s + 100 AS e, lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 AS last FROM g WHERE r > 1
), i AS (
  SELECT doc_id, s, e, sum(CASE WHEN s <= last THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM c
), x AS (
  SELECT doc_id, min(s) AS a, max(e) AS e FROM i GROUP BY doc_id, run
), k AS (
  SELECT d.doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY d.doc_id ORDER BY a), 0) AS kept_from, h FROM x JOIN d USING (doc_id)
), t AS (
  SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(h[2 * kept_from + 1:2 * a], '' ORDER BY a) AS kept FROM k GROUP BY doc_id
)
SELECT d.doc_id, p.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE kept || h[2 * last + 1:] END)) AS kept_sha256
FROM d JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
