"""SentencePiece merge-type (BPE) encoding with seeded merge-dropout, and decoding.

Encoding starts from characters and merges the adjacent pair whose joined piece
has the best score, the leftmost of equals, until none is left. With dropout,
each candidate merge that comes up is skipped with probability ``dropout``, by a
hash keyed with the seed, the document id and the candidate's place (where its
two parts begin and end). So the same seed and document always give the same
pieces, another seed others, and 0 gives what sentencepiece gives.

No merge can cross two characters that no piece holds side by side; texts are cut
there into units, and all units of a stretch of text are merged side by side in
arrays, each by its own best candidate a round. Units longer than ``LONG`` run
through an agenda (a heap) one by one, with the same result.

Decoding joins the pieces' bytes. The vocabulary covers every byte, so it gives
back the text exactly: a space is the piece mark, and a mark in the text itself
is written as bytes.

Nulls: a null text counts as empty, and gives no pieces. A null document id is a
key as any other. Repeated rows get the same pieces. Extra columns are dropped. An empty
table gives no rows. Of a text longer than ``STRETCH`` characters a stretch at a time is
worked on, which ends between two units; so memory beyond the text and its ids is bounded by
the stretch, or the longest unit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ready, table

MARK = "▁"
LONG = 48
STRETCH = 60_000
NONE = np.int64(1) << np.int64(60)
PLACE = np.int64(40)


class PairTable:
    """(left id, right id) -> value, or -1; open addressing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(left) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int32)
        todo = np.arange(len(left))
        key, at = left.astype(np.int64) << 32 | right, self._home(left, right)
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = at[todo] + 1 & size - 1

    def _home(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key, at = left.astype(np.int64) << 32 | right, self._home(left, right)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], np.int32(-1))
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Vocabulary:
    """A SentencePiece BPE model with byte pieces, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = np.full(256, -1, dtype=np.int32)
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError("a vocabulary with a piece for each byte is needed")
        plain = {p: i for i, p in enumerate(pieces) if not special[i] and not sp.is_byte(i)}
        # rank: 0 for the best score; pieces of equal score have equal ranks
        self.rank = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)[1].astype(np.int64)
        self.char_id = np.arange(n, n + 0x110000, dtype=np.int32)  # a character without a piece gets a symbol of its own
        for p, i in plain.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[ord(" ")] = self.char_id[ord(MARK)]
        self.char_id[ord(MARK)] = n + ord(MARK)
        self.mark = int(self.char_id[ord(" ")])
        merges = [(plain[p[:k]], plain[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        self.merges = PairTable(*np.array(merges, dtype=np.int64).T)
        inner = {(plain[a], plain[b]) for p in plain for a, b in zip(p, p[1:], strict=False) if a in plain and b in plain}
        self.joins = PairTable(*np.array([(a, b, 1) for a, b in sorted(inner)], dtype=np.int64).T)
        self.merge_of = {(a, b): i for a, b, i in merges}
        raw = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(r) for r in raw])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.pool = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the mark that encoding puts first is taken off."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        at = np.repeat(self.starts[ids] - ends + size, size) + np.arange(ends[-1])
        return self.pool[at].tobytes()[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def document_key(seed: int, doc: object) -> int:
    return xxhash.xxh3_64_intdigest(repr(doc).encode(), seed=seed)


class Encoder:
    def __init__(self, vocab: Vocabulary, dropout: float = 0.0, long_unit: int = LONG):
        self.v, self.long_unit = vocab, long_unit
        self.limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))

    def _skipped(self, key, start, middle, end) -> np.ndarray:
        at = start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + middle.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + end.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        return mixed(key ^ mixed(at)) < self.limit

    def _candidates(self, sym, at, stop, unit, shift, key, i):
        """For pairs (i, i + 1): rank and place in one number (NONE: no merge, or a skipped one), and the merged id."""
        merged = self.v.merges.get(sym[i], sym[i + 1])
        if self.limit:
            some = np.flatnonzero(merged >= 0)
            j = i[some]
            u = unit[j]
            off = shift[u]
            merged[some[self._skipped(key[u], at[j] - off, at[j + 1] - off, stop[j + 1] - off)]] = -1
        return np.where(merged >= 0, self.v.rank[merged] << PLACE, NONE), merged

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        return self._encode(codes("".join(f" {t}" for t in texts if t)), np.array([len(t) + 1 if t else 0 for t in texts]), keys, 0)

    def encode_long(self, text: str, key: int, stretch: int = STRETCH) -> np.ndarray:
        """As encode, for one text, in stretches."""
        at, parts, size = 0, [np.zeros(0, dtype="<u4")], stretch
        while at <= len(text) > 0:
            code = codes(text[at - 1 : at - 1 + size] if at else f" {text[: size - 1]}")
            if at + len(code) <= len(text):
                sym = self.v.char_id[code]
                borders = np.flatnonzero(self.v.joins.get(sym[:-1], sym[1:]) < 0)
                if not len(borders):
                    size *= 2
                    continue
                code = code[: borders[-1] + 1]
            parts += self._encode(code, np.array([len(code)]), [key], at)
            at, size = at + len(code), stretch
        return np.concatenate(parts)

    def _encode(self, code: np.ndarray, lens: np.ndarray, keys: list[int], offset: int) -> list[np.ndarray]:
        """code: of texts side by side; offset: where they begin in their documents."""
        if not len(code):
            return [np.zeros(0, dtype="<u4") for _ in lens]
        ends = np.cumsum(lens)
        first = ends[lens > 0] - lens[lens > 0]
        sym = self.v.char_id[code]
        n = len(sym)
        where = np.arange(n) - np.repeat(ends - lens, lens) + offset
        key = np.repeat(np.array(keys, dtype=np.uint64), lens)
        cut = np.ones(n, dtype=bool)  # where a unit begins
        cut[1:] = self.v.joins.get(sym[:-1], sym[1:]) < 0
        cut[first] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, n))
        out = np.full(n, -1, dtype=np.int64)
        out[begin[size == 1]] = sym[begin[size == 1]]
        for b, s in zip(begin[size > self.long_unit], size[size > self.long_unit], strict=True):
            self._agenda(sym[b : b + s], int(where[b]), int(key[b]), out[b : b + s])
        some = (size > 1) & (size <= self.long_unit)
        self._rounds(begin[some], size[some], sym, where, key, out)
        return self._spell(out, code, ends)

    def _rounds(self, begins, sizes, all_sym, where, all_key, out) -> None:
        """Merges in all units at once: in each round each unit's best candidate."""
        if not len(sizes):
            return
        last = np.cumsum(sizes)
        at = (np.arange(last[-1]) + np.repeat(begins - last + sizes, sizes)).astype(np.int32)  # where each symbol begins
        sym, stop, unit = all_sym[at], at + np.int32(1), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        shift, key = (begins - where[begins]).astype(np.int32), all_key[begins]
        value, merged = np.full(len(sym), NONE), np.full(len(sym), -1, dtype=np.int32)
        fresh = np.flatnonzero(unit[:-1] == unit[1:])
        place = (np.int64(1) << PLACE) - 1
        while True:
            value[fresh], merged[fresh] = self._candidates(sym, at, stop, unit, shift, key, fresh)
            heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            best = np.minimum.reduceat(value + np.arange(len(value)), heads)
            going = best < NONE
            hit = best[going] & place
            sym[hit], stop[hit], value[hit] = merged[hit], stop[hit + 1], NONE
            keep = np.ones(len(sym), dtype=bool)
            if len(hit) < len(heads):
                done = np.repeat(~going, np.diff(np.append(heads, len(sym))))
                out[at[done]] = sym[done]
                keep = ~done
            if not len(hit):
                return
            keep[hit + 1] = False
            hit = (np.cumsum(keep) - 1)[hit]
            sym, at, stop, unit, value, merged = (x[keep] for x in (sym, at, stop, unit, value, merged))
            # pairs that the merge has made anew: the merged symbol with what stands before and after it
            before = hit[hit > 0] - 1
            after = hit[hit + 1 < len(sym)]
            fresh = np.concatenate((before[unit[before] == unit[before + 1]], after[unit[after] == unit[after + 1]]))

    def _agenda(self, syms: np.ndarray, start: int, key: int, out: np.ndarray) -> None:
        """One long unit: candidates wait in a heap by rank and place."""
        n, rank, merge_of = len(syms), self.v.rank, self.v.merge_of
        sym = syms.tolist()
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (m := merge_of.get((sym[i], sym[j]))) is not None:
                heapq.heappush(heap, (int(rank[m]), i, j, end[j], m))

        for i in range(n - 1):
            offer(i)
        one = lambda x: np.array([x], dtype=np.uint64)
        while heap:
            _, i, j, e, m = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and alive[j] and end[j] == e) or merge_of.get((sym[i], sym[j])) != m:
                continue
            if self.limit and self._skipped(one(key), one(start + i), one(start + j), one(start + e))[0]:
                continue
            sym[i], end[i], alive[j] = m, e, False
            if e < n:
                prev[e] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out[:] = [s if a else -1 for s, a in zip(sym, alive, strict=True)]

    def _spell(self, out: np.ndarray, code: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids by text; symbols without a piece become the bytes of their characters."""
        size = (out >= 0).astype(np.int64)
        odd = np.flatnonzero(out >= self.v.size)
        spelt = np.frombuffer("".join(map(chr, code[odd])).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        c = code[odd]
        size[odd] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        total = np.cumsum(size)
        ids = np.zeros(int(total[-1]), dtype="<u4")
        whole = (out >= 0) & (out < self.v.size)
        ids[total[whole] - 1] = out[whole]
        if len(odd):
            s = size[odd]
            at = np.repeat(total[odd] - s - (np.cumsum(s) - s), s) + np.arange(len(spelt))
            ids[at] = self.v.byte_id[spelt]
        upto = np.where(ends > 0, total[np.maximum(ends, 1) - 1], 0)
        return np.split(ids, upto[:-1])


def encoding(path: str, dropout: float, seed: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path), dropout)
        for b in batches:
            docs, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            a = 0
            while a < len(docs):
                e, held = a + 1, len(texts[a])
                while e < len(docs) and held + len(texts[e]) <= STRETCH:
                    held += len(texts[e])
                    e += 1
                keys = [document_key(seed, d) for d in docs[a:e]]
                ids = [encoder.encode_long(texts[a], keys[0])] if held > STRETCH else encoder.encode(texts[a:e], keys)
                rest = [c.slice(a, e - a) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array([x.tobytes() for x in ids], pa.binary()), *rest], names=["doc_id", "ids", *b.schema.names[2:]])
                a = e

    return run


def decoding(path: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = [None if x is None else v.decode(np.frombuffer(x, dtype="<u4")) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), *b.columns], names=["decoded", *b.schema.names])

    return run


def model_path(model: str | None) -> str:
    return str(model or public_tokenizers.path("piece_bpe_32k.model"))


def encode(df: DataFrame, dropout: float = 0.1, seed: int = 1, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, ids (little-endian uint32), and the columns that keep names (as Columns with aliases)."""
    ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    more = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns[2:])
    return rows.mapInArrow(encoding(model_path(model), dropout, seed), f"doc_id long, ids binary{more}")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds decoded, the text of ids in UTF-8 bytes."""
    ready(encoded.sparkSession)
    rows = encoded.select("ids", *[c for c in encoded.columns if c != "ids"])
    schema = ", ".join(["decoded binary", *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)])
    return rows.mapInArrow(decoding(model_path(model)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    got = decode(encode(table(spark, sf_dir, "documents"), keep=(F.sha2(text, 256).alias("text_sha256"),)))
    decoded = F.sha2("decoded", 256)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("lossless"))
