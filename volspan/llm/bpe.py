"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

A text is cut by the split pattern. A piece that is a vocabulary entry is one
token. The other distinct pieces of a slice are laid out by byte length in
padded matrices of token ids; in each round every row merges its leftmost
minimum-rank pair, found through an open-addressed hash table of all pairs, and
the row closes up. Rows without a pair leave the matrix.

Defined results: a null text counts as empty and has no tokens; special tokens are
ordinary text; repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from volspan.llm.arrowmap import append_struct

NONE = np.int32(2**31 - 1)
#: Padded widths of the matrices; longer pieces are merged one by one.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256)
#: Rows longer than this find their leftmost minimum pair in a heap; the merges and their order are the same.
LONG_ROW = 256
#: Bytes of distinct pieces and their ids that a task remembers between slices.
CACHE_BYTES = 8 << 20


class PairTable:
    """Pair of token ids -> rank of the joined bytes, by multiplicative hashing with linear probes."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self.slots(keys)
        values = np.array(rank, np.int32)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.ranks[slot] == NONE
            at, first = np.unique(slot[free], return_index=True)
            chosen = todo[free][first]
            self.keys[at], self.ranks[at] = keys[chosen], values[chosen]
            left_over = np.ones(len(todo), bool)
            left_over[np.flatnonzero(free)[first]] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none or an id is negative."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self.slots(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.ranks[slot] != NONE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            hit = self.keys[slot[open_]] == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (self.ranks[slot[open_]] != NONE)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def of(self, left: int, right: int) -> int:
        """The rank of one pair."""
        key = left << 32 | right
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (rank := self.ranks.item(slot)) != NONE and self.keys.item(slot) != key:
            slot = slot + 1 & self.mask
        return rank


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = {i: token for token, i in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merge_matrix(self, ids: np.ndarray) -> np.ndarray:
        """Final ids of the rows of a matrix, both padded with -1."""
        n = len(ids)
        done = np.empty_like(ids)
        row = np.arange(n)
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1)
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            over = best == NONE
            if over.any():
                done[row[over]] = ids[over]
                ids, ranks, row, at, best = ids[~over], ranks[~over], row[~over], at[~over], best[~over]
                if not len(row):
                    break
            here = np.arange(len(row))
            columns = np.arange(ids.shape[1] - 1)
            source = columns[None, :] + (columns[None, :] > at[:, None])
            closed = np.full_like(ids, -1)
            closed[:, :-1] = np.take_along_axis(ids, source, 1)
            closed[here, at] = best
            moved = np.full_like(ranks, NONE)
            moved[:, :-1] = np.take_along_axis(ranks, source[:, :-1], 1)
            ids, ranks = closed, moved
            ranks[here, at] = self.pairs.find(ids[here, at], ids[here, at + 1])
            inner = at > 0
            ranks[here[inner], at[inner] - 1] = self.pairs.find(ids[here[inner], at[inner] - 1], ids[here[inner], at[inner]])
        return done

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row: the same merges in the same order, the leftmost minimum-rank pair of each round
        taken from a heap, in n log n steps instead of a row of n for each of n merges."""
        n = len(ids)
        token, rank = array("i", ids.tolist()), array("i", [*self.pairs.find(ids[:-1], ids[1:]).tolist(), int(NONE)])
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        heap = [r << 40 | i for i, r in enumerate(rank) if r != NONE]
        heapify(heap)
        place = (1 << 40) - 1
        while heap:
            entry = heappop(heap)
            best, i = entry >> 40, entry & place
            if rank[i] != best:  # one of the pair has merged since
                continue
            gone = after[i]
            token[i], after[i], rank[gone] = best, after[gone], int(NONE)
            token[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left < 0:
                    continue
                rank[left] = self.pairs.of(token[left], token[right]) if right < n else int(NONE)
                if rank[left] != NONE:
                    heappush(heap, rank[left] << 40 | left)
        left = np.array(token, np.int32)
        return left[left >= 0]

    def encode_pieces(self, pieces: Sequence[str]) -> None:
        """Remember the ids of new pieces, as little-endian 32-bit integers."""
        by_width: dict[int, list[tuple[str, bytes]]] = {w: [] for w in WIDTHS}
        row_width = [next(w for w in WIDTHS if w >= n) for n in range(LONG_ROW + 1)]
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_ROW:
                self.known[piece] = self.merge_long(self.byte[np.frombuffer(raw, np.uint8)]).astype("<u4").tobytes()
            else:
                by_width[row_width[len(raw)]].append((piece, raw))
        for width, rows in by_width.items():
            most = max(1, 400_000 // width)
            for start in range(0, len(rows), most):
                part = rows[start : start + most]
                flat = np.frombuffer(b"".join([raw.ljust(width, b"\0") for _, raw in part]), np.uint8).reshape(-1, width)
                size = np.array([len(raw) for _, raw in part])
                final = self.merge_matrix(np.where(np.arange(width) < size[:, None], self.byte[flat], np.int32(-1)))
                held, ends = final.astype("<u4").tobytes(), (4 * (final >= 0).sum(axis=1)).tolist()
                self.known.update((piece, held[4 * width * i : 4 * width * i + ends[i]]) for i, (piece, _) in enumerate(part))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text. The new pieces of all given texts share the matrices."""
        cut = [self.split(text) for text in texts]
        new = list(set().union(*cut).difference(self.known))
        self.encode_pieces(new)
        self.held += sum(4 * len(x) + 150 for x in new)  # the piece, its ids and the entry, about
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        if self.held > CACHE_BYTES:
            self.forget()
        return out

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """The tables, one copy for each Python worker. Every machine has the file at the same path."""
    return Encoder(read_ranks(path), pattern)


ENCODED = StructType([StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])
DIGESTS = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "bpe", keep: Sequence[str] | None = None, digests: bool = False) -> DataFrame:
    """Append a struct with the ids of each text, and whether they decode to its bytes.

    With `digests`, the struct holds the token count and the SHA-256 of the ids (as
    little-endian unsigned 32-bit integers) and of the decoded bytes, made where the
    ids are, so that neither leaves the worker.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        tool = encoder(path, pattern)
        plain = [t or "" for t in texts.to_pylist()]
        ids = tool.encode(plain)
        counts = pa.array([len(x) // 4 for x in ids], pa.int64())
        if digests:
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [counts, pa.array([sha(x) for x in ids]), pa.array([sha(tool.decode(x)) for x in ids])]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
        return [counts, lists, pa.array([tool.decode(x) == t.encode() for x, t in zip(ids, plain, strict=True)])]

    return append_struct(df, text_col, out, DIGESTS if digests else ENCODED, run, keep, finish=lambda: encoder(path, pattern).forget())


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str, out: str = "decoded") -> DataFrame:
    """Append the bytes that an array of token ids stands for; null and empty arrays give no bytes.

    An id outside the vocabulary raises an error.
    """
    schema = StructType([*df.schema.fields, StructField(out, BinaryType())])

    def run(batches):
        tool = encoder(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids_col)).to_pylist()
            made = pa.array([b"".join(tool.tokens[i] for i in ids or ()) for ids in column], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
