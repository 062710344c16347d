"""Byte-level BPE with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry is resolved by one probe.
Tier two merges the other pre-tokens with a heap over linked bytes.  Each Python worker keeps a bounded memo of pre-tokens
already resolved, because the same words come again and again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labcurate.llm.common import bounded_batches, small_batches

#: Entries of one generation of a worker's memo, which holds two.
MEMO_ENTRIES = 400_000

# Texts made only of these characters are split by the standard library's faster engine, with the pattern's classes written
# out; any other text goes to the full Unicode pattern.
_PLAIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NOT_PLAIN = re.compile("[^\t-\r -~¡-±´-¸º-»¿-ſ‐-‧€]")
_PLAIN = re.compile(rf" ?[{_PLAIN_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_PLAIN_LETTERS}0-9]+|\s+(?!\S)|\s+")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The function that splits a text into pre-tokens, in order and without loss."""
    full = regex.compile(pattern)

    def split(text: str) -> list[str]:
        return full.findall(text) if _NOT_PLAIN.search(text) else _PLAIN.findall(text)

    return split


class PerfectHash:
    """Hash-and-displace: keys share out over buckets, and each bucket takes the first displacement that puts all its keys on free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // per_bucket)
        self.shift = [0] * self.buckets
        self.slot_key = [-1] * n
        members: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            b, h = self._parts(k)
            members.setdefault(b, []).append((i, h))
        order = sorted(members, key=lambda b: -len(members[b]))
        for b in order:
            if len(members[b]) == 1:
                break
            d = 0
            while True:
                slots = [self._place(h, d) for _, h in members[b]]
                if len(set(slots)) == len(slots) and all(self.slot_key[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for (i, _), s in zip(members[b], slots, strict=True):
                self.slot_key[s] = i
        free = (s for s in range(n) if self.slot_key[s] < 0)
        for b in order:
            if len(members[b]) == 1:  # a lone key takes any free slot, named outright
                s = next(free)
                self.shift[b], self.slot_key[s] = -1 - s, members[b][0][0]

    def _parts(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(key)
        return h % self.buckets, h

    def _place(self, h: int, d: int) -> int:
        h = ((h ^ (h >> 29)) + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return ((h * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n

    def slot(self, key: bytes) -> int:
        b, h = self._parts(key)
        d = self.shift[b]
        return -1 - d if d < 0 else self._place(h, d)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the symbol that starts at i; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue  # one of the two symbols has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (p := before[i]) >= 0:
            r = ranks.get(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, i, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Memo(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes.  A full generation becomes the older one and replaces that before it;
    tokens met again move along, so frequent ones stay however many rare ones pass."""

    def __init__(self, resolve: Callable[[str], bytes], entries: int = MEMO_ENTRIES):
        super().__init__()
        self.resolve, self.entries, self.older = resolve, entries, {}

    def make_room(self) -> None:
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()

    def __missing__(self, token: str) -> bytes:
        out = self.older.get(token)
        if out is None:
            out = self.resolve(token)
        if len(token) <= 64:
            self.make_room()
            self[token] = out
        return out


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.keys = list(self.ranks)
        self.hash = PerfectHash(self.keys)
        slots = self.hash.slot_key
        self.slot_piece = [self.keys[i] for i in slots]
        self.slot_ids = [np.uint32(self.ranks[self.keys[i]]).tobytes() for i in slots]
        self.split = splitter(pattern)
        self.memo = Memo(self._resolve)

    def _resolve(self, token: str) -> bytes:
        piece = token.encode()
        slot = self.hash.slot(piece)
        if self.slot_piece[slot] == piece:
            return self.slot_ids[slot]
        return np.array(merge(piece, self.ranks), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit bytes; null and empty texts give none."""
        memo = self.memo
        return b"".join([memo[t] for t in self.split(text)]) if text else b""

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker and rank file."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode the ids again, row by row in Arrow batches; no shuffle.

    Returns id_col, ids binary (little-endian 32-bit; only if ``keep_ids``), n_tokens, ids_sha256, decoded_sha256.  A null text
    counts as empty: 0 tokens and the digest of nothing.  Repeated rows are encoded each; other columns are not read.  A text of
    any length is encoded whole: its longest pre-token bounds the heap.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ("ids binary, " if keep_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in bounded_batches(batches, "t"):
            ids = [c.encode(t) for t in batch.column("t").to_pylist()]
            out = {id_col: batch.column("k")} | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {})
            out |= {
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids]),
            }
            yield pa.RecordBatch.from_pydict(out)

    return small_batches(docs).select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` binary to rows with an ids column; null ids decode to nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded") + ", decoded binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in bounded_batches(batches, ids_col):
            out = pa.array([c.decode(x or b"") for x in batch.column(ids_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    return encoded.drop("decoded").mapInArrow(run, schema)
