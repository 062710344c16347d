"""Packing of documents into sequences of bounded length by linear grouping.

Pieces that fill a sequence stand alone.  Of the others only counts by length reach the driver, so the plan's size depends on the
sequence length and not on the corpus: large lengths are rounded up within groups of equally many pieces, a linear programme over
configurations of the few rounded sizes is solved by column generation, actual pieces take the configurations' slots, and what is
left, with the small pieces, goes to the tightest sequence that has room.  Which piece goes where follows from its rank among the
pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labcurate.llm.bpe import _NOT_PLAIN, Memo, splitter
from labcurate.llm.common import bounded_batches, cut, keep, make_way, small_batches

CAPACITY = 1024
END_ID = 2
#: Pre-tokens that a worker remembers, in each of two generations: about 100 bytes each beside the text.
MEMO_ENTRIES = 260_000
#: Pieces up to this length, a quarter of the capacity, are small: they fill gaps.
SMALL = CAPACITY // 4
GROUPS = 256
#: Keys with many rows are ranked in shares; there are at most so many of all keys together, beside one for each key.
SHARES, LEAST_SHARE = 8192, 1024


class _Tokens:
    """The library's ids: pre-tokens are looked up in a bounded memo and resolved by the library when they are new."""

    def __init__(self, path: str, pattern: str):
        self.library = Tokenizer.from_file(path)
        self.split = splitter(pattern)
        self.memo = Memo(self._whole, MEMO_ENTRIES)
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)")  # the library finds these anywhere in a text, before all else
        # Byte-level tokens have one character for each byte.
        self.sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.sizes[i] = len(token)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], between: str) -> None:
        """Resolve many new pre-tokens in one call, where the library parts the joined text just at them (and at what stands
        between), so the ids fall apart where their bytes end."""
        gap = len(between)
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            ids = np.array(self.library.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            reached = np.cumsum(self.sizes[ids])
            ends = np.cumsum([len(w.encode()) + gap for w in part]) - gap
            stops = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[stops - 1], ends):
                continue  # left to be resolved one by one
            raw, start = ids.tobytes(), 0
            for w, stop in zip(part, (4 * stops).tolist(), strict=True):
                self.memo[w] = raw[start:stop]
                start = stop + 4 * gap

    def ids(self, texts: list[str | None]) -> list[bytes]:
        memo = self.memo
        split = [self.split(t) if t and not _NOT_PLAIN.search(t) and not self.special.search(t) else None for t in texts]
        memo.make_room()
        new = set().union(*filter(None, split))
        new.difference_update(memo)
        again = new.intersection(memo.older)
        memo.update({w: memo.older[w] for w in again})
        new = [w for w in new.difference(again) if len(w) <= 64 and not w.isspace()]
        self._learn([w for w in new if w[0] == " "], "")
        self._learn([w for w in new if w[0] != " "], "\n")  # one token
        return [b"".join(map(memo.__getitem__, s)) if s else self._whole(t) if t else b"" for s, t in zip(split, texts, strict=True)]


@lru_cache(maxsize=2)
def _tokens(path: str, pattern: str) -> _Tokens:
    return _Tokens(path, pattern)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, all others are full."""
    rest = n % capacity
    return [(0, rest)] * (rest > 0) + [(s, capacity) for s in range(rest, n, capacity)]


def tokenised(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row (a number of its own for each row), n_tokens, crcs (of each piece's ids); no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_way("packing")
        keep("packing", _tokens.cache_clear)
        t = _tokens(path, pattern)
        end = np.uint32(END_ID).astype("<u4").tobytes()
        for batch in bounded_batches(batches, "text", 2 << 20):
            ids = [x + end for x in t.ids(batch.column("text").to_pylist())]
            crcs = [[zlib.crc32(x[4 * s : 4 * (s + n)]) for s, n in pieces_of(len(x) // 4, capacity)] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "row", "n_tokens", "crcs"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return small_batches(rows).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, n_tokens long, crcs array<long>")


def _lookup(values: np.ndarray) -> F.Column:
    """A constant array; at most CAPACITY + 1 numbers."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<long>")


def ranked(df: DataFrame, key: str, counts: np.ndarray, size: str | None = None) -> DataFrame:
    """Adds ``rank``, from 0, among the rows with the same ``key`` (0 to CAPACITY), in no order that matters.  With ``size`` the sum of
    ``size`` over the rows before instead.  counts: rows of each key.

    Keys with many rows are cut into shares by a hash, so no task ranks a whole hot key.  However many rows there are, there are at
    most SHARES + CAPACITY + 1 shares; so many sums reach the driver and are broadcast.
    """
    shares = np.maximum(1, -(-counts // max(LEAST_SHARE, int(counts.sum()) // SHARES)))
    df = df.withColumn("share", F.pmod(F.xxhash64("row"), F.get(_lookup(shares), F.col(key).cast("int"))))
    amount = F.col(size) if size else F.lit(1)
    sums = df.groupBy(key, "share").agg(F.sum(amount).alias("amount")).collect()  # one for each share
    before, running = [], {}
    for r in sorted(sums, key=lambda r: (r[key], r.share)):
        before.append((r[key], r.share, running.get(r[key], 0)))
        running[r[key]] = running.get(r[key], 0) + r.amount
    w = Window.partitionBy(key, "share").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(amount).over(w), F.lit(0))
    if len(before) <= 1:
        return df.withColumn("rank", here.cast("long")).drop("share")
    first = df.sparkSession.createDataFrame(before, f"{key} {df.schema[key].dataType.simpleString()}, share long, first long")
    return df.withColumn("here", here).join(F.broadcast(first), [key, "share"]).withColumn("rank", (F.col("first") + F.col("here")).cast("long")).drop("share", "first", "here")


def counted(df: DataFrame, key: str) -> np.ndarray:
    """Rows of each value 0 to CAPACITY."""
    out = np.zeros(CAPACITY + 1, np.int64)
    for r in df.groupBy(key).count().collect():
        out[r[0]] = r[1]
    return out


def configurations(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the sizes (ascending) that fit, as rows of three places; len(sizes) stands for none.

    Large sizes are above a quarter of the capacity, so there are no others.
    """
    k = len(sizes)
    out = [np.array([[i, k, k] for i in range(k)])]
    for i in range(k):
        js = np.arange(i, np.searchsorted(sizes, capacity - sizes[i], side="right"))
        if len(js):
            out.append(np.stack([np.full(len(js), i), js, np.full(len(js), k)], axis=1))
        for j in js:
            ks = np.arange(j, np.searchsorted(sizes, capacity - sizes[i] - sizes[j], side="right"))
            if len(ks):
                out.append(np.stack([np.full(len(ks), i), np.full(len(ks), j), ks], axis=1))
    return np.concatenate(out)


def best_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, times): how often to use which configuration so that every size (distinct, ascending) has its slots; times are real
    numbers.  The simplex method with column generation: the configuration worth most at the present prices enters next."""
    k = len(sizes)
    every = configurations(sizes, capacity)
    basis = np.diag(np.minimum(capacity // sizes, 3)).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    times = inverse @ demand.astype(float)
    for _ in range(rounds):
        price = np.append(inverse.sum(axis=0), 0.0)
        worth = price[every].sum(axis=1)
        best = int(worth.argmax())
        if worth[best] <= 1 + 1e-5:
            break
        column = np.bincount(every[best], minlength=k + 1)[:k].astype(float)
        along = inverse @ column
        ratio = np.where(along > 1e-9, times / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        least = ratio[out]
        times -= least * along
        times[out] = least
        row = inverse[out] / along[out]
        inverse -= along[:, None] * row
        inverse[out] = row
    return basis.T.round().astype(np.int64), np.maximum(times, 0)


class Plan:
    """Slots for the pieces longer than SMALL, by their rank from the longest down."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS):
        lengths = np.arange(len(counts))
        large = np.where(lengths > SMALL, counts, 0)
        self.total = int(large.sum())
        self.before = np.concatenate([np.cumsum(large[::-1])[::-1][1:], [0]])  # pieces longer than each length
        self.sequences = 0
        if not self.total:
            return
        k = min(groups, self.total)
        self.edges = np.arange(k + 1) * self.total // k  # first rank of each group
        first_rank = np.concatenate([[0], np.cumsum(large[::-1])])
        rounded = len(counts) - np.searchsorted(first_rank, self.edges[:-1], side="right")  # the longest piece of each group
        sizes, self.size_of = np.unique(rounded, return_inverse=True)
        members = np.diff(self.edges)
        demand = np.bincount(self.size_of, weights=members).astype(np.int64)
        # Of groups rounded to one size the slots are dealt in order.
        self.earlier = np.zeros(k, np.int64)
        seen = np.zeros(len(sizes), np.int64)
        for g in range(k):
            self.earlier[g] = seen[self.size_of[g]]
            seen[self.size_of[g]] += members[g]
        patterns, times = best_configurations(sizes, demand, capacity)
        whole = np.floor(times + 0.5).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(whole)])
        self.sequences = int(base[-1])
        # For each size: where each configuration's slots begin, how many one sequence has, and its first sequence.
        self.slots = []
        for s in range(len(sizes)):
            use = np.flatnonzero((patterns[:, s] > 0) & (whole > 0))
            ends = np.cumsum(whole[use] * patterns[use, s])
            self.slots.append((ends, patterns[use, s], base[use]))

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The sequence of each piece, -1 where it has no slot."""
        out = np.full(len(length), -1, np.int64)
        large = np.flatnonzero(length > SMALL)
        if not self.sequences or not len(large):
            return out
        r = self.before[length[large]] + rank[large]
        g = np.searchsorted(self.edges, r, side="right") - 1
        t, s = r - self.edges[g] + self.earlier[g], self.size_of[g]
        for size in np.unique(s):
            mine = np.flatnonzero(s == size)
            ends, each, base = self.slots[size]
            p = np.searchsorted(ends, t[mine], side="right")
            have = p < len(ends)
            mine, p = mine[have], p[have]
            within = t[mine] - np.where(p > 0, ends[np.maximum(p - 1, 0)], 0)
            out[large[mine]] = base[p] + within // each[p]
        return out


def best_fit(pieces: np.ndarray, room: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best fit, longest first, on counts: pieces of each length, sequences with each room.

    Returns moves (length, first rank, room at the start or -1 for a new sequence, first sequence's rank among those) and the number
    of new sequences.  A move takes pieces and sequences in runs of ranks, so there are few, however many pieces.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {f: [(f, 0, int(n))] for f, n in enumerate(room) if n and f}
    open_rooms = sorted(runs)
    moves, new = [], 0
    for length in range(len(pieces) - 1, 0, -1):
        rank, left = 0, int(pieces[length])
        while left:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):
                count = -(-left // (capacity // length))
                runs[capacity] = [(-1, new, new + count)]
                open_rooms.append(capacity)
                new += count
                continue
            f = open_rooms[at]
            start, lo, hi = runs[f].pop()
            n = min(left, hi - lo)
            if hi - lo > n:
                runs[f].append((start, lo + n, hi))
            elif not runs[f]:
                del runs[f]
                open_rooms.pop(at)
            moves.append((length, rank, start, lo))
            rank, left = rank + n, left - n
            if f > length:
                if f - length not in runs:
                    runs[f - length] = []
                    insort(open_rooms, f - length)
                runs[f - length].append((start, lo, lo + n))
    return np.array(moves, np.int64).reshape(-1, 4), new


def pack(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """tokens: what tokenised() returns, as a table that reads the same each time.  One row for each piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rest = (F.col("n_tokens") % capacity).cast("int")
    part = cut(tokens.where(rest > 0).select("doc_id", "row", rest.alias("length"), F.col("crcs")[0].alias("ids_crc32")))
    counts = counted(part, "length")
    plan = Plan(counts, capacity)

    def slot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = plan.place(*(batch.column(k).to_numpy() for k in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(s)], [*batch.schema.names[:4], "sequence_id"])

    kind = part.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "row", "length", "ids_crc32", "rank"]
    slotted = cut(ranked(part, "length", counts).select(columns).mapInArrow(slot, f"doc_id {kind}, row long, length int, ids_crc32 long, sequence_id long"))
    inside, outside = slotted.where(F.col("sequence_id") >= 0), slotted.where(F.col("sequence_id") < 0).drop("sequence_id")
    filled = cut(inside.groupBy("sequence_id").agg((capacity - F.sum("length")).cast("int").alias("room")).withColumnRenamed("sequence_id", "row"))
    rooms, small = counted(filled, "room"), counted(outside, "length")
    moves, new = best_fit(small, rooms, capacity)
    key = moves[:, 0] * (1 << 40) + moves[:, 1]
    order = np.argsort(key)
    key, moves = key[order], moves[order]

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy().astype(np.int64) for k in ("length", "rank"))
            m = moves[np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(m[:, 2].astype(np.int32)), pa.array(m[:, 3] + rank - m[:, 1])], [*batch.schema.names[:4], "room", "place"])

    fitted = cut(ranked(outside, "length", small).select(columns).mapInArrow(fit, f"doc_id {kind}, row long, length int, ids_crc32 long, room int, place long"))
    added = fitted.where(F.col("room") < 0).select("doc_id", "row", "length", "ids_crc32", (F.col("place") + plan.sequences).alias("sequence_id"))
    into = ranked(filled, "room", rooms).select("room", F.col("rank").alias("place"), F.col("row").alias("sequence_id"))
    topped = fitted.where(F.col("room") >= 0).join(into, ["room", "place"]).select("doc_id", "row", "length", "ids_crc32", "sequence_id")
    shared = inside.unionByName(added).unionByName(topped)
    order_in = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "row").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(order_in), F.lit(0)).cast("long").alias("offset"))
    full = (F.col("n_tokens") / capacity).cast("long")
    long_rows = tokens.where(full > 0).select("doc_id", "row", "n_tokens", "crcs", full.alias("full"), F.lit(0).alias("one"))
    n_long = np.zeros(CAPACITY + 1, np.int64)
    n_long[0] = long_rows.count()
    numbered = ranked(long_rows, "one", n_long, "full")
    first = (F.col("n_tokens") % capacity > 0).cast("int")
    alone = numbered.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1))).select("doc_id", (first + F.col("k")).cast("int").alias("piece"), (F.col("n_tokens") % capacity + F.col("k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.get("crcs", (first + F.col("k")).cast("int")).alias("ids_crc32"), (F.col("rank") + F.col("k") + plan.sequences + new).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)


def pack_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Tokenise and pack whole documents; every token is in exactly one sequence and no sequence is longer than CAPACITY.

    A null text counts as empty: one token, the end id.  Repeated rows, and rows with a null id, are packed each.  Texts of any
    length are cut into full pieces but for the first.  An empty table gives no rows; other columns are not read.
    """
    return pack(cut(tokenised(docs, path, pattern)))
