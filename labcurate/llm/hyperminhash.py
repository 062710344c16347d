"""Near-duplicates by HyperMinHash: compressed registers, banding, a corrected estimate, then the exact test on whole sets.

A register keeps, of the smallest hash in its bucket, the count of leading zeros and the bits after the first one.  Documents with
equal sets are one class from the start; classes that share a band are compared by their registers, and only pairs that the
estimate lets through are tested on their shingles.  Between the steps only numbers of classes move; the texts of classes with a
candidate are fetched when they are tested.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labcurate.llm.common import BROADCAST_ROWS, bounded_batches, cut, discard, join_unique, make_way, only, small_batches
from labcurate.llm.components import components

SHINGLE = 3
#: Documents are linked from this share (a fraction: numerator, denominator) of common shingles on.
SHARE = (85, 100)
REGISTERS, MANTISSA = 256, 10
#: 36 bands of 7 registers: a pair at the threshold shares none with a chance of 1e-6.
BANDS, ROWS = 36, 7
#: Standard deviations below the threshold at which the estimate still lets a pair through.
MARGIN = 3.5
TILE = 256
#: Shingles of the members that one group tests against their pivot, about.
GROUP_SHINGLES = 1 << 19

_PROBES = np.random.default_rng(5).integers(0, REGISTERS, (256, REGISTERS)).astype(np.int16)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words than SHINGLE the whole sequence is one.  Empty for no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: ASCII letters and ASCII space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        return _mix(np.array([xxhash.xxh3_64_intdigest(w.tobytes())], np.uint64))
    h = w[: len(w) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        h = _mix(h + _M[0]) + w[k : len(w) - SHINGLE + 1 + k]
    return np.unique(_mix(h))


def registers(shingles: np.ndarray) -> np.ndarray:
    """(REGISTERS,) uint16.  The top bits of a hash name its bucket, so a sorted set has each bucket's minimum first.

    A bucket without shingles takes the register of the first filled bucket on its own fixed path, which keeps the chance that two
    sets agree in a register at their similarity, however small the sets.
    """
    bits = REGISTERS.bit_length() - 1
    bucket = (shingles >> np.uint64(64 - bits)).astype(np.intp)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (shingles[first] << np.uint64(bits)) | np.uint64((1 << bits) - 1)
    zeros = 64 - np.frexp(rest.astype(np.float64))[1]  # rounding up to a power of two only moves a value to the next register, for all sets alike
    zeros = np.clip(zeros, 0, 62)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out, filled = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[bucket[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    filled[bucket[first]] = True
    empty = np.flatnonzero(~filled)
    for probe in _PROBES:
        if not len(empty):
            break
        hit = filled[probe[empty]]
        out[empty[hit]] = out[probe[empty[hit]]]
        empty = empty[~hit]
    if len(empty):
        out[empty] = out[bucket[first[0]]]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the share of equal registers, less what chance collisions add (a third of leading-zero counts agree, and one in 2^MANTISSA mantissas)."""
    chance = 1 / (3 * 2**MANTISSA)
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b) and SHARE[1] * common >= SHARE[0] * (len(a) + len(b) - common))


_LET = SHARE[0] / SHARE[1] - MARGIN * float(np.sqrt(SHARE[0] / SHARE[1] * (1 - SHARE[0] / SHARE[1]) / REGISTERS))


def _text_hash() -> Column:
    """With the id it tells a row from any other with another text."""
    return F.xxhash64("text")


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (128-bit digest of the set, null if empty), sketch (registers) for each row; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_way("hyperminhash")
        for batch in bounded_batches(batches, "text", 1 << 20):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_id", "sketch"])

    return small_batches(docs).select("doc_id", _text_hash().alias("text_hash"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, set_id binary, sketch binary")


def _let_through(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes those whose registers' estimate is near the threshold or above, with the estimate and b's size."""
    some = cut(only(classes.select("node", "sketch", "n_shingles"), pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), ["node"]))
    a = some.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    b = some.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("size"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("sa", "sb"))
                e = estimate(x, y)
                out = pa.RecordBatch.from_arrays([*batch.select(["a", "b", "size"]).columns, pa.array(e)], ["a", "b", "size", "estimate"])
                yield out.filter(pa.array(e >= _LET))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "size", "sa", "sb").mapInArrow(run, "a long, b long, size long, estimate double")


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of one document of each class in nodes (node)."""
    one = only(classes.select("node", "doc_id", "text_hash"), nodes.distinct(), ["node"])
    found = only(docs.select("doc_id", _text_hash().alias("text_hash"), "text"), one, ["doc_id", "text_hash"]).select("node", "text")
    return found.groupBy("node").agg(F.first("text").alias("text"))  # a row that is repeated brings the same text again


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) those linked by the exact test.  A pivot a meets its members in groups of bounded size, its text once in each."""
    per = pairs.groupBy("a").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"))
    dealt = join_unique(pairs.select("a", "b"), per, "a", "n").withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("sizes") / GROUP_SHINGLES)))
    dealt = cut(dealt.select("a", "chunk", F.col("b").alias("node")))
    members = dealt.unionByName(dealt.select("a", "chunk", F.col("a").alias("node")).distinct())

    def test(group: pa.Table) -> pa.Table:
        nodes, pivot = group.column("node").to_pylist(), group.column("a")[0].as_py()
        texts = group.column("text")
        at = nodes.index(pivot)
        one = shingle_set(texts[at].as_py())
        out = [n for i, n in enumerate(nodes) if i != at and linked(one, shingle_set(texts[i].as_py()))]
        return pa.table({"a": pa.array([pivot] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    texts = _texts(dealt.select(F.explode(F.array("a", "node")).alias("node")), classes, docs)
    return members.join(texts, "node").groupBy("a", "chunk").applyInArrow(test, "a long, b long")


def _candidates(regs: np.ndarray, part: np.ndarray, own: np.ndarray, key: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """Of a pair of tiles: each row of the first with the rows of the second that lie in another component, that the estimate lets
    through, and that share no earlier band, where the pair has been seen to."""
    at, i, j = key
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    earlier = regs[:, : at * ROWS].reshape(len(regs), at, ROWS)
    for x in left:
        near = right[(part[right] != part[x]) & (estimate(regs[x], regs[right]) >= _LET)]
        if i == j:
            near = near[near > x]
        if len(near):
            near = near[~(earlier[near] == earlier[x]).all(axis=2).any(axis=1)]
        if len(near):
            yield x, near


def _tiled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of bands that lie in more than one component, dealt to tiles of about TILE: band, i, j, own, node, component.

    A component with more members than TILE in a band has tiles of its own there, and two tiles of one component do not meet: a
    component that fills a band costs its size times the few tiles of the others, not its square.
    """
    m = members.select("band", "node", "n").join(labels, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    per = m.groupBy("band", "component").agg(F.count("*").alias("c"))
    large = F.when(F.col("c") > TILE, F.struct("component", F.ceil(F.col("c") / TILE).cast("int").alias("tiles")))
    info = per.groupBy("band").agg(F.count("*").alias("parts"), F.sum("c").alias("n"), F.ceil(F.coalesce(F.sum(F.when(F.col("c") <= TILE, F.col("c"))), F.lit(0)) / TILE).cast("int").alias("mixed"), F.array_sort(F.collect_list(large)).alias("large")).where(F.col("parts") > 1)
    m = join_unique(m.drop("n"), info, "band", "n")
    place = F.array_position(F.transform("large", lambda x: x.component), F.col("component")).cast("int")
    tiles_of = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x.tiles)
    m = m.withColumn("place", place).withColumn("first", F.when(F.col("place") > 0, F.col("mixed") + tiles_of(F.slice("large", F.lit(1), F.col("place") - 1))))
    mine = F.when(F.col("place") > 0, F.get("large", F.col("place") - 1)["tiles"])
    m = m.withColumn("mine", mine).withColumn("tiles", F.col("mixed") + tiles_of(F.col("large")))
    own = F.when(F.col("place") > 0, F.col("first") + F.pmod(F.xxhash64("node"), F.col("mine"))).otherwise(F.pmod(F.xxhash64("component"), F.greatest("mixed", F.lit(1))))
    other = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.col("first").isNull() | (t < F.col("first")) | (t >= F.col("first") + F.col("mine")))
    m = m.withColumn("own", own.cast("int")).withColumn("other", F.explode(other))
    return m.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")


def _links_left_over(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between members of a band that lie in different components.

    Each pair of tiles is a group of bounded size.  The registers show which members have a candidate in a group at all; those meet
    again with their texts, and the exact test runs inside the group, so that pairs are never rows.  Every candidate is tested
    unless links found in the group have joined its components by then.
    """
    m = cut(_tiled(members, labels))
    names = ["band", "i", "j", "own", "node", "component"]

    def columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple]:
        band, i, j = (group.column(k)[0].as_py() for k in ("band", "i", "j"))
        return group.column("component").to_numpy().copy(), group.column("own").to_numpy(), (band & 63, i, j)

    def flag(group: pa.Table) -> pa.Table:
        regs = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        some = np.zeros(len(regs), bool)
        for x, near in _candidates(regs, *columns(group)):
            some[x] = some[near] = True
        return group.select(names).filter(pa.array(some))

    def confirm(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_numpy()
        sets = [shingle_set(t.as_py()) for t in group.column("text")]
        out: list[tuple[int, int]] = []
        part, own, key = columns(group)
        for x, near in _candidates(np.stack([registers(s) for s in sets]), part, own, key):
            for y in near:
                if part[x] != part[y] and linked(sets[x], sets[y]):
                    out.append((int(ids[x]), int(ids[y])))
                    part[part == part[y]] = part[x]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    some = only(classes.select("node", "sketch"), m.select("node").distinct(), ["node"])
    flagged = cut(m.join(some, "node").groupBy("band", "i", "j").applyInArrow(flag, "band long, i int, j int, own int, node long, component long"))
    texts = _texts(flagged.select("node"), classes, docs)
    found = cut(flagged.join(texts, "node").groupBy("band", "i", "j").applyInArrow(confirm, "a long, b long"))
    discard(flagged, m)
    return found


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: what sketch() returns but the registers; names: set_id, n, component_id, kept_hash for each class).

    component_id is the smallest doc_id of the class's component and kept_hash the text of the one row with it that stays.
    """
    rows = cut(sketch(docs))
    real = rows.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = real.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    classes = cut(classes.select("set_id", "n", "n_shingles", "sketch", "f.*", F.monotonically_increasing_id().alias("node")))
    # The lowest six bits of a band's key are its number.
    band = lambda i: F.shiftleft(F.shiftright(F.xxhash64(i, F.col("sketch").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS))), 6), 6).bitwiseOR(i.cast("long"))
    bands = classes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where(F.col("n") > 1)
    members = cut(bands.join(shared, "band"))
    pairs = cut(members.where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    # Each class is tested against its likeliest pivot first; what that leaves in different components comes next.
    likeliest = _let_through(pairs, classes).groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"), F.first("size").alias("size"))
    links = cut(_confirmed(likeliest, classes, docs))
    labels = cut(components(links))
    more = _links_left_over(members, labels, classes, docs)
    discard(labels, members)
    labels = components(links.unionByName(more))
    best = classes.select("set_id", "n", "node", F.struct("doc_id", "text_hash").alias("f")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = cut(best)
    least = best.groupBy("component").agg(F.min("f").alias("least"), F.count("*").alias("c"))
    names = join_unique(best, least, "component", "c").select("set_id", "n", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("kept_hash"))
    names = cut(names)
    discard(links, more, classes, best, pairs)
    return rows.drop("sketch"), names


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``; other columns are not read.

    Documents link where SHARE of the union of their shingles is common; component_id is the smallest doc_id reachable by links.
    Null and empty texts, and texts without words, have 0 shingles and link with nothing.  Repeated rows are copies like any other
    and get the same answer.  A row with a null doc_id links nothing, has a null component_id and is kept.  Very long texts are
    compared whole.  An empty table gives no rows.
    """
    rows, names = _grouped(docs)
    real = rows.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    alone = rows.where(F.col("set_id").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = join_unique(real, names, "set_id", "n").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one row of each group of near-duplicates, one of those with its smallest doc_id.

    Rows decide, not ids: of rows that share an id but belong to different groups each group keeps its own.  Rows with a null id or
    without words stay.  ``docs`` is read once more for the result, joined by id and a hash of the text with the rows that go.
    """
    rows, names = _grouped(docs)
    real = rows.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    keys = join_unique(real, names, "set_id", "n").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("kept_hash"))).alias("__stays"))
    keys = keys.groupBy("__id", "__hash").agg(F.max("__stays").alias("__stays"), F.count("*").alias("__n"))
    keys = cut(keys.where(~F.col("__stays") | (F.col("__n") > 1)).select("__id", "__hash", "__stays"))
    few = keys.count() <= BROADCAST_ROWS  # else documents and keys meet by a shuffle
    met = docs.join(F.broadcast(keys) if few else keys, (F.col("doc_id") == F.col("__id")) & (_text_hash() == F.col("__hash")), "left")
    repeated = met.where("__stays").dropDuplicates(["__id", "__hash"])
    return met.where(F.col("__stays").isNull()).unionByName(repeated).select(docs.columns)
