"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are turned to their principal axes, largest variance first, and dealt to boxes that halve the axes with the widest spread
again and again; a box's vectors make one or more tiles.  Two tiles are compared only where their boxes come near enough.  Inside a
pair of tiles the products of the leading coordinates plus the product of the norms of the rest bound the cosine from above; a pair
of vectors is given up as soon as the bound is below the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labcurate.llm.common import cut, discard, join_unique
from labcurate.llm.components import components
from labcurate.llm.vectors import matrix, stored_type, usable

COSINE = 0.95
#: Vectors in a tile, up to four times as many in large tables.
TILE = 4096
#: Most boxes, and the axes that they lie in.  Each has one row in the tables that are broadcast.
BOXES, BOX_AXES = 1024, 8
#: Vectors that the principal axes and the boxes are fitted on.  They only order the work; any give the same links.
SAMPLE = 16_384
LEADING = 16
STRIP = 1024
_SLACK = 1e-5  # of single-precision bounds


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow and underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Sets:
    """Disjoint sets over 0..n-1; a set's name is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _flatten(self) -> None:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            self._flatten()
            x, y = self.parent[a], self.parent[b]
            differ = x != y
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(x[differ], y[differ]), np.minimum(x[differ], y[differ]))


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float):
    """Yield (rows of x, rows of y) whose cosine is at the threshold or above, strip by strip.  x, y: unit vectors on principal axes."""
    dim = x.shape[1]
    ends = sorted({min(LEADING, dim), min(2 * LEADING, dim), dim})
    rest = lambda v, d: np.sqrt(np.maximum((v[:, d:] ** 2).sum(axis=1), 0))
    # The bound is one product: leading coordinates, and the norm of the rest as one more.
    lead = lambda v: np.concatenate([v[:, : ends[0]], rest(v, ends[0])[:, None]], axis=1).astype(np.float32)
    ly, tails = lead(y).T.copy(), {d: rest(y, d) for d in ends}
    for at in range(0, len(x), STRIP):
        xs = x[at : at + STRIP]
        a, b = np.nonzero(lead(xs) @ ly >= threshold - _SLACK)
        if len(a) > 0.02 * len(xs) * len(y):  # so many are left that a full product costs less than picking pairs
            a, b = np.nonzero(xs @ y.T >= threshold)
            yield a + at, b
            continue
        got = np.zeros(len(a))
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            for k in range(0, len(a), 1 << 16):
                part = slice(k, k + (1 << 16))
                got[part] += np.einsum("ij,ij->i", xs[a[part], begin:end], y[b[part], begin:end])
            keep = got + (rest(xs, end)[a] * tails[end][b] + 1e-12 if end < dim else 0.0) >= threshold
            a, b, got = a[keep], b[keep], got[keep]
        yield a + at, b


class _Boxes:
    """A tree of halvings: node k has the children 2k+1 and 2k+2; the leaves are the boxes."""

    def __init__(self, sample: np.ndarray, boxes: int):
        self.depth = max(0, math.ceil(math.log2(boxes)))
        self.axis, self.at = np.zeros(2**self.depth, np.intp), np.zeros(2**self.depth)
        parts = {0: sample}
        for k in range(2**self.depth - 1):
            x = parts.pop(k)
            if len(x):
                self.axis[k] = np.ptp(x, axis=0).argmax()
                self.at[k] = np.median(x[:, self.axis[k]])
            high = x[:, self.axis[k]] >= self.at[k]
            parts[2 * k + 1], parts[2 * k + 2] = x[~high], x[high]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.intp)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return (node - (2**self.depth - 1)).astype(np.int32)


def _compared(key: tuple, group: pa.Table, axes: np.ndarray | None, stored: np.dtype, threshold: float) -> pa.Table:
    """Links inside a pair of tiles: class_id, root (the smallest class reached here), links.  Without axes the group's own are taken."""
    i, j = (k.as_py() for k in key)
    x = _unit(np.frombuffer(b"".join(group.column("raw").to_pylist()), stored).reshape(group.num_rows, -1).astype(float))
    x = x @ (principal(x) if axes is None else axes)
    ids, n, tile = (group.column(k).to_numpy() for k in ("class_id", "n", "tile"))
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    links, sets = np.zeros(len(ids), np.int64), _Sets(len(ids))
    order = np.argsort(ids)  # sets are named by places in this order, so by the smallest class
    place = np.empty(len(ids), np.intp)
    place[order] = np.arange(len(ids))
    for a, b in linked_pairs(x[left], x[right], threshold):
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a != b], b[a != b]  # both directions come out
        links += np.bincount(a, weights=n[b], minlength=len(ids)).astype(np.int64)
        if i != j:
            links += np.bincount(b, weights=n[a], minlength=len(ids)).astype(np.int64)
        sets.join(place[a], place[b])
    sets._flatten()
    some = links > 0
    return pa.table({"class_id": ids[some], "root": ids[order][sets.parent[place]][some], "links": links[some]})


_FOUND = "class_id long, root long, links long"


def principal(x: np.ndarray) -> np.ndarray:
    values, axes = np.linalg.eigh(x.T @ x)
    return axes[:, np.argsort(-values)]


def _linked(classes: DataFrame, total: int, stored: np.dtype, threshold: float) -> DataFrame:
    """_FOUND of the ``total`` classes (class_id, n, vector, all of one dimension), tile pair by tile pair."""
    rows = classes.orderBy(F.xxhash64("class_id")).limit(SAMPLE).select("vector").collect()
    sample = _unit(np.array([r.vector for r in rows], float))
    axes = principal(sample)
    per_tile = min(4 * TILE, max(TILE, total // 12))
    boxes = _Boxes(sample @ axes[:, :BOX_AXES], min(BOXES, math.ceil(total / per_tile)))

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                whole = matrix(batch.column("vector"))
                lead = _unit(whole) @ axes[:, :BOX_AXES]
                raw = pa.array([r.tobytes() for r in whole.astype(stored)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("n"), raw, pa.array(boxes.of(lead)), pa.array(list(lead), pa.list_(pa.float64()))], ["class_id", "n", "raw", "box", "lead"])

    placed = cut(classes.select("class_id", "n", "vector").mapInArrow(project, "class_id long, n long, raw binary, box int, lead array<double>"))
    ends = [f(F.get("lead", k)).alias(f"{name}{k}") for name, f in (("lo", F.min), ("hi", F.max)) for k in range(sample.shape[1])[:BOX_AXES]]
    stats = sorted(placed.groupBy("box").agg(F.count("*").alias("c"), *ends).collect())  # at most BOXES rows
    bounds = np.array([r[2:] for r in stats])
    lo, hi = np.split(bounds, 2, axis=1)
    reach = max(0.0, 2 - 2 * threshold) + 1e-9
    apart = sum(np.maximum(0, np.maximum(lo[:, None, k] - hi[None, :, k], lo[None, :, k] - hi[:, None, k])) ** 2 for k in range(lo.shape[1]))
    first, parts, near = 0, [], []
    for r, row in zip(stats, apart, strict=True):
        # A box that holds many is split by a hash; its parts share its bounds.
        parts.append((r.box, first, max(1, math.ceil(r.c / per_tile))))
        near.append((r.box, [stats[k].box for k in np.flatnonzero(row <= reach)]))
        first += parts[-1][2]
    spark = classes.sparkSession
    tiles = spark.createDataFrame(parts, "box int, first int, parts int")
    reached = spark.createDataFrame(near, "box int, near array<int>")
    dealt = placed.join(F.broadcast(tiles), "box").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("class_id"), F.col("parts"))).cast("int"))
    dealt = dealt.join(F.broadcast(reached), "box").select("class_id", "n", "raw", "tile", F.explode("near").alias("box"))
    dealt = dealt.join(F.broadcast(tiles), "box").withColumn("other", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)))
    dealt = dealt.select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "class_id", "n", "raw")
    return dealt.groupBy("i", "j").applyInArrow(lambda key, group: _compared(key, group, axes, stored, threshold), _FOUND)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; other columns are not read.

    Rows link where their cosine, in double precision, is ``threshold`` (above 0) or more; vectors of different dimensions do not.
    n_links counts the other rows linked directly; component_id is the smallest id reachable, the row's own included.  Vectors that
    are null, zero or hold null or non-finite components link with nothing, nor do rows with a null id (their component_id is null,
    and they are kept).  Equal vectors are compared once and counted as often as they are there, so repeated rows and ties are links
    like any other.  An empty table gives no rows.

    Dimensions with no more than TILE distinct vectors are one group each; the others are tiled one after the other.
    """
    stored = stored_type(vectors, vector_col)
    good = usable(vectors, id_col, vector_col)
    classes = cut(good.groupBy("dim", "vector").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("class_id", F.monotonically_increasing_id()))
    large = sorted(classes.groupBy("dim").count().where(F.col("count") > TILE).collect())
    small = classes.where(~F.col("dim").isin([r.dim for r in large])) if large else classes

    def raw(batches):
        for batch in batches:
            if batch.num_rows:
                values = [np.array(v, stored).tobytes() for v in batch.column("vector").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.select(["dim", "class_id", "n"]).columns, pa.array(values, pa.binary())], ["dim", "class_id", "n", "raw"])

    def whole(group: pa.Table) -> pa.Table:
        zero = pa.array(np.zeros(group.num_rows, np.int32))
        return _compared((pa.scalar(0), pa.scalar(0)), group.append_column("tile", zero), None, stored, threshold)

    found = small.mapInArrow(raw, "dim int, class_id long, n long, raw binary").groupBy("dim").applyInArrow(whole, _FOUND)
    for r in large:
        found = found.unionByName(_linked(classes.where(F.col("dim") == r.dim), r["count"], stored, threshold))
    found = cut(found)
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("class_id"), "component")
    named = classes.select("class_id", "vector", "id", "n").join(links, "class_id", "left").join(joined, "class_id", "left")
    named = cut(named.select("vector", "id", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component")))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("c"))
    named = cut(join_unique(named, least, "component", "c").select("vector", "n", "n_links", "component_id"))
    discard(classes, found)
    # Rows that take no part have no class.
    rows = vectors.select(F.col(id_col), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
    met = join_unique(rows.where(F.col(id_col).isNotNull()), named, "vector", "n").select(id_col, "n_links", "component_id")
    takes_part = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    alone = rows.where(F.col(id_col).isNull() | ~F.coalesce(takes_part, F.lit(False))).select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
