"""Approximate nearest neighbours by largest inner product: score-aware quantisation, four-bit table scans, exact reranking.

A code has four bits for each pair of coordinates.  Codebooks and codes minimise a loss that weighs the part of the residual
parallel to the vector more than the rest, because that part moves the largest inner products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labcurate.llm.common import cut
from labcurate.llm.vectors import matrix, stored_type, usable

#: Vectors that the codebooks are fitted on.
SAMPLE = 20_000
WORDS, PAIR = 16, 2
#: Weight of the parallel part of the residual against the rest.
PARALLEL = 4.0
ROUNDS = 6
#: Queries and candidates in one block (of candidates up to four times as many in large tables), and candidates of a block whose exact
#: scores set the bar for the others of each query; k + 1 where that is more.
QUERY_BLOCK, CANDIDATE_BLOCK, RERANKED = 16_384, 4096, 192
_SCAN = 256  # queries scanned at once
_GATHERED = 1 << 23  # numbers gathered at once for exact scores


class Quantiser:
    """books: (subspaces, WORDS, PAIR)"""

    def __init__(self, books: np.ndarray):
        self.books = books

    @staticmethod
    def shaped(x: np.ndarray) -> np.ndarray:
        """(rows, subspaces, PAIR); an odd last coordinate gets a zero beside it."""
        x = np.asarray(x, float)
        return np.pad(x, ((0, 0), (0, x.shape[1] % PAIR))).reshape(len(x), -1, PAIR)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces): nearest words first, then subspace after subspace the word with the least score-aware loss."""
        s = self.shaped(x)
        rows, subspaces, _ = s.shape
        weight = (PARALLEL - 1) / np.maximum((s * s).sum(axis=(1, 2)), 1e-300)
        codes = np.empty((rows, subspaces), np.uint8)
        along = np.zeros(rows)  # inner product of vector and residual
        for m in range(subspaces):
            d = s[:, m, None, :] - self.books[m]
            codes[:, m] = (d * d).sum(axis=2).argmin(axis=1)
            along += (s[:, m] * (s[:, m] - self.books[m][codes[:, m]])).sum(axis=1)
        for _ in range(sweeps):
            for m in range(subspaces):
                d = s[:, m, None, :] - self.books[m]
                part = np.einsum("rp,rwp->rw", s[:, m], d)
                others = along - part[np.arange(rows), codes[:, m]]
                codes[:, m] = ((d * d).sum(axis=2) + weight[:, None] * (others[:, None] + part) ** 2).argmin(axis=1)
                along = others + part[np.arange(rows), codes[:, m]]
        return codes

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 3) -> Quantiser:
        rng = np.random.default_rng(seed)
        s = cls.shaped(x)
        books = np.stack([s[rng.choice(len(s), WORDS, replace=len(s) < WORDS), m] for m in range(s.shape[1])])
        out = cls(books)
        weight = (PARALLEL - 1) / np.maximum((s * s).sum(axis=(1, 2)), 1e-300)
        for _ in range(ROUNDS):
            codes = out.encode(x, sweeps=1)
            residual = s - books[np.arange(s.shape[1]), codes]
            along = (s * residual).sum(axis=(1, 2))
            for m in range(s.shape[1]):
                v = s[:, m]
                others = along - (v * residual[:, m]).sum(axis=1)
                outer = np.eye(PAIR) + weight[:, None, None] * v[:, :, None] * v[:, None, :]
                target = v + (weight * (others + (v * v).sum(axis=1)))[:, None] * v
                for k in range(WORDS):
                    if (mine := codes[:, m] == k).any():
                        books[m, k] = np.linalg.solve(outer[mine].sum(axis=0), target[mine].sum(axis=0))
                residual[:, m] = v - books[m][codes[:, m]]
                along = others + (v * residual[:, m]).sum(axis=1)
        return out

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two codes in a byte."""
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def decoded(self, packed: np.ndarray) -> np.ndarray:
        """(rows, subspaces, PAIR): the words that packed codes stand for."""
        codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, : len(self.books)]
        return self.books[np.arange(len(self.books)), codes]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes of a code, queries, 256): what each byte adds to each query's inner product."""
        t = np.einsum("qmp,mwp->mqw", self.shaped(queries), self.books)
        if len(t) % 2:
            t = np.concatenate([t, np.zeros_like(t[:1])])
        return (t[::2, :, :, None] + t[1::2, :, None, :]).reshape(len(t) // 2, len(queries), WORDS * WORDS).astype(np.float32)


def _first_copies(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Places, in ``order``, of the first ``most`` of each set of equal rows: later ones lose every tie."""
    _, which = np.unique(np.ascontiguousarray(raw[order]).view(f"V{raw.shape[1] * raw.itemsize}").ravel(), return_inverse=True)
    by_set = np.argsort(which, kind="stable")
    start = np.concatenate([[0], np.flatnonzero(np.diff(which[by_set])) + 1])
    nth = np.arange(len(by_set)) - np.repeat(start, np.diff(np.append(start, len(by_set))))
    return order[np.sort(by_set[nth < most])]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal rows give equal bits."""
    return np.einsum("pd,pd->p", a, b)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each query (a row of ``queries``, with the same columns) its k nearest by inner product.

    Candidates are all rows of ``vectors`` but those with the query's own id; fewer than k give all of them.  Scores are inner
    products of the original vectors in double precision, ties go to the smaller id.  Vectors that are null, zero or hold null or non-finite
    components take no part, nor do null ids; a query meets vectors of its own dimension.  Of repeated queries with one id one is
    searched; repeated candidates are found as often as they are there.  An empty table gives no rows.

    Queries and candidates are dealt to blocks of bounded size, and each pair of blocks is one group: table scan over the codes,
    exact reranking, the best k go on.  The k-th exact score of the best RERANKED is the bar; every other candidate is reranked too
    unless its rough score and the most that its residual can add (the product of the norms) stay below the bar, so none is lost.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    stored = stored_type(vectors, vector_col)
    good = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("v")).select("id", "v.*")
    found = vectors.sparkSession.createDataFrame([], f"query_id {kind}, vec_id {kind}, score double")
    for r in sorted(asked.groupBy("dim").count().collect()):  # mostly one
        found = found.unionByName(_found(good.where(F.col("dim") == r.dim), asked.where(F.col("dim") == r.dim), r["count"], k, kind, stored))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(good: DataFrame, asked: DataFrame, n_asked: int, k: int, kind: str, stored: np.dtype) -> DataFrame:
    """query_id, vec_id, score: of each query the k best of every block of candidates; all vectors have one dimension."""
    out_schema = f"query_id {kind}, vec_id {kind}, score double"
    rows = good.orderBy(F.xxhash64("vector", "id")).limit(SAMPLE).select("vector").collect()
    if not rows:
        return good.sparkSession.createDataFrame([], out_schema)
    sample = np.array([r.vector for r in rows], float)
    dim = sample.shape[1]
    quantiser = Quantiser.fit(sample)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector"))
                codes = [c.tobytes() for c in quantiser.packed(quantiser.encode(x))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x.astype(stored)], pa.binary()), pa.array(codes, pa.binary())], ["id", "raw", "code"])

    index = cut(good.select("id", "vector").mapInArrow(encode, f"id {kind}, raw binary, code binary"))
    asked = cut(asked.select("id", "vector").mapInArrow(encode, f"id {kind}, raw binary, code binary").drop("code"))
    total = index.count()
    query_blocks = math.ceil(n_asked / QUERY_BLOCK)
    blocks = math.ceil(total / min(4 * CANDIDATE_BLOCK, max(CANDIDATE_BLOCK, total // 12)))
    deal = lambda n: F.pmod(F.xxhash64("id", "raw"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", deal(query_blocks)).withColumn("c", each(blocks)).select("q", "c", "id", "raw", F.lit(None).cast("binary").alias("code"))
    right = index.withColumn("c", deal(blocks)).withColumn("q", each(query_blocks)).select("q", "c", "id", "raw", "code")

    def scan(key: tuple, group: pa.Table) -> pa.Table:
        is_query = group.column("code").is_null().to_numpy()
        ids = group.column("id").to_numpy()
        raw = np.frombuffer(b"".join(group.column("raw").to_pylist()), stored).reshape(-1, dim).astype(float)
        candidates = np.flatnonzero(~is_query)
        out = {"query_id": [], "vec_id": [], "score": []}
        if is_query.any() and len(candidates):
            candidates = _first_copies(raw, candidates[np.argsort(ids[candidates], kind="stable")], k + 1)
            x = raw[candidates]
            code = np.frombuffer(b"".join(group.column("code").take(pa.array(candidates)).to_pylist()), np.uint8).reshape(len(candidates), -1)
            words = quantiser.decoded(code)
            code = np.ascontiguousarray(code.T).astype(np.intp)
            # The residual's norm, and what single precision in the tables and double precision in the products can be off by.
            rounding = (len(code) + 4) * 2.0**-23
            close = dim * 2.0**-51 * np.sqrt((x * x).sum(axis=1))
            slack = np.sqrt(((quantiser.shaped(x) - words) ** 2).sum(axis=(1, 2))) + rounding * np.sqrt((words * words).sum(axis=(1, 2))) + close
            most, step = min(max(RERANKED, k + 1), len(candidates)), max(1, _GATHERED // (_SCAN * dim))
            at_query = np.flatnonzero(is_query)
            for at in range(0, len(at_query), _SCAN):
                q = at_query[at : at + _SCAN]
                norm = np.sqrt((raw[q] * raw[q]).sum(axis=1))
                tables = quantiser.tables(raw[q])
                rough = np.take(tables[0], code[0], axis=1)
                for m in range(1, len(tables)):
                    rough += np.take(tables[m], code[m], axis=1)
                best = np.argpartition(-rough, most - 1, axis=1)[:, :most] if most < len(candidates) else np.broadcast_to(np.arange(most), (len(q), most))
                exact = _products(np.repeat(raw[q], most, axis=0), x[best.ravel()]).reshape(best.shape)
                exact = np.where(ids[candidates[best]] == ids[q][:, None], -np.inf, exact)
                bar = np.partition(exact, most - k, axis=1)[:, most - k] if most >= k else np.full(len(q), -np.inf)
                may = ~(rough + norm[:, None] * slack < bar[:, None])
                np.put_along_axis(may, best, True, axis=1)
                wanted = np.flatnonzero(may.any(axis=0))
                parts = []
                for start in range(0, len(wanted), step):
                    some = wanted[start : start + step]
                    near = raw[q] @ x[some].T + norm[:, None] * close[some]
                    row, column = np.nonzero(may[:, some] & ~(near < bar[:, None]))
                    column = some[column]
                    other = ids[candidates[column]] != ids[q][row]
                    row, column = row[other], column[other]
                    parts.append((row, column, _products(raw[q[row]], x[column])))
                row, column, score = (np.concatenate(p) for p in zip(*parts, strict=True))
                order = np.lexsort((column, -score, row))  # candidates are in the order of their ids
                nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                order = order[nth < k]
                out["query_id"].append(ids[q][row[order]])
                out["vec_id"].append(ids[candidates[column[order]]])
                out["score"].append(score[order])
        return pa.table({c: pa.array(np.concatenate(v)) if v else pa.array([], group.column("id").type if c != "score" else pa.float64()) for c, v in out.items()})

    return left.unionByName(right).groupBy("q", "c").applyInArrow(scan, out_schema)
