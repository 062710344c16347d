"""Near-duplicates, vector links and inner-product search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labcurate.llm import components, hyperminhash, mips, vector_dedup

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() if text else []
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus():
    rng = random.Random(4)
    docs = [None, "", "  \t", "one", "One", "one two", "one two three", "ONE two  three", "É é x", "é é x", "long " * 3000]
    base = [rng.choices(WORDS, k=rng.choice((8, 30, 120, 400))) for _ in range(25)]
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.choice((0, 0, 1, 2, len(c) // 25))):
                c[rng.randrange(len(c))] = rng.choice(WORDS)
            docs.append(" ".join(c))
    chain = rng.choices(WORDS, k=200)  # each like the next, the ends unlike each other
    for k in range(30):
        docs.append(" ".join(chain[k * 4 : k * 4 + 80]))
    return list(enumerate(docs))


def test_near_duplicates_match_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, sketch string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(df).collect()}
    assert got == brute(docs)
    assert hyperminhash.near_duplicates(df.where("false")).count() == 0


def test_near_duplicate_stage_keeps_one_of_each(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (8, None), (9, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in hyperminhash.drop_near_duplicates(df).collect()) == ["3", "8", "9", "None"]
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "q r s")], "doc_id long, text string")
    assert sorted(r.doc_id for r in hyperminhash.drop_near_duplicates(twice).collect()) == [1, 2]
    shared = [(5, "a b c d"), (5, "other text entirely here"), (3, "a b c d"), (7, "p q r s"), (7, "l m n o"), (7, "P q r  s")]
    df = spark.createDataFrame([(*r, 1, 2) for r in shared], "doc_id long, text string, text_hash int, component_id int")
    got = sorted((r.doc_id, r.text.lower().split()[0]) for r in hyperminhash.drop_near_duplicates(df).collect())
    assert got == [(3, "a"), (5, "other"), (7, "l"), (7, "p")]
    assert hyperminhash.drop_near_duplicates(df.where("false")).count() == 0


def test_a_component_that_fills_a_band_meets_the_others_only(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "TILE", 4)
    members = spark.createDataFrame([(64, k, 30) for k in range(20)] + [(64, 100 + k, 30) for k in range(10)] + [(65, 1, 2), (65, 2, 2)], "band long, node long, n long")
    labels = spark.createDataFrame([(k, 0) for k in range(20)], "node long, component long")
    rows = hyperminhash._tiled(members, labels).collect()
    meet = {}
    for r in rows:
        meet.setdefault((r.i, r.j), []).append((r.own, r.node))
    pairs = {(min(x, y), max(x, y)) for (i, j), v in meet.items() for a, x in v for b, y in v if a == i and b == j and x != y}
    assert {p for p in pairs if p[1] < 100} == set()
    assert {p for p in pairs if p[1] >= 100} == {(x, y) for x in [*range(20), *range(100, 110)] for y in range(100, 110) if x < y}


def test_links_without_the_pivot_are_found(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "TILE", 8)
    docs = corpus()[-60:]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(df).collect()} == brute(docs)


def test_registers_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    for n in (13, 60, 3000):
        got = []
        for _ in range(40):
            u = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            a, b = u[: int(n * 0.95)], u[n - int(n * 0.95) :]
            got.append(float(hyperminhash.estimate(hyperminhash.registers(a), hyperminhash.registers(b))) - len(np.intersect1d(a, b)) / n)
        assert abs(np.mean(got)) < 0.03


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 2), (5, 5), (9, 7), (7, 8), (100, 4), *[(k, k + 1) for k in range(20, 60)]]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 4: 4, 100: 4} | {k: 20 for k in range(20, 61)}
    assert components.components(df.where("false")).count() == 0


def vectors(n=700, dim=16):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, dim))
    x = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, dim)) * rng.choice([0.02, 0.15, 0.6], n)[:, None]
    x[50:60] = x[50] * 3
    x[60:120] = x[60]
    return x


ODD = [(9001, None), (9002, [0.0] * 16), (9003, [None] + [1.0] * 15), (9004, [float("nan")] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, [1.0] * 5), (9007, [])]


@pytest.mark.parametrize("tile", [64, 4096])
def test_vector_links_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    x = vectors()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(x)).min(axis=1))
        new = new[new]
        if (new == root).all():
            break
        root = new
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(i, v, 1) for i, v in ODD], "vec_id long, embedding array<double>, n int")
    short = spark.createDataFrame([(9100, [1.0, 2.0, 3.0], 1), (9101, [2.0, 4.0, 6.0], 1), (9102, [-1.0, 2.0, 3.0], 1), (None, [1.0, 2.0, 3.0], 1), (None, [1.0] * 16, 1)], df.schema)
    got = vector_dedup.near_duplicates(df.unionByName(short)).collect()
    assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, True)] * 2
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert [got.pop(i) for i in (9100, 9101, 9102)] == [(1, 9100, True), (1, 9100, False), (0, 9102, True)]
    want = {i: (int(link[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(x))} | {i: (0, i, True) for i, _ in ODD}
    assert got == want
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


def test_search_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(mips, "CANDIDATE_BLOCK", 200)
    monkeypatch.setattr(mips, "QUERY_BLOCK", 16)
    monkeypatch.setattr(mips, "RERANKED", 60)
    x = vectors()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + ODD, "vec_id long, embedding array<double>")
    got = {}
    for r in mips.search(df, df.where(F.col("vec_id") % 20 == 0)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(s[v] - z) < 1e-9 for _, v, z in found)
        assert [(-z, v) for _, v, z in found] == sorted((-z, v) for _, v, z in found)
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
        total += 20
    assert hits / total >= 0.9 and set(got) == set(range(0, len(x), 20))
    assert mips.search(df.where("false"), df.where("false")).count() == 0
    few = df.where("vec_id < 5")
    assert mips.search(few, few.where("vec_id = 0")).count() == 4
    assert mips.search(df, df.where("vec_id = 40"), k=300).count() == 300
    odd = spark.createDataFrame([(1, [1.0, 2.0], 3), (1, [1.0, 2.0], 3), (2, [3.0, 4.0], 1), (3, [1.0] * 16, 2), (None, [9.0, 9.0], 1)], "vec_id long, embedding array<float>, id int")
    found = mips.search(odd, odd).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(1, 1, 2, 11.0), (2, 1, 1, 11.0), (2, 2, 1, 11.0)]


def test_search_finds_the_nearest_among_many_near_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 64))
    x[:2000] = x[0] + 0.15 * rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = [*range(0, 2000, 100), *range(2000, 6000, 200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in mips.search(df, df.where(F.col("vec_id").isin(asked))).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        assert [got[q][k] for k in range(1, 21)] == np.argsort(-s, kind="stable")[:20].tolist()


def test_components_of_a_large_star_in_no_single_task(spark, tmp_path):
    """A centre with 100,000 leaves, and chains: every join and distinct deals the centre's edges to many tasks."""
    star = spark.range(1, 100_001).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("a"))
    chains = spark.range(0, 300).select((F.col("id") + 200_000).alias("a"), (F.col("id") + F.when(F.col("id") % 10 == 9, 0).otherwise(1) + 200_000).alias("b"))
    most = []
    inner = components.join_unique

    def watched(rows, names, key, n):
        out = inner(rows, names, key, n)
        sizes = rows.groupBy(key).count().join(names, key).agg(F.max(F.when(F.col(n) <= max(1024, names.agg(F.sum(n)).first()[0] // 1000), F.col("count")))).first()[0]
        most.append(sizes or 0)
        return out

    components.join_unique = watched
    try:
        got = {r.node: r.component for r in components.components(star.select("a", "b").unionByName(chains)).collect()}
    finally:
        components.join_unique = inner
    assert len(got) == 100_001 + 300 and all(got[i] == 0 for i in range(100_001))
    assert all(got[200_000 + i] == 200_000 + i // 10 * 10 for i in range(300))
    assert most and max(most) <= 1024  # no key that is shuffled is large
