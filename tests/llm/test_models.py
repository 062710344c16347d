"""Language ID and toxicity: accuracy on the held-out fold, gradients, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from labcurate.llm import gru, langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_backward_matches_differences():
    rng = np.random.default_rng(0)
    pre, u = rng.standard_normal((5, 9, 2)).astype(np.float32), 0.5 * rng.standard_normal((9, 3)).astype(np.float32)
    g = rng.standard_normal((5, 3, 2)).astype(np.float32)
    for back in (False, True):
        h, cache = gru.forward(pre, u, back)
        d_pre, d_u = gru.backward(g, cache, u, back)
        for x, d in ((pre, d_pre), (u, d_u)):
            for at in [tuple(rng.integers(0, n) for n in x.shape) for _ in range(8)]:
                e, old = 1e-2, x[at]
                x[at] = old + e
                up = (gru.forward(pre, u, back)[0] * g).sum()
                x[at] = old - e
                down = (gru.forward(pre, u, back)[0] * g).sum()
                x[at] = old
                assert abs((up - down) / (2 * e) - d[at]) < 0.05 + 0.05 * abs(d[at])


def test_language_id_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op3_language_id(spark, SF).join(docs, "doc_id").where("held_out")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 150 and right / n > 0.97


def test_language_id_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 %% \n", "de"), (4, "the cat and the dog " * 9000, None), (4, "the cat", None)] + [(10 + i, t, l) for i in range(12) for t, l in (("the house of the and with this", "en"), ("der die und nicht über für", "de"))]
    df = spark.createDataFrame([(*r, 0.1, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df).where("doc_id < 5").collect()]
    assert [(a, b, c) for a, b, c in got if a < 4] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert all(b in ("en", "de") and 0 <= c <= 1 for a, b, c in got if a == 4)
    assert langid.identify(df.where("false")).count() == 0
    assert langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_toxicity_on_the_held_out_fold(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op5_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in got if r.toxic], [r.predicted for r in got if not r.toxic]
    assert sum(toxic) / len(toxic) > 0.5 and sum(clean) / len(clean) < 0.08


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "!!! ...", 0), (4, "word " * 30000, 0), (4, "word", 0), (None, "x", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.detect(docs, labels).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 and p == int(s >= 0.3) for _, s, p in got)
    assert [(s, p) for i, s, p in got if i in (1, 2, 3)] == [(0.0, 0)] * 3
    assert toxicity.detect(docs.where("false"), labels).count() == 0


def test_every_window_is_scored_and_batches_do_not_matter():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    model = toxicity.train([(k % 2, " ".join(rng.choice(words[30 * (k % 2) :], 50))) for k in range(8)])
    texts = [" ".join(rng.choice(words, n)) for n in (1, 31, 32, 33, 96, 97, 500)]
    alone = [model.score([t])[0] for t in texts]
    assert np.allclose(model.score(texts[::-1])[::-1], alone, rtol=1e-6)
    for t, s in zip(texts, alone, strict=True):
        split = t.split()
        layout = toxicity.Layout(np.array([len(split)]))
        flat = np.zeros(layout.size, np.intp)
        flat[layout.at[0] : layout.at[0] + len(split)] = [model.memo[w] for w in split]
        weight, evidence = (x[layout.at[0] :][: len(split)] for x in model.places(model.table, flat, layout))
        z = [evidence[i : i + 32].sum() / weight[i : i + 32].sum() for i in range(max(1, len(split) - 31))]
        assert np.isclose(s, 1 / (1 + np.exp(-(max(z) + model.params["bias"][0]))), rtol=1e-4)
