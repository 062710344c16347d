"""Each stage's decisions on what the one before kept, the whole run against plain Python, and odd tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from labcurate.llm import packing
from labcurate.llm.common import cut
from tests.llm.test_similarity import brute

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
PLANTED, COPIES = 10**6, 2 * 10**6


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with rows without a language, copies of clean documents, a long one and a repeated row."""
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    odd = spark.createDataFrame([(PLANTED + i, t, None, None, None) for i, t in enumerate([None, "", " \t\n", "12 34", "!?"])], docs.schema)
    some = docs.where("doc_id % 5 = 0 AND text IS NOT NULL")
    exact = some.withColumn("doc_id", F.col("doc_id") + COPIES)
    near = some.where("doc_id % 10 = 0").select((F.col("doc_id") + 2 * COPIES).alias("doc_id"), F.concat("text", F.lit(" again")).alias("text"), *docs.columns[2:])
    longest = docs.orderBy(F.length("text").desc()).limit(1).select((F.col("doc_id") + 3 * COPIES).alias("doc_id"), F.expr("repeat(text || ' ', 60)").alias("text"), *docs.columns[2:])
    docs.unionByName(odd).unionByName(exact).unionByName(near).unionByName(longest).unionByName(docs.where("doc_id = 1")).write.parquet(f"{at}/documents.parquet")
    return at


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_run_matches_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert list(STAGES) == ["language_id", "toxicity", "near_duplicates", "packing"]
    known = cut(STAGES["language_id"](spark, docs, folder))
    assert known.columns == docs.columns and known.where(F.col("doc_id").between(PLANTED, PLANTED + 9)).count() == 0
    lettered = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert 0.97 * lettered < known.count() <= lettered

    clean = cut(STAGES["toxicity"](spark, known, folder))
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before, left = ([toxic.get(i) for i, _ in rows_of(df)] for df in (known, clean))
    assert clean.columns == docs.columns and left.count(0) > 0.95 * before.count(0)
    assert left.count(1) < 0.5 * before.count(1)

    rows = rows_of(clean)
    single = cut(STAGES["near_duplicates"](spark, clean, folder))
    groups = brute(sorted(set(rows)))
    want = sorted((i, t) for i, t in set(rows) if groups[i][1] == i)
    assert single.columns == docs.columns and sorted(rows_of(single)) == want and len(want) < len(rows)

    library, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, t in want:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        pieces += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.pieces_of(len(ids) // 4))]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(pieces)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY
    assert len(ends) <= 1.05 * sum(p[3] for p in pieces) / packing.CAPACITY + 2


def test_stages_take_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_near_duplicates_of_repeated_and_clashing_rows(spark):
    rows = [(5, "a b c d"), (5, "other text entirely here"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (8, None), (8, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, set_id string, component_id string")
    got = STAGES["near_duplicates"](spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(str, rows_of(got))) == sorted(map(str, [(3, "a b c d"), (5, "other text entirely here"), (8, None), (8, None), (None, "a b c d")]))


def test_stages_keep_columns_that_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60").withColumns({"Score": F.lit(42.0), "lang_pred": F.lit("mine"), "predicted": F.col("doc_id").cast("string")})
    for name in ("language_id", "toxicity"):
        got = STAGES[name](spark, docs, folder)
        rows = got.collect()
        assert got.columns == docs.columns and got.dtypes == docs.dtypes and rows
        assert all((r["Score"], r.lang_pred, r.predicted) == (42.0, "mine", str(r.doc_id)) for r in rows)
