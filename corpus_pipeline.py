"""Corpus pipeline: language ID, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  The first three return the columns of
documents; the last returns the packed pieces.  An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labcurate.llm import hyperminhash, langid, packing, toxicity
from labcurate.llm.common import cut

#: A document is rejected as of no known language below this probability, or where the label is ``und``.
LEAST_LANGUAGE_SCORE = 0.4


def beside(docs: DataFrame, names: tuple[str, ...], kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``kept(docs)`` with the columns of ``docs`` as they were: own columns that have one of the names stand aside meanwhile."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    return kept(docs.withColumnsRenamed(own)).withColumnsRenamed({c: f"__{c}" for c in names}).withColumnsRenamed({b: a for a, b in own.items()}).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, texts without a letter and texts of no known language go.  Each row is judged by its text alone: repeated rows, and
    rows that share an id, stay or go with their texts; long texts are read whole; a score equal to the bound stays."""
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return beside(docs, ("lang_pred", "score"), lambda rows: langid.identify(rows).where(known))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.  Each row is judged by its text alone, read whole; null and empty texts stay, repeated rows fare
    alike, and a score equal to the bound goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return beside(docs, ("score", "predicted"), lambda rows: toxicity.detect(rows, labels).where(F.col("predicted") == 0))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, one with its smallest id; repeated rows are such a group, and rows that share an
    id without being alike are not."""
    return hyperminhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: one row for each piece.  Every row is a document of its own, repeated ones too; texts longer
    than a sequence are cut into pieces; equally long pieces may change places; other columns are not read."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: The models and the packing cannot be expressed in SQL; tests hold each stage's operator against brute force or held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
