"""Keyed replacement, upsert, merging and cascading deletion over DataFrames.  The stored tables are in tables.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labcurate.operators.tables import Conflict, SnapshotTable

__all__ = ["Conflict", "SnapshotTable", "cascade_delete", "export_json", "get_or_create", "keyed_replace", "merge_filled", "merged", "new_by_hash", "replace_where_any", "update_row", "with_new_ids"]


def keyed_replace(target: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``target`` without the rows of ``keys``, and the new rows."""
    return target.join(keys.select(key).distinct(), key, "left_anti").select(target.columns).unionByName(new.select(target.columns))


def replace_where_any(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replacement only for keys that bring at least one row; others keep theirs."""
    return keyed_replace(target, new, new, key)


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    k = gone.select(key).distinct()
    return parents.join(k, key, "left_anti"), children.join(k, key, "left_anti")


def with_new_ids(df: DataFrame, existing: DataFrame | int, id_col: str, order: list[str]) -> DataFrame:
    """Adds ids that follow the greatest existing one, which may be given as a number.  Ids are dealt by sorted partition, not through
    one task.

    The rows must read the same each time (a table, not a sample): they are counted by partition first.
    """
    start = existing if isinstance(existing, int) else existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).first().m
    ordered = df.sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id())
    sizes = sorted(ordered.groupBy("__p").count().collect())
    before, total = [], start
    for r in sizes:
        before.append((r["__p"], total))
        total += r["count"]
    if not before:
        return df.withColumn(id_col, F.lit(None).cast("long"))
    offsets = df.sparkSession.createDataFrame(before, "__p int, __before long")
    numbered = ordered.join(F.broadcast(offsets), "__p")  # one row for each partition
    return numbered.withColumn(id_col, F.col("__before") + F.col("__n") - F.col("__p").cast("long") * (1 << 33) + 1).drop("__p", "__n", "__before")


def get_or_create(parents: DataFrame, incoming: DataFrame, key: str, id_col: str) -> DataFrame:
    """``incoming`` with the id of the parent that has its key and is_new; a null or empty key never matches."""
    known = parents.where(F.col(key) != "").groupBy(key).agg(F.min(id_col).alias("__id")).withColumnRenamed(key, "__key")
    out = incoming.join(known, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumn(id_col, F.col("__id")).withColumn("is_new", F.col("__id").isNull()).drop("__id")


def new_by_hash(incoming: DataFrame, known: DataFrame, hash_col: str, order: str) -> DataFrame:
    """The first of the incoming rows with each hash that is not known yet.  A row without hash has no content to store and is left out."""
    first = Window.partitionBy(hash_col).orderBy(order)
    fresh = incoming.where(F.col(hash_col).isNotNull()).join(known.select(hash_col).distinct(), hash_col, "left_anti")
    return fresh.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n").select(incoming.columns)


def merge_filled(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``old`` with the new value of a field wherever it holds something."""
    n = new.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = old.join(n, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce(F.when(F.col(f"__{c}").cast("string") != "", F.col(f"__{c}")), F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns])


def update_row(df: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the rows with the keys of ``changed``."""
    return df.join(changed.select(*keys).distinct(), keys, "left_anti").select(df.columns).unionByName(changed.select(df.columns))


def merged(*stores: DataFrame) -> DataFrame:
    """The rows of all stores; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stores)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included; as many files as the data have partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
