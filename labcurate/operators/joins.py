"""Joins on skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above a HOT_KEYS-th of all rows, and above HOT_LEAST rows; so fewer than HOT_KEYS are.
HOT_KEYS, HOT_LEAST = 1000, 10_000


def join_counted(rows: DataFrame, names: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``names``, which has each ``key`` once and in ``n`` how many rows hold it; rows without a name keep
    nulls.  Hot keys are joined where the rows are; the others are shuffled, and none of those is large.  Spark is not asked whether to
    broadcast them: names that come from an aggregate or a small file may be many."""
    total = names.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    bound = max(HOT_LEAST, total // HOT_KEYS)
    hot, cold = names.where(F.col(n) > bound), names.where(F.col(n) <= bound)
    there = rows.join(F.broadcast(hot), key)
    return there.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key, "left"))
