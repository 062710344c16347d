"""What the two vector operators share: which vectors take part, and their numbers as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>, dim): the rows whose id is not null and whose vector is not null or zero and has finite components
    only.  Vectors are compared with those of as many components."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    df = vectors.select(F.col(id_col).alias("id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    df = df.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    return df.withColumn("dim", F.size("vector"))


def stored_type(vectors: DataFrame, vector_col: str) -> np.dtype:
    """What holds every component as it is: single precision where the table has no more."""
    return np.dtype("<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, dim) of a list column whose lists are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
