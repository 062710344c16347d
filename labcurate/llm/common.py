"""What the operators share: reading tables, cutting lineage, folds and Arrow batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch handed to Python code holds at most about this many bytes of text (one longer text stands alone).
BATCH_BYTES = 4 << 20
#: A key is hot above a HOT_KEYS-th of all rows, and above HOT_LEAST rows.
HOT_KEYS, HOT_LEAST = 1000, 1024
#: Most rows of a few numbers each that are broadcast.
BROADCAST_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset a folder of our own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="labcurate-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs survive lost executors and do not recompute it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/labcurate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() has written, once nothing that is still to run reads them."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def only(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the keys of ``ids``, which are distinct, and the other columns of ``ids``; inner join.

    ``ids`` are written and counted first: up to BROADCAST_ROWS of them go to where the rows are, so that the rows (texts, registers)
    do not move; more of them meet the rows by a shuffle.
    """
    ids = cut(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, keys)


def join_unique(rows: DataFrame, names: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``names``, which has each ``key`` once and in ``n`` how many rows hold it; inner join.

    Keys that hold more than a thousandth of all rows (so fewer than HOT_KEYS of them, however large the tables) are joined where the
    rows are; the others are shuffled, and none of those is large.
    """
    total, most = names.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    bound = max(HOT_LEAST, total // HOT_KEYS)
    if most <= bound:
        return rows.join(names, key)
    hot, cold = names.where(F.col(n) > bound), names.where(F.col(n) <= bound)
    there = rows.join(F.broadcast(hot), key)
    return there.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``; from now on the session hands Python code batches of at most BATCH_BYTES (a longer text stands alone), unless it has a
    bound of its own.  By default it would hand over 10,000 rows at a time, however long their texts."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "1b") == "1b":  # unset
        conf.set(key, str(BATCH_BYTES))
    return rows


#: What operators keep in a Python worker from task to task, and how it is dropped.
_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, drop: Callable[[], None]) -> None:
    """An operator keeps tables in this worker from now on; make_way() drops them when another operator's task begins here."""
    _kept[name] = drop


def make_way(name: str) -> None:
    """Drop what other operators than ``name`` have kept in this worker: workers are used again, and their memory adds up."""
    others = [k for k in _kept if k != name]
    for k in others:
        _kept.pop(k)()
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can give memory back
            ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_batches(batches: Iterable[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece stay within ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)

