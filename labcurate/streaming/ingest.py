"""Arriving documents: each content is stored once, and files pass through their states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labcurate.operators.storage import SnapshotTable, new_by_hash

#: How far along a state is; a file's state never goes back.
STATES = ("pending", "processing", "extracting", "completed", "failed")


def store_new(stream: DataFrame, table: SnapshotTable, hash_col: str, order: str, checkpoint: str) -> StreamingQuery:
    """Add the rows whose hash the table does not hold yet, a version for each micro-batch that brings any; a batch run again adds
    nothing.  Where the hash is a unique column of the table, only the buckets of the arriving hashes are looked at."""

    def upsert(batch: DataFrame, _: int) -> None:
        batch.persist()
        hashes = batch.select(F.col(hash_col).alias("value")).where("value IS NOT NULL")
        known = table.known(hash_col, hashes).withColumnRenamed("value", hash_col) if hash_col in table.unique else table.read()
        fresh = new_by_hash(batch, known, hash_col, order)
        if not fresh.isEmpty():
            table.append(fresh)
        batch.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def state_of(events: DataFrame, key: str, state: str) -> DataFrame:
    """The furthest state of each file.  Works on a stream (complete or update mode) and on a table."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col(state))
    return events.groupBy(key).agg(F.max(rank).alias("__n")).select(key, F.element_at(F.array(F.lit("unknown"), *[F.lit(s) for s in STATES]), (F.coalesce("__n", F.lit(0)) + 1).cast("int")).alias("state"))


def hashes_seen_once(stream: DataFrame, hash_col: str, time_col: str, late: str = "1 day") -> DataFrame:
    """Drop repeated contents that arrive within the watermark; state older than that is forgotten."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([hash_col])
