"""Versioned Parquet tables in buckets of their key.

A version lists data directories and which of their buckets count.  A change writes new directories and then a version that names
them, so a failed change shows nothing; it is built on one version, and refused where another writer has published since.  Rows go to
buckets by a hash of their key: replacing keys rewrites their buckets only.  The values of unique columns are kept beside the rows in
buckets of their own, so that a change looks only into the buckets of the values that it brings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Column that names a row's bucket in the directories; schemas must not have it.
BUCKET = "hash_bucket"
#: So many keys may be broadcast if Spark finds them small; more meet the rows by a shuffle, as their files' size says little of them.
FEW = 100_000
_VERSION = "part string, directory string, buckets array<int>"


class Conflict(RuntimeError):
    """Another writer has published since the version that a change is built on.  Read anew and try again."""


class Entry(NamedTuple):
    part: str  # "data", or "unique-" and a name
    directory: str
    buckets: tuple[int, ...]


def _meeting(keys: DataFrame, numbers: Mapping[int, int]) -> DataFrame:
    """``keys``, of which there are so many by bucket, as rows are joined with them."""
    return keys.hint("merge") if sum(numbers.values()) > FEW else keys


class SnapshotTable:
    """A table below one path, which any file system of Spark's may hold if its rename is atomic.

    key: the column whose values are replaced and deleted together, the first by default.  buckets: fixed when the table is made; about
    as many as keep one bucket's rows within a few GB.  unique: columns, or SQL expressions by name, that hold no value twice, null
    and empty text apart; a change that would is refused.  summary: aggregates of rows by bucket (rows with column hash_bucket to
    rows of summary_schema with it), written with each directory and merged on reading.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, unique: Iterable[str] | Mapping[str, str] = (), key: str | None = None, buckets: int = 8, summary: Callable[[DataFrame], DataFrame] | None = None, summary_schema: StructType | None = None):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self.unique = dict(unique) if isinstance(unique, Mapping) else {c: f"`{c}`" for c in unique}
        self.key = key or schema.fieldNames()[0]
        self.key_type = schema[self.key].dataType.simpleString()
        self.summary, self.summary_schema = summary, summary_schema

    # Versions

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _found(self, pattern: str) -> list[str]:
        """Paths below the table's, as far as the pattern goes."""
        depth = pattern.count("/") + 1
        return ["/".join(f.getPath().toString().split("/")[-depth:]) for f in self._fs().globStatus(self._path(pattern)) or []]

    def _versions(self) -> list[int]:
        return sorted(int(p.split("/")[0].split("=")[1]) for p in self._found("version=*/_SUCCESS"))

    def version(self) -> int:
        """0 before the first change."""
        return max(self._versions(), default=0)

    def _entries(self, version: int) -> list[Entry]:
        """One row for each directory and part that still counts."""
        rows = self.spark.read.schema(_VERSION).parquet(f"{self.path}/version={version}").collect() if version else []
        return [Entry(r.part, r.directory, tuple(r.buckets)) for r in sorted(rows)]

    def _publish(self, entries: list[Entry], base: int, draft: bool) -> int:
        """The number under which the entries are published.  Of two writers that take one number the rename refuses the second."""
        made = f"version-{uuid.uuid4().hex}"
        rows = [(e.part, e.directory, list(e.buckets)) for e in entries if e.buckets]
        self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.parquet(f"{self.path}/{made}")
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self.spark._jsc.hadoopConfiguration())
        careful = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # never over another
        while True:
            if not draft and self.version() != base:
                self._fs().delete(self._path(made), True)
                raise Conflict(f"{self.path}: version {self.version()} was published after {base}")
            number = 1 + max([int(p.split("=")[1]) for p in self._found("version=*")], default=0)
            try:
                files.rename(self._path(made), self._path(f"version={number}"), careful)
                return number
            except Exception as e:  # noqa: BLE001  py4j wraps what Java throws
                if "FileAlreadyExists" not in str(e):
                    raise

    # Reading

    def _paths(self, entries: list[Entry], part: str, only: Collection[int] | None = None, root: str | None = None) -> list[str]:
        return [f"{self.path}/{root or part}/{e.directory}/{BUCKET}={b}" for e in entries if e.part == part for b in e.buckets if only is None or b in only]

    def _read(self, paths: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _index_schema(self) -> StructType:
        return StructType.fromDDL(f"value string, key {self.key_type}")

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._paths(self._entries(self.version() if version is None else version), "data"), self.schema)

    def rows_of(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows whose key is in ``keys``; only their buckets are read."""
        entries = self._entries(self.version() if version is None else version)
        numbers = self._numbers(keys.select(F.col(self.key).cast(self.key_type).alias("k")), "k")
        return self._read(self._paths(entries, "data", numbers), self.schema).join(_meeting(keys.select(self.key).distinct(), numbers), self.key, "left_semi")

    def known(self, name: str, values: DataFrame, version: int | None = None) -> DataFrame:
        """(value, key): which of the ``values`` (column value, text) of a unique column are there, and with what key; only the values'
        buckets are read."""
        entries = self._entries(self.version() if version is None else version)
        part = f"unique-{name}"
        numbers = self._numbers(values, "value")
        return self._read(self._paths(entries, part, numbers), self._index_schema()).join(_meeting(values.select("value").distinct(), numbers), "value", "left_semi")

    def summaries(self, version: int | None = None) -> DataFrame:
        """Rows of the summaries of all live buckets, still to be merged."""
        return self._read(self._paths(self._entries(self.version() if version is None else version), "data", root="summary"), self.summary_schema)

    # Changes

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.buckets)).cast("int")

    def _numbers(self, df: DataFrame, column: str) -> dict[int, int]:
        """The buckets of the values, with how many rows each has; at most as many as there are buckets."""
        return dict(df.groupBy(self._bucket(column).alias("b")).agg(F.count("*").alias("n")).collect())

    def _save(self, df: DataFrame, part: str, directory: str, column: str) -> Entry:
        """Written in buckets; a bucket with many rows is split among tasks, small ones share one."""
        df.withColumn(BUCKET, self._bucket(column)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{part}/{directory}")
        return Entry(part, directory, tuple(sorted(int(p.rsplit("=", 1)[1]) for p in self._found(f"{part}/{directory}/{BUCKET}=*"))))

    def _save_data(self, df: DataFrame, directory: str) -> Entry:
        entry = self._save(df.select(self.schema.fieldNames()), "data", directory, self.key)
        if self.summary and entry.buckets:
            at = f"{self.path}/data/{directory}"
            rows = self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, IntegerType())).option("basePath", at).parquet(at)
            self.summary(rows).select(BUCKET, *self.summary_schema.fieldNames()).write.partitionBy(BUCKET).parquet(f"{self.path}/summary/{directory}")
        return entry

    def _values(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.expr(self.unique[name]).cast("string").alias("value"), F.col(self.key).alias("key")).where(F.col("value") != "")

    def change(self, new: DataFrame | None = None, gone: DataFrame | None = None, base: int | None = None, draft: bool = False, empty: bool = False) -> int:
        """The rows whose key is in ``gone`` (a column named as the key) go, those of ``new`` come; the version's number.

        It is built on version ``base``, the present one by default, and refused with Conflict if that is no longer the present one,
        unless it is a ``draft``: a version that counts once something else names it.  ``empty`` starts from no rows.
        """
        base = self.version() if base is None else base
        entries = [] if empty else self._entries(base)
        directory = f"{base + 1:09d}-{uuid.uuid4().hex}"
        old = added = None
        after = list(entries)
        if gone is not None:
            gone = gone.select(F.col(self.key).cast(self.key_type).alias(self.key)).distinct()
            touched = self._numbers(gone, self.key)
            old, gone = self._read(self._paths(entries, "data", touched), self.schema), _meeting(gone, touched)
            after = self._without(after, "data", touched)
            after.append(self._save_data(old.join(gone, self.key, "left_anti"), f"{directory}-kept"))
        if new is not None:
            entry = self._save_data(new, f"{directory}-new")
            added = self._read(self._paths([entry], "data"), self.schema)
            after.append(entry)
        for name in self.unique:
            after = self._index(name, entries, after, directory, added, None if old is None else old.join(gone, self.key, "left_semi"))
        return self._publish(after, base, draft)

    def _without(self, entries: list[Entry], part: str, numbers: Collection[int]) -> list[Entry]:
        return [e._replace(buckets=tuple(b for b in e.buckets if b not in numbers)) if e.part == part else e for e in entries]

    def _index(self, name: str, entries: list[Entry], after: list[Entry], directory: str, added: DataFrame | None, removed: DataFrame | None) -> list[Entry]:
        """Entries with the values of a unique column brought up to date; refuses a value that would be there twice."""
        part, schema = f"unique-{name}", self._index_schema()
        if removed is not None:
            lost = self._values(removed, name).select("value")
            touched = self._numbers(lost, "value")
            kept = self._read(self._paths(entries, part, touched), schema).join(_meeting(lost, touched), "value", "left_anti")
            after = self._without(after, part, touched)
            if touched:
                after = [*after, self._save(kept.select("value", "key"), part, f"{directory}-kept", "value")]
        if added is not None:
            fresh = self._values(added, name)
            numbers = self._numbers(fresh, "value")
            there = self._read(self._paths(after, part, numbers), schema)
            again = fresh.groupBy("value").count().where("count > 1").select("value").unionByName(there.join(_meeting(fresh, numbers), "value", "left_semi").select("value")).first()
            if again:
                raise ValueError(f"{name} is not unique: {again[0]}")
            after = [*after, self._save(fresh, part, f"{directory}-new", "value")]
        return after

    def write(self, df: DataFrame, base: int | None = None, draft: bool = False) -> int:
        """The table holds the rows of ``df`` and no others."""
        return self.change(new=df, base=base, draft=draft, empty=True)

    def append(self, df: DataFrame, base: int | None = None, draft: bool = False) -> int:
        """The rows of ``df`` are added; those that are there are neither copied nor read."""
        return self.change(new=df, base=base, draft=draft)

    def vacuum(self, keep: int = 1, also: Iterable[int] = ()) -> None:
        """Delete all but the last ``keep`` versions and those in ``also``, and data that no version left names.  Not while others write
        or read old ones."""
        held = {*self._versions()[-keep:], *also} if keep else set(also)
        entries = [e for v in held for e in self._entries(v)]
        names = {f"{e.part}/{e.directory}" for e in entries} | {f"summary/{e.directory}" for e in entries if e.part == "data"}
        live = {f"{root}/{e.directory}/{BUCKET}={b}" for e in entries for b in e.buckets for root in ([e.part, "summary"] if e.part == "data" else [e.part])}
        parts = ["data", "summary", *(f"unique-{u}" for u in self.unique)]
        dead = [p for p in [*self._found("version=*"), *self._found("version-*")] if p not in {f"version={v}" for v in held}]
        for part in parts:
            directories = self._found(f"{part}/*")
            dead += [p for p in directories if p not in names]
            dead += [p for p in self._found(f"{part}/*/{BUCKET}=*") if p.rsplit("/", 1)[0] in names and p not in live]
        for p in dead:
            self._fs().delete(self._path(p), True)
