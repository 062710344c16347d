"""The whole life of a collection: ingest, extraction, synchronisation, search and deletion over versioned tables.

A change is built on the versions that the last commit names, writes drafts of the tables it touches and then one commit row that names
them, so readers see all of it or nothing.  A draft that was never committed is a base for nothing.  A commit is refused (Conflict)
where another came since the change began.  Each method takes and returns DataFrames; many documents are handled in one call.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labcurate.functions import parsing as P
from labcurate.functions import scoring as S
from labcurate.operators import curate as C
from labcurate.operators import explore as X
from labcurate.operators import storage as W
from labcurate.operators.tables import BUCKET
from labcurate.sources import connectors as N

_LITERATURE = "id long, doi string, title string, authors string, journal string, issn string, year int, volume string, issue string, pages string, content string, file_path string, file_hash string, status string, error_message string, created_at timestamp"
_RECORDS = "id long, literature_id long, material_name string, lubricant string, cof_value double, cof_operator string, cof_raw string, load_raw string, load_n double, speed_raw string, speed_mps double, temperature_raw string, temperature_k double, potential string, water_content string, surface_roughness string, film_thickness string, mol_ratio string, cation string, extracted_at timestamp, confidence double, evidence string"
#: Versions of the tables that a commit names, and the greatest ids dealt.
_COMMITS = "literature long, records long, failures long, batches long, last_literature long, last_record long"
_FAILURES = "file_hash string, batch_idx int, error string, batch_id string, failed_at timestamp"
#: A document's identity in synchronisation: its identifier, else its content.
_DOCUMENT = "coalesce(nullif(doi, ''), concat('hash:', file_hash))"
#: Facets whose counts are kept beside the records.
FACETS = ["material_name", "lubricant"]
# Messages about files and about processing them again, and the least content that is worth it.
NO_STORED = " does not have stored file content. The original file content is required for reprocessing. Please use the file upload endpoint to provide the content."
TOO_SHORT, LEAST_CONTENT = "File content is empty or too short", 100
FAILED_AGAIN, DONE_AGAIN = "重新提取失败: ", ("成功重新提取 ", " 条数据记录 (已删除旧记录)")
NO_DATA, NO_CONTENT = "No valid data extracted.", "No content available"
_METADATA = ["title", "authors", "journal", "issn", "year", "volume", "issue", "pages"]
_RAW = ["material_name", "lubricant", "cof", "load", "speed", "temperature", "potential", "water_content", "surface_roughness", "film_thickness", "mol_ratio", "cation", "evidence"]
#: What a client sends for one document: its metadata and its measurements.
_PAYLOAD = "doi string, file_hash string, " + ", ".join(f"{m} {'int' if m == 'year' else 'string'}" for m in _METADATA) + ", records array<struct<" + ",".join(f"{c}:string" for c in _RAW) + ">>"


def payload_schema() -> StructType:
    return StructType.fromDDL(_PAYLOAD)


def _filled_to(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def typed(raw: DataFrame) -> DataFrame:
    """Typed columns, operators and confidence from a record's texts.

    Each long chain is bound: all in one generated method would be more than the JVM compiles.
    """
    read = raw.withColumn("__cof", P.bound(F.col("cof"), P.cof))
    scored = F.struct("material_name", "lubricant", "cof", "load", "speed", "temperature")
    return read.withColumns({
        "material_name": F.coalesce(P.blank_to_null(F.col("material_name")), F.lit("Unknown Material")),
        "lubricant": F.coalesce(P.blank_to_null(F.col("lubricant")), F.lit("Unknown IL")),
        "cof_raw": F.col("cof"), "cof_value": F.col("__cof.value"), "cof_operator": F.col("__cof.operator"),
        "load_raw": F.col("load"), "load_n": P.bound(F.col("load"), P.force_newtons),
        "speed_raw": F.col("speed"), "speed_mps": P.bound(F.col("speed"), P.speed_mps),
        "temperature_raw": F.col("temperature"), "temperature_k": P.bound(F.col("temperature"), lambda c: P.kelvin(P.temperature_text(c))),
        "confidence": P.bound(scored, lambda r: S.confidence(r["material_name"], r["lubricant"], r["cof"], F.lit(None).cast("double"), r["load"], r["speed"], r["temperature"])),
        "extracted_at": F.current_timestamp(),
    }).drop("__cof")


class _Again(NamedTuple):
    """Entries that are processed again: file_hash (or a stand-in for it), literature_id, and content that was given anew."""

    entries: DataFrame


class _Change:
    """What one change is built on, what it writes aside, and the commit that makes it visible."""

    def __init__(self, library: Library):
        self.library, self.base = library, library._commits.version()
        row = library._commits.read(self.base).first()
        self.state = row.asDict() if row else dict.fromkeys(library._commit_schema.fieldNames(), 0)
        self._paths: list[str] = []

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` written aside: what is numbered next reads the same each time."""
        path = f"{self.library._path}/staged/{uuid.uuid4().hex}"
        self._paths.append(path)
        df.write.parquet(path)
        return self.library.spark.read.schema(df.schema).parquet(path)

    def put(self, table: str, new: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """A draft of a table: the rows with the keys of ``gone`` go, ``new`` come."""
        self.state[table] = self.library._tables[table].change(new, gone, self.state[table], draft=True)

    def numbered(self, rows: DataFrame, counter: str, order: list[str]) -> DataFrame:
        """``rows``, staged, with ids that no committed row has."""
        out = W.with_new_ids(rows, self.state[counter], "id", order)
        self.state[counter] += rows.count()
        return out

    def commit(self) -> None:
        row = tuple(self.state[f] for f in self.library._commit_schema.fieldNames())
        self.library._commits.write(self.library.spark.createDataFrame([row], self.library._commit_schema), base=self.base)

    def __enter__(self) -> _Change:
        return self

    def __exit__(self, *_: object) -> None:
        for p in self._paths:
            where = self.library.spark._jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(self.library.spark._jsc.hadoopConfiguration()).delete(where, True)


class Library:
    """buckets: into so many parts entries and records are dealt by a hash of the entry's id; fixed when a library is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark = spark
        self.literature_schema, self.record_schema, self._commit_schema = map(StructType.fromDDL, (_LITERATURE, _RECORDS, _COMMITS))
        self._path = path = path.rstrip("/")
        failures, batches = StructType.fromDDL(_FAILURES), StructType.fromDDL("batch_id string, at timestamp")
        self._literature = W.SnapshotTable(spark, f"{path}/literature", self.literature_schema, {"doi": "doi", "file_hash": "file_hash", "document": _DOCUMENT}, "id", buckets)
        facets = lambda rows: X.partials(rows, FACETS, "cof_value", "id", BUCKET)
        self._records = W.SnapshotTable(spark, f"{path}/records", self.record_schema, key="literature_id", buckets=buckets, summary=facets, summary_schema=StructType.fromDDL(X.PARTIALS))
        self._failures = W.SnapshotTable(spark, f"{path}/failures", failures, key="file_hash", buckets=buckets)
        self._batches = W.SnapshotTable(spark, f"{path}/batches", batches, ("batch_id",), buckets=buckets)
        self._commits = W.SnapshotTable(spark, f"{path}/commits", self._commit_schema, buckets=1)
        self._tables = {"literature": self._literature, "records": self._records, "failures": self._failures, "batches": self._batches}

    def _version(self, table: str) -> int:
        row = self._commits.read().first()
        return row[table] if row else 0

    def literature(self) -> DataFrame:
        return self._literature.read(self._version("literature"))

    def records(self) -> DataFrame:
        return self._records.read(self._version("records"))

    def failures(self) -> DataFrame:
        """Batches whose request failed, with the error; a file's go when it is answered again."""
        return self._failures.read(self._version("failures"))

    def ingest(self, files: DataFrame) -> DataFrame:
        """Files (file_hash, path, content text): those not known yet become entries in state processing.  Returns them."""
        with _Change(self) as change:
            rows = files.select("file_hash", F.col("path").alias("file_path"), F.col("text").alias("content"))
            known = self._literature.known("file_hash", rows.select(F.col("file_hash").alias("value")), change.state["literature"])
            fresh = W.new_by_hash(rows, known.select(F.col("value").alias("file_hash")), "file_hash", "file_path")
            title = F.element_at(F.split("file_path", "/"), -1)
            fresh = change.staged(fresh.withColumns({"title": title, "authors": F.lit(""), "journal": F.lit(""), "status": F.lit("processing"), "created_at": F.current_timestamp()}))
            change.put("literature", _filled_to(change.numbered(fresh, "last_literature", ["file_hash"]), self.literature_schema))
            change.commit()
        return self.entries_of(files)

    def entries_of(self, files: DataFrame) -> DataFrame:
        """The entries of files (file_hash); only the buckets that can hold them are read."""
        version = self._version("literature")
        ids = self._literature.known("file_hash", files.select(F.col("file_hash").alias("value")), version)
        return self._literature.rows_of(ids.select(F.col("key").alias("id")), version)

    def cached(self, files: DataFrame) -> DataFrame:
        """What is stored of the files (file_hash) that are completed: their records with id (file hash, underscore, place from 0),
        ionic_liquid and the entry's metadata, as an extraction would answer."""
        done = self.entries_of(files).where("status = 'completed'").drop("content").withColumnRenamed("id", "literature_id")
        rows = self._records.rows_of(done.select("literature_id"), self._version("records")).withColumnRenamed("id", "record_id").join(done, "literature_id")
        return C.position_ids(rows, "file_hash", "record_id").withColumn("ionic_liquid", F.col("lubricant"))

    def _facets(self) -> DataFrame:
        """Partial aggregates of the live buckets, written with them: no record is read."""
        return self._records.summaries(self._version("records"))

    def options(self) -> DataFrame:
        return X.merged_option_lists(self._facets())

    def facets(self, column: str, needle: str | None = None, top: int | None = None) -> DataFrame:
        """How many records each value of a facet has, most frequent first."""
        return X.merged_facet_counts(self._facets(), column, needle, top)

    def needs_extraction(self, force: bool = False) -> DataFrame:
        """Entries that are not completed; with ``force`` all."""
        return self.literature() if force else self.literature().where("status <> 'completed'")

    def sync(self, payloads: DataFrame, append: bool = False) -> dict[str, int]:
        """Store documents with their records (payload_schema()).  A known identifier keeps its entry, and its records are replaced, or with
        ``append`` added to.  A document is known by its identifier, without one by its file hash, and left out without either.  Rows with the same identifier are one document: their records join and the first title counts."""
        with _Change(self) as change:
            rows = payloads.withColumn("doi", P.blank_to_null(P.normalize_doi(F.col("doi"))))
            rows = rows.withColumn("key", F.expr(_DOCUMENT))
            rows = change.staged(rows.where(F.col("key").isNotNull()).withColumn("place", F.monotonically_increasing_id()))
            first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
            given = rows.groupBy("key").agg(*[first(c) for c in ("doi", "file_hash", *_METADATA)])
            known = self._literature.known("document", rows.select(F.col("key").alias("value")), change.state["literature"]).select(F.col("value").alias("key"), F.col("key").alias("id"))
            known = change.staged(known)
            created = given.join(known, "key", "left_anti")
            created = change.staged(created.withColumns({"title": F.coalesce("title", F.lit("Untitled")), "authors": F.coalesce("authors", F.lit("")), "journal": F.coalesce("journal", F.lit("")), "status": F.lit("completed"), "created_at": F.current_timestamp()}))
            created = change.staged(change.numbered(created, "last_literature", ["key"]))
            change.put("literature", _filled_to(created, self.literature_schema))
            ids = known.unionByName(created.select("key", "id")).withColumnRenamed("id", "literature_id")
            given_records = change.staged(typed(rows.select("key", F.inline("records")).join(ids, "key").drop("key")))
            replaced = known.select(F.col("id").alias("literature_id"))
            lost = 0 if append else self._records.rows_of(replaced, change.state["records"]).count()
            added = given_records.count()
            change.put("records", _filled_to(change.numbered(given_records, "last_record", ["literature_id"]), self.record_schema), None if append else replaced)
            change.commit()
        return {"synced": added, "replaced": lost}

    def store_answers(self, answers: DataFrame, metadata: DataFrame | None = None, batch_id: str | None = None, again: _Again | None = None) -> None:
        """Extraction answers (file_hash, batch_idx, answer, and error if there is one): curate their records, each file's for itself, and
        replace those of each file that brings at least one.

        A file that brings records is completed, and what it has of metadata (file_hash and fields) is filled in.  One that brings none is
        failed, with its first batch's error or that there was no data, unless it was completed before: then its records and state
        stay.  Batches with an error are kept in failures().  A batch_id that was stored before changes nothing.  ``again`` is given
        by reprocess(): there every entry ends completed, and metadata count only where they are better than what is there.
        """
        with _Change(self) as change:
            if batch_id is not None:
                this = self.spark.createDataFrame([(batch_id,)], "value string")
                if self._batches.known("batch_id", this, change.state["batches"]).first():
                    return
                change.put("batches", this.select(F.col("value").alias("batch_id"), F.current_timestamp().alias("at")))
            error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
            given = change.staged(answers.select("file_hash", F.col("batch_idx").cast("int").alias("batch_idx"), "answer", error.alias("error")))
            files = given.groupBy("file_hash").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("batch_idx"))).alias("error"))
            if again is None:
                found = self._literature.known("file_hash", files.select(F.col("file_hash").alias("value")), change.state["literature"])
                ids = change.staged(found.select(F.col("value").alias("file_hash"), F.col("key").alias("literature_id")))
            else:
                ids = again.entries.select("file_hash", "literature_id")
            raw = C.records_of_answers(given.where("error IS NULL")).withColumn("seq", F.col("batch_idx").cast("long") * 1_000_000 + F.col("pos"))
            parts = C.curate(raw.drop("id").join(ids, "file_hash"), "seq", within=("literature_id",))
            new = parts.select("literature_id", *[F.col("cof_raw").alias("cof") if c == "cof" else F.col("ionic_liquid").alias("lubricant") if c == "lubricant" else F.col(c) for c in _RAW], "first_seen")
            new = change.staged(typed(new))
            bring = new.select("literature_id").distinct()
            change.put("records", _filled_to(change.numbered(new, "last_record", ["literature_id", "first_seen"]), self.record_schema), bring)
            entries = self._literature.rows_of(ids.select(F.col("literature_id").alias("id")), change.state["literature"])
            outcome = ids.join(files, "file_hash").join(bring.withColumn("__some", F.lit(True)), "literature_id", "left").select(F.col("literature_id").alias("id"), F.col("error").alias("__error"), F.coalesce("__some", F.lit(False)).alias("__some"))
            entries = entries.join(outcome, "id")
            if metadata is not None:
                fields = [m for m in _METADATA if m in metadata.columns]
                filled = metadata.join(ids if again else ids.join(bring, "literature_id", "left_semi"), "file_hash").drop("file_hash").withColumnRenamed("literature_id", "id")
                if again:
                    old = entries.select("id", *[F.col(m).alias(f"__{m}") for m in ("doi", *_METADATA)])
                    better = S.should_update(F.col("__doi"), F.col("doi") if "doi" in filled.columns else F.lit(None).cast("string"), [F.col(f"__{m}") for m in fields if m != "issn"], [F.col(m) for m in fields if m != "issn"])
                    filled = filled.join(old, "id").where(better)
                entries = W.merge_filled(entries, filled, "id", fields)
            if again:
                given_texts = again.entries.select(F.col("literature_id").alias("id"), F.col("content").alias("__content"))
                entries = entries.join(given_texts, "id").withColumn("content", F.coalesce("__content", "content"))
            failed = ~F.col("__some") & (F.col("status") != "completed") & F.lit(again is None)
            entries = entries.withColumn("error_message", F.when(failed, F.coalesce("__error", F.lit(NO_DATA))).when(~F.col("__some"), F.col("error_message")))
            entries = entries.withColumn("status", F.when(failed, "failed").otherwise("completed"))
            change.put("literature", change.staged(_filled_to(entries, self.literature_schema)), ids.select(F.col("literature_id").alias("id")))
            lost = given.where("error IS NOT NULL").select("file_hash", "batch_idx", "error", F.lit(batch_id).cast("string").alias("batch_id"), F.current_timestamp().alias("failed_at"))
            change.put("failures", lost, files.select("file_hash"))
            change.commit()

    def extract(self, pages: DataFrame, ask_metadata: DataFrame | None, ask: N.Ask, models: N.Models, registry: DataFrame | None = None, prompt: str = "", head_prompt: str = "", system: str | None = None, head_system: str | None = None) -> None:
        """Both passes over the entries that wait: bibliographic data, completed field by field from ``registry`` (doi and fields), then
        the measurements of the pages (file_hash, page_no, text, image) batch by batch.

        The first pass asks models.text about the head of each entry's content and its first page's image; ``ask_metadata``
        (file_hash, answer) are its answers where it has been done already.  Entries with neither content nor pages are failed.
        """
        entries = self.needs_extraction().select("file_hash", "content")
        waiting = entries.select("file_hash")
        pages = pages.join(waiting, "file_hash", "left_semi")
        if ask_metadata is None:
            covers = pages.groupBy("file_hash").agg(F.min_by("image", "page_no").alias("image"))
            heads = entries.join(covers, "file_hash", "left").where("trim(coalesce(content, '')) <> '' OR image IS NOT NULL")
            ask_metadata = N.first_pass(heads.select("file_hash", N.head_messages(head_prompt, F.col("content"), F.col("image"), models, head_system).alias("request")), ask, models)
        found = N.metadata_answers(ask_metadata.join(waiting, "file_hash", "left_semi"))
        found = found.withColumn("doi", P.blank_to_null(P.normalize_doi(F.col("doi"))))
        metadata = C.merge_metadata(found, registry, fields=tuple(m for m in _METADATA if m in registry.columns)) if registry is not None else found
        batches = C.batches(pages, "file_hash", "page_no")
        batches = batches.groupBy("file_hash", "batch_idx").agg(F.array_sort(F.collect_list(F.struct("page_no", "text", "image"))).alias("p"))  # three pages
        text, images = F.array_join(F.transform("p", lambda x: x.text), "\n\n"), F.transform("p", lambda x: x.image)
        answers = N.extracted(batches.select("file_hash", "batch_idx", N.extraction_messages(prompt, images, text, models, system).alias("request")), ask, models)
        bare = entries.where("trim(coalesce(content, '')) = ''").join(pages, "file_hash", "left_anti")
        none = bare.select("file_hash", F.lit(0).alias("batch_idx"), F.lit("[]").alias("answer"), F.lit(NO_CONTENT).alias("error"))
        self.store_answers(answers.unionByName(none), metadata)

    def reprocess(self, wanted: DataFrame, ask: N.Ask, models: N.Models, prompt: str = "", head_prompt: str = "") -> DataFrame:
        """Extract entries (id, content text that may be null) again: literature_id, success, reprocessed_count, message, needs_upload.

        Content that is given is stored; without it the stored one serves, and an entry that has none needs an upload.  Records
        are replaced where at least one comes, metadata where the new are better, and the entry ends completed.  Entries that are not
        there, or whose content has fewer than LEAST_CONTENT characters, are told so and left alone.
        """
        known = self._literature.rows_of(wanted.select("id"), self._version("literature"))
        given = wanted.groupBy("id").agg(F.max("content").alias("given"))
        filled = lambda c: F.when(F.col(c) != "", F.col(c))
        rows = given.join(known.select("id", "file_hash", F.col("content").alias("stored"), F.lit(True).alias("there")), "id", "left")
        rows = rows.withColumn("text", F.coalesce(filled("given"), filled("stored")))
        told = F.when(F.col("there").isNull(), F.concat(F.lit("Literature ID="), "id", F.lit(" not found"))).when(F.col("text").isNull(), F.concat(F.lit("Literature ID="), "id", F.lit(NO_STORED))).when(F.length(P.strip(F.col("text"))) < LEAST_CONTENT, F.lit(TOO_SHORT))
        with _Change(self) as aside:
            rows = aside.staged(rows.withColumn("told", told).withColumn("file_hash", F.coalesce("file_hash", F.concat(F.lit("id:"), "id"))))
            good = rows.where("told IS NULL")
            entries = good.select("file_hash", F.col("id").alias("literature_id"), F.col("given").alias("content"))
            none = F.array().cast("array<string>")
            heads = N.first_pass(good.select("file_hash", N.head_messages(head_prompt, F.col("text"), F.lit(None).cast("string"), models).alias("request")), ask, models)
            heads = aside.staged(N.metadata_answers(heads).withColumn("doi", P.blank_to_null(P.normalize_doi(F.col("doi")))))
            answers = N.extracted(good.select("file_hash", F.lit(0).alias("batch_idx"), N.extraction_messages(prompt, none, F.col("text"), models).alias("request")), ask, models)
            answers = aside.staged(answers)
            before = self._commits.version()
            self.store_answers(answers, heads, again=_Again(entries))
            row = self._commits.read(before).first()
            old = self._records.read(row["records"] if row else 0).select("id")
            new = self._records.rows_of(entries.select("literature_id"), self._version("records")).join(old, "id", "left_anti").groupBy("literature_id").agg(F.count("*").alias("n"))
            out = rows.join(answers.select("file_hash", "error"), "file_hash", "left").join(new.withColumnRenamed("literature_id", "id"), "id", "left")
            failed = F.coalesce("told", F.when(F.col("error").isNotNull(), F.concat(F.lit(FAILED_AGAIN), "error")))
            n = F.coalesce("n", F.lit(0))
            done = F.concat(F.lit(DONE_AGAIN[0]), n, F.lit(DONE_AGAIN[1]))
            result = out.select(F.col("id").alias("literature_id"), failed.isNull().alias("success"), n.alias("reprocessed_count"), F.coalesce(failed, done).alias("message"), F.coalesce(F.col("there") & F.col("text").isNull(), F.lit(False)).alias("needs_upload"))
            path = f"{self._path}/outcomes/{uuid.uuid4().hex}"
            result.write.parquet(path)
        return self.spark.read.schema(result.schema).parquet(path)

    def vacuum(self) -> None:
        """Only the present versions stay."""
        row = self._commits.read().first()
        for name, table in self._tables.items():
            table.vacuum(keep=0, also=[row[name]] if row and row[name] else [])
        self._commits.vacuum()

    def delete(self, ids: DataFrame) -> None:
        """Entries (id) go with their records; unknown ids change nothing."""
        with _Change(self) as change:
            gone = change.staged(ids.select("id").distinct())
            change.put("literature", gone=gone)
            change.put("records", gone=gone.withColumnRenamed("id", "literature_id"))
            change.commit()

    def list_after(self, after: tuple | None = None, limit: int = 100) -> DataFrame:
        """The newest entries, or those that follow an entry with this (created_at, id)."""
        return X.page_after(self.literature().drop("content").withColumn("doi", F.coalesce("doi", F.lit(""))), "created_at", "id", after, limit)

    def list(self, skip: int = 0, limit: int = 100) -> DataFrame:
        return X.page_of(self.literature().drop("content").withColumn("doi", F.coalesce("doi", F.lit(""))), "created_at", "id", skip, limit)

    def get(self, column: str, value: object) -> DataFrame:
        """The entry with an id, doi or file_hash, with its records as an array."""
        return X.with_children(X.by_key(self.literature().drop("content"), column, value), self.records().withColumnRenamed("id", "record_id").withColumnRenamed("literature_id", "id"), "id", ["record_id", "material_name", "lubricant", "cof_value", "cof_operator"])

    def records_of(self, literature_id: int) -> DataFrame:
        return X.children_of_known(self.records().where(F.col("literature_id") == literature_id), self.literature().select(F.col("id").alias("literature_id")), "literature_id")

    def search(self, wanted: X.Filter) -> DataFrame:
        parents = self.literature().withColumnRenamed("id", "literature_id")
        return X.search(self.records(), parents, "literature_id", wanted, ["id"], ["doi", "title", "authors", "journal", "year"])

    def stats(self) -> DataFrame:
        return X.merged_summary(self._facets(), self.literature().count())

    def chat_context(self) -> DataFrame:
        """The newest text, cut to what a chat may see."""
        return X.latest_context(self.literature().withColumn("all", F.lit(1)), "all", "created_at", "content").select("context")
