"""Queries for files, connectors, the library and review, each with its SQL counterpart.

Outside libraries and services are replaced by small functions whose answers SQL can state too.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labcurate.functions import json_fields as J
from labcurate.functions import parsing as P
from labcurate.functions import scoring as S
from labcurate.operators import explore as X
from labcurate.operators import review as R
from labcurate.operators import storage as W
from labcurate.operators import terms as T
from labcurate.operators.dictionaries import SURFACES
from labcurate.operators.term_store import TermStore
from labcurate.plans.library import Library, payload_schema
from labcurate.plans.queries import _COF, _DBL, _RAW_SQL, _UNITED, _VC, _VL, _each, _quantity_sql, _shared, _sql, _terms_sql, raw, read
from labcurate.plans.registry import query
from labcurate.sources import connectors as N
from labcurate.sources import files as Q
from labcurate.streaming import ingest, lifecycle

MODELS = N.Models("first", "second")


@query("file_upload", "SELECT md5(n_name || chr(10)) AS file_hash, '.txt' AS extension, length(n_name) + 1 AS length, n_name || chr(10) AS text FROM nation")
def file_upload(s: SparkSession, d: str) -> DataFrame:
    """Every nation as a text file of its own, read back by hash, type and content."""
    at = _shared(s)
    read(s, d, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(at)
    found = Q.uploaded(s, at)
    return found.join(Q.plain_text(found), "file_hash").select("file_hash", "extension", "length", "text")


query("client_accepts", "SELECT page_id, page_id % 4 IN (0, 1) AS accepted FROM pages")(
    lambda s, d: read(s, d, "pages").select("page_id", Q.client_accepts(F.expr("CASE page_id % 4 WHEN 0 THEN 'application/pdf' ELSE 'image/png' END"), F.expr("CASE page_id % 4 WHEN 1 THEN 'notes.md' WHEN 2 THEN 'x.md.png' ELSE 'x.pdf' END")).alias("accepted"))
)


def _pdf_files(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, "broken").otherwise(F.col("text"))
    return read(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("file_hash"), F.lit(".pdf").alias("extension"), F.encode(text, "UTF-8").alias("content"))


def _lines(content: bytes) -> list[str]:
    if content == b"broken":
        raise ValueError("not a document")
    return content.decode().split("\n")


_KEPT_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
query("pdf_text", f"SELECT doc_id::VARCHAR AS file_hash, array_to_string(string_split(text, chr(10)), chr(10) || chr(10)) AS text, len(string_split(text, chr(10))) AS pages, CASE WHEN len({_KEPT_LINES}) > 0 THEN array_to_string({_KEPT_LINES}, chr(10) || chr(10)) END AS filled FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0")(lambda s, d: _pdf_text(s, d))


def _pdf_text(s: SparkSession, d: str) -> DataFrame:
    pages = Q.pdf_pages(_pdf_files(s, d), _lines)
    filled = Q.document_text(pages, drop_empty=True).withColumnRenamed("text", "filled")
    return Q.document_text(pages).join(pages.groupBy("file_hash").agg(F.count("*").alias("pages")), "file_hash").join(filled, "file_hash", "left")


def _picture(content: bytes, page_no: int) -> tuple[int, int, bytes]:
    if content.startswith(b"broken"):
        raise RuntimeError("no page")
    return (100 if page_no == 1 else 300), 400, content


query("page_images", "SELECT page_id::VARCHAR AS file_hash, 0 AS page_no, md5('data:image/jpeg;base64,' || base64(encode(html))) AS image FROM pages WHERE octet_length(encode(html)) >= 5120 AND page_id % 5 <> 0")(lambda s, d: _page_images(s, d))


def _page_images(s: SparkSession, d: str) -> DataFrame:
    files = read(s, d, "pages").select(F.col("page_id").cast("string").alias("file_hash"), F.encode(F.expr("CASE WHEN page_id % 5 = 0 THEN 'broken' ELSE html END"), "UTF-8").alias("content"))
    wanted = files.select("file_hash", F.explode(F.array(F.lit(0), F.lit(1))).alias("page_no"))
    return Q.page_images(files, wanted, _picture).select("file_hash", "page_no", F.md5("image").alias("image"))


def _louder(content: bytes) -> bytes:
    if content[:1] in b"ab":
        raise OSError("not an image")
    return content.upper()


query("image_shrink", "SELECT p_partkey, CASE WHEN p_name[1] NOT IN ('a', 'b') THEN upper(p_name) END AS image FROM part")(
    lambda s, d: Q.small_images(read(s, d, "part").select("p_partkey", Q.of_data_uri(Q.data_uri(F.encode("p_name", "UTF-8"))).alias("image")), "image", _louder).select("p_partkey", F.decode("image", "UTF-8").alias("image"))
)

_MESSAGE = (
    "'{\"title\":' || CASE c_custkey % 3 WHEN 0 THEN '[\"T' || c_custkey || '\",\"x\"]' WHEN 1 THEN '\"T' || c_custkey || '\"' ELSE '[]' END || ',\"container-title\":[\"J\"],\"ISSN\":\"1-2\",\"volume\":\"7\",\"URL\":\"http://x/' || c_custkey || '//\",\"author\":' || "
    "CASE c_custkey % 2 WHEN 0 THEN '[{\"given\":\"G\",\"family\":\"F' || c_custkey || '\"},{\"given\":\"no\"},{\"family\":\"Z\"}]' ELSE '[]' END || CASE c_custkey % 3 WHEN 0 THEN ',\"published\":{\"date-parts\":[[' || (2000 + c_custkey % 20) || ']]}' WHEN 1 THEN ',\"published\":{\"date-parts\":[[]]}' ELSE '' END || "
    "',\"issued\":{\"date-parts\":[[1990]]}' || CASE c_custkey % 5 WHEN 0 THEN ',\"link\":[{\"content-type\":\"text/html\",\"URL\":\"no\"},{\"content-type\":\"application/pdf\",\"URL\":\"u' || c_custkey || '\"}]' WHEN 1 THEN ',\"open-access\":{\"content-type\":\"application/pdf\",\"URL\":\"o' || c_custkey || '\"}' ELSE '' END || '}'"
)
_PDF = "CASE c_custkey % 5 WHEN 0 THEN 'u' || c_custkey WHEN 1 THEN 'o' || c_custkey END"
_FIELDS = f"CASE WHEN c_custkey % 3 < 2 THEN 'T' || c_custkey END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'G F' || c_custkey || '; Z' END AS authors, CASE c_custkey % 3 WHEN 0 THEN 2000 + c_custkey % 20 WHEN 2 THEN 1990 END::INT AS year, 'J' AS journal, '1-2' AS issn, '7' AS volume, {_PDF} AS pdf_url"
query("bibliographies", f"WITH f AS (SELECT c_custkey, '10.1/' || c_custkey AS doi, {_FIELDS} FROM customer WHERE c_custkey % 4 <> 3) SELECT '10.1/' || c.c_custkey AS doi, title, authors, year, journal, issn, volume, pdf_url FROM customer c LEFT JOIN f USING (c_custkey)")(lambda s, d: _bibliographies(s, d))


def _bibliographies(s: SparkSession, d: str) -> DataFrame:
    """Identifiers in three spellings, looked up in a recorded registry that does not know every fourth."""
    customers = read(s, d, "customer")
    recorded = customers.where("c_custkey % 4 <> 3").select(F.expr("'10.1/' || c_custkey").alias("doi"), F.expr(_MESSAGE).alias("answer"))
    dois = customers.select(F.explode(F.array(F.expr("'doi:10.1/' || c_custkey"), F.expr("' https://doi.org/10.1/' || c_custkey"), F.expr("'10.1/' || c_custkey"))).alias("d"))
    return N.bibliographies(dois, "d", lambda keys, c: N.replayed(keys, c, recorded)).select("doi", "title", "authors", "year", "journal", "issn", "volume", "pdf_url")


query("pdf_locations", f"SELECT c_custkey, coalesce({_PDF}, 'http://x/' || c_custkey || '.pdf') AS location FROM customer")(lambda s, d: read(s, d, "customer").select("c_custkey", J.pdf_location(F.try_parse_json(F.expr(_MESSAGE))).alias("location")))
query("metadata_heads", "SELECT doc_id, substr(text, 1, 4000) AS head FROM documents")(lambda s, d: N.metadata_requests(read(s, d, "documents").withColumnRenamed("doc_id", "file_hash")).withColumnRenamed("file_hash", "doc_id"))
_ANSWER = "CASE c_custkey % 4 WHEN 0 THEN '```json\n{\"title\":\"T\",\"year\":\" ' || (1900 + c_custkey % 90) || ' \",\"doi\":null}\n```' WHEN 1 THEN '{\"year\":' || (1900 + c_custkey % 90) || ',\"journal\":\"J\"}' WHEN 2 THEN 'see {\"year\":\"unknown\",\"authors\":\"A\"}' ELSE 'no answer' END"
query("metadata_answers", "SELECT c_custkey AS file_hash, CASE c_custkey % 4 WHEN 0 THEN 'T' ELSE '' END AS title, CASE c_custkey % 4 WHEN 2 THEN 'A' ELSE '' END AS authors, CASE c_custkey % 4 WHEN 1 THEN 'J' ELSE '' END AS journal, '' AS doi, CASE WHEN c_custkey % 4 < 2 THEN 1900 + c_custkey % 90 END::INT AS year FROM customer")(
    lambda s, d: N.metadata_answers(read(s, d, "customer").select(F.col("c_custkey").alias("file_hash"), F.expr(_ANSWER.replace("\n", "\\n")).alias("answer"))).select("file_hash", "title", "authors", "journal", "doi", "year")
)


def _ask_status(model: str, request: str) -> str:
    if request == "P":
        raise RuntimeError("500 down")
    if request == "F" and model == "first":
        raise RuntimeError("404 model_not_found")
    return json.dumps({"records": [{"cof": model}]})


query("model_answers", "SELECT o_orderkey AS batch_idx, CASE o_orderstatus WHEN 'P' THEN '[]' WHEN 'F' THEN '{\"records\": [{\"cof\": \"second\"}]}' ELSE '{\"records\": [{\"cof\": \"first\"}]}' END AS answer, CASE o_orderstatus WHEN 'P' THEN '500 down' END AS error FROM orders")(
    lambda s, d: N.extracted(read(s, d, "orders").select(F.col("o_custkey").alias("file_hash"), F.col("o_orderkey").alias("batch_idx"), F.col("o_orderstatus").alias("request")), _ask_status, MODELS).select("batch_idx", "answer", "error")
)


def _unreliable(key: str) -> str:
    if key.endswith("7"):
        raise OSError("no line")
    if key.endswith("8"):
        raise ValueError("not known")
    return key.lower()


query("retried_calls", "SELECT c_name AS name, CASE WHEN c_name LIKE '%7' OR c_name LIKE '%8' THEN NULL ELSE lower(c_name) END AS answer FROM customer WHERE c_name <> '' GROUP BY 1")(lambda s, d: N.called(read(s, d, "customer").select(F.col("c_name").alias("name")), "name", N.with_retries(_unreliable, first_wait=0)))
query("extraction_requests", "SELECT page_id % 7 AS file_hash, row_number // 3 AS batch_idx, string_agg(page_id, ',' ORDER BY page_id) AS page_numbers FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1 AS row_number FROM pages) GROUP BY 1, 2")(
    lambda s, d: N.extraction_requests(read(s, d, "pages").select((F.col("page_id") % 7).alias("file_hash"), F.col("page_id").alias("page_no"), F.col("url").alias("text"))).select("file_hash", F.col("batch_idx").cast("long").alias("batch_idx"), F.array_join(F.transform("pages", lambda p: p.page_no.cast("string")), ",").alias("page_numbers"))
)


def _ask_length(model: str, request: str) -> str:
    asked = json.loads(request)
    return f"{asked['message']}:{len(asked['context'])}"


query("chat_answers", "SELECT conv_id, 'q' || conv_id || ':' || coalesce(length(substr(arg_max(text, turn), 1, 2000)), 0) AS answer FROM conversations GROUP BY conv_id")(lambda s, d: _chat(s, d))


def _chat(s: SparkSession, d: str) -> DataFrame:
    turns = read(s, d, "conversations")
    asked = turns.select("conv_id").distinct().withColumn("message", F.concat(F.lit("q"), "conv_id"))
    return N.chat_answers(asked, X.latest_context(turns, "conv_id", "turn", "text"), _ask_length, MODELS).select("conv_id", "answer")


query("parse_normalized", _sql(f"{_quantity_sql('load', P.FORCE_FACTORS)} AS force, {_quantity_sql('speed', P.SPEED_FACTORS, ' WHEN contains(lower(speed), ' + chr(39) + 'rpm' + chr(39) + ') THEN NULL')} AS speed_mps, {_DBL('cof', _COF, 2)} AS cof_value, NULL::DOUBLE AS other"))(
    _each(*[(lambda c=c, field=field, name=name: P.parse_and_normalize(F.col(c), field)["value"].alias(name)) for c, field, name in (("load", "force", "force"), ("speed", "speed", "speed_mps"), ("cof", "cof", "cof_value"), ("load", "temperature", "other"))])
)
query("client_cof", _sql(r"try_cast(nullif(regexp_extract(regexp_replace(cof, '[<>≤≥~]', '', 'g'), '^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)', 1), '') AS DOUBLE) AS cof_value, nullif(regexp_extract(cof, '[<>≤≥~]', 0), '') AS cof_sign"))(
    _each(lambda: P.client_cof(F.col("cof"))["value"].alias("cof_value"), lambda: P.client_cof(F.col("cof"))["sign"].alias("cof_sign"))
)
_STATE = "CASE event_id % 7 WHEN 0 THEN 'extracting' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'success' WHEN 4 THEN 'pending' WHEN 5 THEN 'lost' END"
query("status_labels", "SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN 'extracting' WHEN event_id % 7 IN (2, 3) THEN 'completed' WHEN event_id % 7 = 4 THEN 'pending' ELSE 'unknown' END AS label FROM events")(lambda s, d: read(s, d, "events").select("event_id", P.status_label(F.expr(_STATE)).alias("label")))
query("extensions", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' ELSE '' END AS extension FROM pages")(lambda s, d: read(s, d, "pages").select("page_id", P.extension(F.expr("CASE page_id % 4 WHEN 0 THEN 's3://b/A.PDF' WHEN 1 THEN '/x/y.txt.md' WHEN 2 THEN 'a.b/c' ELSE '/d/.hidden' END")).alias("extension")))
_VF = f"CASE WHEN coalesce(friction_force, '') = '' THEN NULL WHEN {_UNITED('friction_force', 1)} IS NULL THEN 'Force value must include unit (e.g., 5 N, 100 mN)' END"
query("force_issues", _sql(f"{_VF} AS message, CASE WHEN {_VF} IS NOT NULL THEN 'warning' END AS severity"))(_each(lambda: S.force_issue(F.col("friction_force"))["message"].alias("message"), lambda: S.force_issue(F.col("friction_force"))["severity"].alias("severity")))
_ERROR = "coalesce(" + _VC + " = 'COF cannot be negative', false)"
_STATUS = "CASE WHEN k2 % 2 = 0 THEN 'verified' ELSE 'unverified' END"
query("verify_records", _sql(f"CASE WHEN {_ERROR} THEN {_STATUS} ELSE 'verified' END AS marked, CASE WHEN k2 % 2 = 0 THEN CASE WHEN coalesce({_VC}, {_VL}) IS NULL THEN 'unverified' ELSE 'warning' END ELSE 'verified' END AS toggled"))(lambda s, d: _verify(s, d))


def _verify(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = raw(s, d).withColumn("status", F.expr(_STATUS)).withColumn("v", S.validation(F.col("cof"), F.col("load"), none, none))
    return rows.select("k1", "k2", "k3", S.mark_verified(F.col("status"), F.col("v.issues")).alias("marked"), S.toggle_verified(F.col("status"), F.col("v.status")).alias("toggled"))


query("shown_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE l_quantity::VARCHAR END AS shown FROM lineitem")(
    lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.shown_number(F.expr("CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity WHEN l_linenumber % 2 = 0 THEN 0D END")).alias("shown"))
)
query("option_lists", "SELECT 'p_brand' AS facet, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS options FROM part WHERE p_brand <> '' UNION ALL SELECT 'p_type', string_agg(DISTINCT p_type, '|' ORDER BY p_type) FROM part WHERE p_type <> ''")(
    lambda s, d: X.option_lists(read(s, d, "part"), ["p_brand", "p_type"]).select("facet", F.array_join("options", "|").alias("options"))
)


@query("export_records", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def export_records(s: SparkSession, d: str) -> DataFrame:
    """Written as JSON, one record a line, and read back."""
    at, rows = _shared(s), read(s, d, "supplier").select("s_suppkey", "s_name", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END").alias("s_acctbal"))
    W.export_json(rows, at)
    return s.read.schema(rows.schema).json(at)


query("row_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) || '!' ELSE s_name END AS s_name FROM supplier")(
    lambda s, d: W.update_row(read(s, d, "supplier").select("s_suppkey", "s_name"), read(s, d, "supplier").where("s_suppkey % 4 = 0").select("s_suppkey", F.expr("upper(s_name) || '!'").alias("s_name")), ["s_suppkey"])
)
query("store_merge", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS s_name, CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey END AS s_nationkey FROM supplier")(
    lambda s, d: W.merged(read(s, d, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", "s_name"), read(s, d, "supplier").where("s_suppkey % 2 = 1").select("s_suppkey", "s_nationkey"))
)
query("cascade_parents", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")(
    lambda s, d: W.cascade_delete(read(s, d, "orders"), read(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), read(s, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey")[0].select("o_orderkey")
)
query("alias_registration", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Mica' WHEN 1 THEN 'Mica' ELSE 'something' END AS standard FROM part")(
    lambda s, d: read(s, d, "part").select("p_partkey", T.surface(F.expr("CASE p_partkey % 3 WHEN 0 THEN ' Glimmer ' WHEN 1 THEN 'mica' ELSE 'something' END"), T.with_alias(SURFACES, "Mica", "glimmer")).alias("standard"))
)


@query("unique_refused", "SELECT c_custkey, c_name FROM customer")
def unique_refused(s: SparkSession, d: str) -> DataFrame:
    """A second load of the same keys is refused and changes nothing."""
    rows = read(s, d, "customer").select("c_custkey", "c_name")
    table = W.SnapshotTable(s, _shared(s), rows.schema, unique=("c_custkey",))
    table.write(rows)
    try:
        table.append(rows.limit(1))
    except ValueError:
        return table.read()
    raise AssertionError("repeated keys were stored")


@query("stream_seen_once", "SELECT DISTINCT user_id FROM events")
def stream_seen_once(s: SparkSession, d: str) -> DataFrame:
    at = _shared(s)
    arriving = ingest.file_stream(s, f"{d}/events.parque[t]", "user_id long, ts timestamp")
    once = ingest.hashes_seen_once(arriving, "user_id", "ts", "3650 days").select("user_id")
    once.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("user_id long").parquet(f"{at}/out")


_SUPPLIERS = "SELECT count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS even FROM supplier"


@query("library_append", f"SELECT n AS synced, 0 AS replaced, even AS synced_again, 0 AS replaced_again, n + even AS total_records, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS total_parents FROM ({_SUPPLIERS})")
def library_append(s: SparkSession, d: str) -> DataFrame:
    """Nations as documents, suppliers as measurements; a second synchronisation adds to the first."""
    lib, schema = Library(s, _shared(s)), payload_schema()
    record = F.struct(*[(F.col("s_name") if f.name == "evidence" else F.lit(None).cast("string")).alias(f.name) for f in schema["records"].dataType.elementType.fields])

    def payload(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy(F.concat(F.lit("10.1/"), "s_nationkey").alias("doi")).agg(F.collect_list(record).alias("records"))
        return lists.select(*[F.col(f.name) if f.name in ("doi", "records") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])

    suppliers = read(s, d, "supplier")
    a, b = lib.sync(payload(suppliers), append=True), lib.sync(payload(suppliers.where("s_suppkey % 2 = 0")), append=True)
    return lib.stats().select(*[F.lit(x).cast("long").alias(k) for k, x in (("synced", a["synced"]), ("replaced", a["replaced"]), ("synced_again", b["synced"]), ("replaced_again", b["replaced"]))], "total_records", "total_parents")


@query("library_ingest", "SELECT md5(text) AS file_hash, list_last(string_split(min('d/' || doc_id || '.txt'), '/')) AS title, 'processing' AS status, true AS dated FROM documents WHERE text IS NOT NULL GROUP BY 1")
def library_ingest(s: SparkSession, d: str) -> DataFrame:
    """Every document as an uploaded file, twice; each content is one entry."""
    lib = Library(s, _shared(s))
    files = read(s, d, "documents").where("text IS NOT NULL").select(F.md5("text").alias("file_hash"), F.expr("'d/' || doc_id || '.txt'").alias("path"), "text")
    lib.ingest(files)
    lib.ingest(files)
    return lib.needs_extraction().select("file_hash", "title", "status", F.col("created_at").isNotNull().alias("dated"))


def _ask_pages(model: str, request: str) -> str:
    text = json.loads(request)["text"]
    return json.dumps({"data": [{"material_name": "muscovite", "ionic_liquid": "bmim pf6", "cof": f"0.{len(text):03d}", "load": "5 nN"}, {"cof": "high"}]})


_BATCHES = "(SELECT n_name, 3 * length(n_name) + 4 AS n, 0 AS b FROM nation UNION ALL SELECT n_name, length(n_name), 1 FROM nation)"


@query("library_extract", f"SELECT n_name AS title, 2001 AS year, 'J' AS journal, md5(n_name) || '_' || b AS id, 'Mica' AS material_name, '[BMIM][PF6]' AS ionic_liquid, n / 1000.0::DOUBLE AS cof_value, 5e-9::DOUBLE AS load_n, 'completed' AS status, true AS dated FROM {_BATCHES}")
def library_extract(s: SparkSession, d: str) -> DataFrame:
    """Nations as files of four pages: both passes, a registry that completes the metadata, and the stored records as a client sees them."""
    lib = Library(s, _shared(s))
    files = read(s, d, "nation").select(F.md5("n_name").alias("file_hash"), F.col("n_name").alias("path"), F.col("n_name").alias("text"))
    lib.ingest(files)
    head = files.select("file_hash", F.to_json(F.struct(F.col("text").alias("title"), F.lit("1999").alias("year"), F.concat(F.lit("doi:10.1/"), "file_hash").alias("doi"))).alias("answer"))
    registry = files.select(F.concat(F.lit("10.1/"), "file_hash").alias("doi"), F.lit("").alias("title"), F.lit("J").alias("journal"), F.lit(2001).alias("year"))
    pages = files.select("file_hash", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page_no"), "text", F.lit(None).cast("string").alias("image"))
    lib.extract(pages, head, _ask_pages, MODELS, registry)
    return lib.cached(files.select("file_hash")).select("title", "year", "journal", "id", "material_name", "ionic_liquid", "cof_value", "load_n", "status", (F.col("extracted_at").isNotNull() & F.col("created_at").isNotNull()).alias("dated"))


_STAGE = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'extracting' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
_LIMIT_MS = 86_400_500
_MOVES = ",:pending,:processing,pending:processing,pending:failed,processing:extracting,processing:failed,extracting:completed,extracting:failed,completed:processing,failed:pending,failed:processing,"
_OUT = f"(a.state IN ('processing', 'extracting') AND x.since >= a.since + {_LIMIT_MS})"
_OK = f"contains('{_MOVES}', ',' || CASE WHEN {_OUT} THEN 'failed' ELSE a.state END || ':' || x.state || ',')"


@query(
    "life_cycle",
    f"WITH e AS (SELECT user_id AS file, epoch_ms(ts) AS ms, event_id AS n, {_STAGE} AS state FROM events), "
    "f AS (SELECT file, list_reduce(list_prepend({'state': '', 'since': 0::BIGINT, 'moves': 0::BIGINT, 'refused': 0::BIGINT, 'timed': 0::BIGINT}, list({'state': state, 'since': ms, 'moves': 0::BIGINT, 'refused': 0::BIGINT, 'timed': 0::BIGINT} ORDER BY ms, n)), "
    f"lambda a, x: {{'state': CASE WHEN {_OK} THEN x.state WHEN {_OUT} THEN 'failed' ELSE a.state END, 'since': CASE WHEN {_OK} THEN x.since WHEN {_OUT} THEN a.since + {_LIMIT_MS} ELSE a.since END, 'moves': a.moves + {_OK}::BIGINT, 'refused': a.refused + (NOT {_OK})::BIGINT, 'timed': a.timed + {_OUT}::BIGINT}}) AS s FROM e GROUP BY file), "
    f"g AS (SELECT file, s, s.state IN ('processing', 'extracting') AND s.since + {_LIMIT_MS} < (SELECT max(ms) - 3600000 FROM e) AS stuck FROM f) "
    "SELECT file, CASE WHEN stuck THEN 'failed' ELSE s.state END AS state, s.moves AS moves, s.refused AS refused, s.timed + stuck::BIGINT AS timed_out FROM g",
)
def life_cycle(s: SparkSession, d: str) -> DataFrame:
    """Users as files and their events as changes of state, most of them not allowed; who stays under way for a day has failed."""
    at = _shared(s)
    arriving = ingest.file_stream(s, f"{d}/events.parque[t]", "event_id long, user_id long, ts timestamp, event_type string")
    events = arriving.select(F.col("user_id").alias("file"), F.col("ts").alias("at"), F.col("event_id").alias("n"), F.expr(_STAGE).alias("state"))
    lifecycle.transitions(events, _LIMIT_MS / 1000).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return lifecycle.latest(s.read.schema("file long, at timestamp, n long, before string, state string, note string").parquet(f"{at}/out"))


def _ask_some(model: str, request: str) -> str:
    pages = json.loads(request)["text"].split("\n\n")
    key = int(pages[0])
    if key % 5 == 0 or key % 5 == 1 and len(pages) > 1:
        raise RuntimeError(f"down {key}")
    return "[]" if key % 5 == 2 else json.dumps({"data": [{"material_name": "muscovite", "ionic_liquid": "bmim pf6", "cof": f"0.{len(pages)}"}]})


@query(
    "library_failures",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 2) THEN 'failed' ELSE 'completed' END AS status, CASE c_custkey % 5 WHEN 0 THEN 'down ' || c_custkey WHEN 2 THEN 'No valid data extracted.' END AS error_message, "
    "CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS n_records, CASE c_custkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_failures FROM customer",
)
def library_failures(s: SparkSession, d: str) -> DataFrame:
    """Customers as files of four pages: of some a request fails, of some all, some bring nothing.  The answers are stored twice, as by a
    batch that runs again."""
    lib = Library(s, _shared(s))
    files = read(s, d, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("file_hash"), F.col("c_custkey").cast("string").alias("path"), F.col("c_custkey").cast("string").alias("text"))
    lib.ingest(files)
    pages = files.select("file_hash", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page_no"), "text", F.lit(None).cast("string").alias("image"))
    batches = N.extraction_requests(pages)
    requests = batches.select("file_hash", "batch_idx", N.extraction_messages("", F.array().cast("array<string>"), F.array_join(F.transform("pages", lambda p: p.text), "\n\n"), MODELS).alias("request"))
    for _ in range(2):
        lib.store_answers(N.extracted(requests, _ask_some, MODELS), batch_id="run")
    found = lib.literature().select("id", "file_hash", F.col("content").cast("long").alias("c_custkey"), "status", "error_message")
    n = lib.records().groupBy(F.col("literature_id").alias("id")).agg(F.count("*").alias("n_records"))
    lost = lib.failures().groupBy("file_hash").agg(F.count("*").alias("n_failures"))
    return found.join(n, "id", "left").join(lost, "file_hash", "left").select("c_custkey", "status", "error_message", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_failures", F.lit(0)).alias("n_failures"))


@query("keyed_change", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey % 7 <> 1")
def keyed_change(s: SparkSession, d: str) -> DataFrame:
    """Orders in buckets of their customer: some customers' orders are replaced and some deleted, in one change each."""
    rows = read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    table = W.SnapshotTable(s, _shared(s), rows.schema, unique=("o_orderkey",), key="o_custkey")
    table.write(rows)
    some = rows.where("o_custkey % 7 = 0")
    table.change(new=some.withColumn("o_orderstatus", F.lit("new")), gone=some)
    table.change(gone=rows.where("o_custkey % 7 = 1"))
    return table.read()


@query("refused_writer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 2")
def refused_writer(s: SparkSession, d: str) -> DataFrame:
    """Two writers begin on the same version; the second is refused and leaves nothing."""
    rows = read(s, d, "customer").select("c_custkey", "c_name")
    table = W.SnapshotTable(s, _shared(s), rows.schema, unique=("c_custkey",))
    base = table.write(rows.where("c_custkey % 3 = 0"))
    table.append(rows.where("c_custkey % 3 = 1"), base=base)
    try:
        table.append(rows.where("c_custkey % 3 = 2"), base=base)
    except W.Conflict:
        return table.read()
    raise AssertionError("a change was published over another")


def _told_once(key: str) -> str | None:
    return None if key.endswith("7") else f"{key.lower()} {uuid.uuid4().hex}"


@query("cached_answers", "SELECT c_name AS name, CASE WHEN c_name NOT LIKE '%7' THEN lower(c_name) END AS answer, true AS asked_once FROM customer WHERE c_name <> '' GROUP BY 1")
def cached_answers(s: SparkSession, d: str) -> DataFrame:
    """A service that says something else at each call, asked twice for every name, some of which it does not know."""
    at, names = _shared(s), read(s, d, "customer").select(F.col("c_name").alias("name"))
    first = N.AnswerCache(s, at).answers(names.where(F.crc32("name") % 2 == 0), "name", _told_once)
    second = N.AnswerCache(s, at).answers(names, "name", _told_once, "later")
    both = second.join(first, "name", "left")
    return both.select("name", F.substring_index("later", " ", 1).alias("answer"), F.coalesce(F.col("answer") == F.col("later"), F.lit(True)).alias("asked_once"))


_FACET_ROWS = "SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_custkey % 5 <> 0 AND (o_custkey % 2 = 1 OR o_orderkey % 3 = 0)"


@query("library_facets", f"WITH r AS ({_FACET_ROWS}) SELECT 'material_name' AS facet, status AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'lubricant', priority, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM r")
def library_facets(s: SparkSession, d: str) -> DataFrame:
    """Counts by facet that are kept up with each commit: customers as documents are stored, some replaced by a third of their orders,
    and some deleted."""
    lib, schema = Library(s, _shared(s)), payload_schema()
    fields = {"material_name": "o.o_orderstatus", "lubricant": "o.o_orderpriority", "cof": "'0.1'"}
    record = ", ".join(f"'{f.name}', {fields.get(f.name, 'cast(null as string)')}" for f in schema["records"].dataType.elementType.fields)

    def payload(orders: DataFrame, docs: DataFrame) -> DataFrame:
        lists = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_orderstatus", "o_orderpriority")).alias("orders"))  # few columns are moved
        lists = lists.select("c_custkey", F.expr(f"transform(orders, o -> named_struct({record}))").alias("records"))
        rows = docs.join(lists, "c_custkey", "left").withColumns({"doi": F.concat(F.lit("10.1/"), F.col("c_custkey")), "records": F.coalesce("records", F.array().cast(schema["records"].dataType))})
        return rows.select(*[F.col(f.name) if f.name in ("doi", "records") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])

    docs, orders = read(s, d, "customer"), read(s, d, "orders")
    lib.sync(payload(orders, docs))
    lib.sync(payload(orders.where("o_orderkey % 3 = 0"), docs.where("c_custkey % 2 = 0")))
    lib.delete(lib.literature().where("cast(substring(doi, 6) as int) % 5 = 0").select("id"))
    by = [lib.facets(c).select(F.lit(c).alias("facet"), "value", "n") for c in ("material_name", "lubricant")]
    return by[0].unionByName(by[1]).unionByName(lib.stats().select(F.lit("all").alias("facet"), F.lit("").alias("value"), F.col("total_records").alias("n")))


@query("list_by_cursor", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 200")
def list_by_cursor(s: SparkSession, d: str) -> DataFrame:
    """The third page of a hundred, each found from the last row of the one before."""
    rows, after = read(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), None
    for _ in range(2):
        last = X.page_after(rows, "o_orderdate", "o_orderkey", after, 100).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m")).first().m
        after = (last.o_orderdate, last.o_orderkey)
    return X.page_after(rows, "o_orderdate", "o_orderkey", after, 100)


_USED = f"SELECT standard AS term, count(*) AS n FROM (SELECT {_terms_sql('material')} AS standard FROM raw) GROUP BY 1"


@query("dictionary_use", f"WITH {_RAW_SQL}, used AS ({_USED}), terms(ord, term) AS (VALUES {', '.join(f'({i}, {chr(39)}{t.term}{chr(39)})' for i, t in enumerate(SURFACES))}) SELECT ord, terms.term AS term, coalesce(n, 0) AS n FROM terms LEFT JOIN used ON used.term = terms.term")
def dictionary_use(s: SparkSession, d: str) -> DataFrame:
    """The dictionary's terms in order, each with the number of records that name it in any way."""
    used = raw(s, d).groupBy(T.surface(F.col("material")).alias("term")).agg(F.count("*").alias("n"))
    return T.dictionary(s, SURFACES).select("ord", "term").join(used, "term", "left").select("ord", "term", F.coalesce("n", F.lit(0)).alias("n"))


_PARTS = "SELECT p_partkey, p_name, 'part ' || p_partkey AS term, lower(p_name) AS alias FROM part"


@query(
    "stored_terms",
    f"WITH t AS ({_PARTS}), first AS (SELECT alias, min(p_partkey) AS k, max(p_partkey) AS last FROM t GROUP BY 1), "
    "asked AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'a ' || p_name WHEN 2 THEN substr(p_name, 2) ELSE 'no. ' || p_partkey END AS x FROM part), "
    "letters AS (SELECT DISTINCT x, lower(x) AS low, list_distinct(string_split(lower(x), '')) AS c FROM asked), "
    "near AS (SELECT x, min(f.k) AS k FROM letters JOIN first f ON (contains(low, f.alias) OR contains(f.alias, low)) AND length(low) >= 3 AND len(list_intersect(c, list_distinct(string_split(f.alias, '')))) >= 0.7 * least(length(low), length(f.alias)) GROUP BY 1) "
    "SELECT p_partkey, asked.x AS x, coalesce('part ' || f.last, 'part ' || near.k, asked.x) AS standard FROM asked LEFT JOIN first f ON f.alias = lower(asked.x) LEFT JOIN near ON near.x = asked.x",
)
def stored_terms(s: SparkSession, d: str) -> DataFrame:
    """Parts as a stored dictionary, half of their names registered later as aliases; names in other spellings are looked up."""
    store, parts = TermStore(s, _shared(s)), read(s, d, "part")
    term, alias = F.concat(F.lit("part "), "p_partkey"), F.lower("p_name")
    none = F.array().cast("array<string>")
    store.register(parts.select(F.col("p_partkey").cast("long").alias("ord"), term.alias("term"), F.lit("").alias("chinese_name"), F.lit("").alias("formula"), F.when(F.col("p_partkey") % 2 == 0, F.array(alias)).otherwise(none).alias("aliases"), none.alias("patterns")))
    store.add_aliases(parts.where("p_partkey % 2 = 1").select(term.alias("term"), alias.alias("alias")))
    asked = parts.select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'a ' || p_name WHEN 2 THEN substr(p_name, 2) ELSE 'no. ' || p_partkey END").alias("x"))
    return store.standard(asked, "x", "standard").select("p_partkey", "x", "standard")
