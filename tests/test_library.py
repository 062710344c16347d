"""The collection's whole life on a small case, and properties of the operators."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labcurate.functions import scoring as S
from labcurate.operators import terms as T
from labcurate.operators.dictionaries import LIQUIDS, SURFACES
from labcurate.operators.explore import Filter
from labcurate.plans.library import Library, payload_schema
from labcurate.sources import connectors, files


def payload(spark, *rows):
    schema = payload_schema()
    names = [f.name for f in schema["records"].dataType.elementType.fields]
    full = []
    for doi, h, title, records in rows:
        full.append(tuple({"doi": doi, "file_hash": h, "title": title, "records": [tuple(r.get(n) for n in names) for r in records]}.get(f.name) for f in schema.fields))
    return spark.createDataFrame(full, schema)


def test_life_of_a_collection(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    r = {"material_name": "Mica", "lubricant": "[EMIM][TFSI]", "cof": "< 0.02", "load": "5 nN", "temperature": "25 C"}
    lib.sync(payload(spark, ("https://doi.org/10.1/a", None, "A", [r, r]), (None, "h1", None, [{"cof": "2"}])))
    assert lib.literature().count() == 2 and lib.records().count() == 3
    assert lib.sync(payload(spark, ("doi:10.1/a", None, "B", [r])))["replaced"] == 2
    assert [x.title for x in lib.get("doi", "10.1/a").collect()] == ["A"] and lib.records().count() == 2
    assert lib.sync(payload(spark, ("10.1/a", None, None, [r])), append=True) == {"synced": 1, "replaced": 0}
    row = lib.search(Filter({"material_name": ["Mica"]}, {"cof_value": (0.01, 0.03)})).first()
    assert (row.cof_operator, row.load_n, row.temperature_k, row.parent.doi) == ("LT", 5e-9, 298.15, "10.1/a")
    assert lib.stats().first().total_records == 3
    files_df = spark.createDataFrame([("h1", "/x/known.txt", "t"), ("h2", "/x/new.txt", "text"), ("h2", "/x/again.txt", "text")], "file_hash string, path string, text string")
    assert lib.ingest(files_df).count() == 2 and lib.needs_extraction().count() == 1
    answer = json.dumps({"data": [{"material_name": "sio2", "ionic_liquid": "bmim pf6", "cof": "0.1", "speed": "1 mm/s"}, {"cof": "high"}]})
    lib.store_answers(spark.createDataFrame([("h2", 0, answer), ("h1", 0, "no answer")], "file_hash string, batch_idx int, answer string"))
    assert sorted((x.material_name, x.lubricant, x.speed_mps) for x in lib.records().where("cof_raw = '0.1'").collect()) == [("Silica", "[BMIM][PF6]", 0.001)]
    assert lib.records().where("cof_raw = '2'").count() == 1 and lib.needs_extraction().count() == 0
    lib.delete(lib.literature().where("doi = '10.1/a'").select("id"))
    assert lib.literature().count() == 2 and lib.records().count() == 2
    assert lib.records_of(10**9).count() == 0 and lib.chat_context().count() == 1


def test_files_with_the_same_record_keep_one_each(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    lib.sync(payload(spark, (None, "h1", None, [{"cof": "2"}]), (None, "h2", None, [{"cof": "3"}])))
    r = {"material_name": "sio2", "ionic_liquid": "bmim pf6", "cof": "0.1"}
    answers = [("h1", 0, json.dumps({"data": [r, r]})), ("h1", 1, json.dumps({"data": [r | {"speed": "1 mm/s"}]})), ("h2", 0, json.dumps({"data": [r]}))]
    lib.store_answers(spark.createDataFrame(answers, "file_hash string, batch_idx int, answer string"))
    ids = {x.file_hash: x.id for x in lib.literature().collect()}
    assert sorted((x.literature_id, x.cof_raw, x.speed_mps) for x in lib.records().collect()) == sorted([(ids["h1"], "0.1", 0.001), (ids["h2"], "0.1", None)])


def test_sync_gathers_no_identifiers_records(spark, tmp_path, monkeypatch):
    def gathered(*a):
        raise AssertionError("an identifier's records in one row")

    monkeypatch.setattr(F, "collect_list", gathered)
    lib = Library(spark, str(tmp_path / "lib"))
    lib.sync(payload(spark, ("10.1/a", None, "A", [{"cof": "1"}]), ("doi:10.1/a", None, None, [{"cof": "2"}, {"cof": "3"}]), (None, "h1", None, [{"cof": "4"}]), (None, None, None, [{"cof": "5"}])))
    ids = {x.doi or x.file_hash: x.id for x in lib.literature().collect()}
    assert sorted((x.cof_raw, x.literature_id) for x in lib.records().collect()) == [(c, ids[k]) for c, k in (("1", "10.1/a"), ("2", "10.1/a"), ("3", "10.1/a"), ("4", "h1"))]


def test_files_and_connectors(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a.TXT", "one"), ("b.md", "two"), ("c.csv", "no"), ("d.txt", "one")):
        (tmp_path / "d" / name).write_text(text)
    found = files.uploaded(spark, str(tmp_path / "d"))
    assert found.count() == 3 and found.select("file_hash").distinct().count() == 2
    assert sorted(r.text for r in files.plain_text(found).collect()) == ["one", "one", "two"]
    pages = spark.createDataFrame([("f", n, t) for n, t in enumerate(["x", "References\n a", "wear", "References figure", "nothing"])], "file_hash string, page_no int, text string")
    assert sorted(r.page_no for r in files.selected_pages(pages).collect()) == [0, 2, 3]
    assert files.document_text(pages).first().text.startswith("x\n\nReferences")
    assert [len(r.pages) for r in connectors.extraction_requests(pages).orderBy("batch_idx").collect()] == [3, 2]
    recorded = spark.createDataFrame([("10.1/a", '{"title":["T"],"issued":{"date-parts":[[2020]]}}')], "doi string, answer string")
    dois = spark.createDataFrame([("doi:10.1/a",), ("10.1/a",), ("10.1/b",), ("",)], "d string")
    got = {r.doi: (r.title, r.year) for r in connectors.bibliographies(dois, "d", lambda k, c: connectors.replayed(k, c, recorded)).collect()}
    assert {k: v for k, v in got.items() if v[0]} == {"10.1/a": ("T", 2020)}
    calls = []

    def flaky(key):
        calls.append(key)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert connectors.with_retries(flaky, first_wait=0)("k") == "ok" and len(calls) == 3
    heads = spark.createDataFrame([("f", '```json\n{"title":"T","year":" 1999 ","doi":null}\n```')], "file_hash string, answer string")
    m = connectors.metadata_answers(heads).first()
    assert (m.title, m.year, m.doi) == ("T", 1999, "")


def test_dictionary_extension_and_idempotence(spark):
    more = T.with_alias(SURFACES, "Mica", "glimmer")
    row = spark.range(1).select(T.surface(F.lit("Glimmer"), more).alias("a"), *[T.liquid(F.lit(x)).alias(f"l{i}") for i, x in enumerate(T.standards(LIQUIDS))]).first()
    assert row.a == "Mica" and [row[f"l{i}"] for i in range(len(LIQUIDS))] == T.standards(LIQUIDS)
    try:
        T.with_alias(SURFACES, "Nothing", "x")
        raise AssertionError
    except ValueError:
        pass


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.text(max_size=8), st.sampled_from(["< 0.1", "-", "1e9"]))] * 6), min_size=1, max_size=20))
def test_confidence_stays_in_range(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    rows = [tuple(None if v is None else "".join(c for c in v if ord(c) < 0xD800) for v in r) for r in rows]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    got = df.select(S.confidence(F.col("a"), F.col("b"), F.col("c"), F.lit(None).cast("double"), F.col("d"), F.col("e"), F.col("f")).alias("x")).collect()
    assert all(0.1 <= r.x <= 1.0 for r in got)
