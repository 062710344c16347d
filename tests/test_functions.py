"""Golden rows of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from labcurate.functions import json_fields as J
from labcurate.functions import parsing as P
from labcurate.functions import scoring as S
from labcurate.operators import curate as C
from labcurate.operators import storage as W
from labcurate.operators import terms as T


def each(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [tuple(r.y) if hasattr(r.y, "_fields") or hasattr(r.y, "__fields__") else r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


GOLDEN = [
    (P.force_newtons, {"55 nN": 5.5e-8, "1.2 mN": 0.0012, "5 N": 5.0, "100": 100.0, "5.": None, "5-10 N": None, "≈5 N": None, "3 kgf": 3.0, "2 kN": 2000.0, "": None}),
    (P.speed_mps, {"100 mm/s": 0.1, "1.5 m/s": 1.5, "10 cm/s": 0.1, "100 rpm": None, "5 mm s-1": None}),
    (P.cof, {"< 0.02": (0.02, "LT"), "> 0.1": (0.1, "GT"), "≤ 0.05": (0.05, "LE"), "0.15": (0.15, "EQ"), "~ 0.08": (0.08, "EQ"), "<=0.05": (0.05, "LE"), "μ=0.05": (None, "EQ"), "": (None, "EQ")}),
    (P.sanitize_cof, {"< 0.01": 0.01, "0.02-0.04": 0.02, "1e-3": 0.001, "5e-5": None, "-0.1": None, "10^-3": None, ".05": 5.0}),
    (lambda c: P.sanitize_cof(c, fix=True), {".05": 0.05}),
    (P.temperature_text, {"25 °C": "298.15 K", "303 K": "303.00 K", "RT": "298.15 K", "77 K": "77.00 K", "150": "423.15 K", "350": "350.00 K", "mortar 350 K": "298.15 K", "n/a": "n/a", "": None}),
    (P.sanitize_potential, {"+1.5 V": "+1.5 V", "Open circuit": "OCP", "high": None}),
    (P.is_numeric_entry, {"0.05": True, "low 0.1": False, "1" * 21: False, "": False, None: False}),
    (P.normalize_doi, {"https://doi.org/10.1/x": "10.1/x", "doi:10.1/x": "10.1/x", " 10.1/x ": "10.1/x"}),
    (P.client_number, {"20 nN": 20.0, "5-10 N": 510.0, "N": None}),
    (P.is_superlubricity, {"<0.01": True, "0.01": False, "0.009": True, None: False}),
    (P.extension, {"a/b.PDF": ".pdf", "x": "", "/d.e/f": ""}),
    (lambda c: F.size(J.records(c)), {'```json\n[{"a":1},2]\n```': 2, '{"data":[1]}': 1, '{"records":[1,2,3]}': 3, '{"cof":1}': 1, "garbage": 0, "```\n[1]\n``` and ```\n[2]\n```": 0}),
    (T.surface, {"云母": "Mica", "SiO2": "Silica", "muscovite": "Mica", "Au(111) surface": "Au(111)", "steel": "Stainless steel", "silicon": "Silica", "unobtainium": "unobtainium", "": "", None: None}),
    (T.liquid, {"bmim pf6": "[BMIM][PF6]", "[EMIM][NTf2]": "[EMIM][TFSI]", "[PIP14][NTf2]": "[P14][TFSI]", "[PIP14][TFSI]": "[PIP14][TFSI]", "water": "water"}),
    (P.preview, {"x" * 501: "x" * 500 + "...", "x" * 500: "x" * 500}),
]


@pytest.mark.parametrize("n", range(len(GOLDEN)))
def test_golden(spark, n):
    f, rows = GOLDEN[n]
    assert each(spark, f, list(rows)) == list(rows.values())


def test_strip_takes_all_white_space(spark):
    every = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x11000))]
    texts = spark.createDataFrame([(x,) for c in every for x in (f"{c}a{c}",)] + [("",), ("  ",), (" a \n b\r\n",), ("\u3000\t",), (None,)], "x string")
    assert texts.where(~P.strip(F.col("x")).eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))).collect() == []


def test_a_filter_computes_an_entry_once(spark):
    odd = {" 5 N\u3000": True, "\u0663": True, "HIGH 1": False, "H\u0130GH 1": True, "Varies 2": False, " " * 30 + "1": True, "\n": False, "x\n1": True, "\U0001F600" * 19 + "1": True, "\U0001F600" * 20 + "1": False}
    assert each(spark, P.is_numeric_entry, list(odd)) == list(odd.values())
    rows = spark.range(9).withColumn("c", F.concat(F.col("id"), F.lit(" nN"))).where(P.is_numeric_entry(F.col("c")))
    assert rows.count() == 9
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(" nN") == 2  # in the filter and in the rows


def test_confidence_and_missing_cof(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        S.confidence(F.lit("Mica"), F.lit("x"), F.lit("0.05"), F.lit(0.05), F.lit("1 N"), F.lit("1 m/s"), F.lit("300 K")).alias("full"),
        S.confidence(F.lit("Mica"), F.lit("x"), F.lit("<0.01"), F.lit(0.01), none, none, none).alias("bound"),
        S.confidence(none, none, F.lit("2.0"), F.lit(2.0), none, none, none).alias("least"),
        S.missing_cof(F.lit(""), F.lit("1.1 nN"), F.lit("55 nN"), none).alias("made"),
        S.missing_cof(none, F.lit("1 nN"), F.lit("0 N"), none).alias("kept"),
    ).first()
    assert (row.full, row.bound, row.least) == (1.0, 0.75, 0.25)
    assert tuple(row.made) == ("0.02", "calculated") and tuple(row.kept) == (None, None)


def test_deduplicate_keeps_the_fullest_and_the_first_place(spark):
    rows = [(1, "Mica", "IL-one", "0.040", "-1.0V", None), (2, "mica", "[IL] one", "0.04", "1.0V", "5 N"), (3, "mica", "ILone", "0.04", "1.0V", "6 N"), (4, "x", "y", "high", None, None)]
    df = spark.createDataFrame(rows, "seq long, material_name string, ionic_liquid string, cof string, potential string, normal_load string").withColumns({"speed": F.lit(None).cast("string"), "temperature": F.lit(None).cast("string")})
    assert [(r.seq, r.first_seen) for r in C.deduplicate(df).collect()] == [(2, 1)]
    assert sorted(r.seq for r in C.deduplicate(df, fix=True).collect()) == [1, 2]


def test_snapshots_and_replacement(spark, tmp_path):
    table = W.SnapshotTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k long, v string").schema)
    assert table.version() == 0 and table.read().count() == 0
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    table.write(old)
    new = spark.createDataFrame([(1, "z")], "k long, v string")
    table.write(W.replace_where_any(table.read(), new, "k"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "z"), (2, "c")]
    assert table.read(1).count() == 3
    empty = new.where("false")
    assert W.replace_where_any(old, empty, "k").count() == 3
    ids = [r.id for r in W.with_new_ids(spark.range(50).repartition(3).withColumnRenamed("id", "x"), spark.range(8), "id", ["x"]).collect()]
    assert sorted(ids) == list(range(8, 58))


def test_tables_append_refuse_and_vacuum(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "")], "k long, v string")
    table = W.SnapshotTable(spark, str(tmp_path / "t"), rows.schema, unique=("v",))
    table.write(rows)
    table.append(spark.createDataFrame([(5, "b"), (6, "")], rows.schema))
    assert table.read().count() == 6 and table.read(1).count() == 4
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(7, "a")], rows.schema))
    assert table.version() == 2 and table.read().count() == 6
    (tmp_path / "t" / "version=3").mkdir()  # another writer's, not finished
    assert table.append(rows.where("v = 'none'")) == 4 and table.read().count() == 6
    table.vacuum()
    assert table.read().count() == 6 and len(list((tmp_path / "t").glob("version=*"))) == 1
    assert W.new_by_hash(spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "h string, o int"), spark.createDataFrame([], "h string"), "h", "o").count() == 1


def test_bibliography(spark):
    text = '{"title":["T"],"container-title":"J","author":[{"family":"A","given":"B"},{"given":"x"}],"published":{"date-parts":[[]]},"issued":{"date-parts":[[2020]]},"link":[{"content-type":"application/pdf","URL":"u"}]}'
    b = spark.createDataFrame([(text,)], "x string").select(J.bibliography(F.col("x"), F.lit("d")).alias("b")).first().b
    assert (b.title, b.journal, b.authors, b.year, b.pdf_url) == ("T", "J", "B A", None, "u")
