"""The stored dictionary: the same answers as the chain on the present terms, persistence, and many terms."""

import pytest
from pyspark.sql import functions as F

from labcurate.operators import joins
from labcurate.operators import terms as T
from labcurate.operators.dictionaries import LIQUIDS, SURFACES
from labcurate.operators.term_store import TermStore, _aliases, _fuzzy

TEXTS = [None, "", " ", "Mica", " MICA ", "muscovite mica sheet", "sio2", "silica glass", "SiO2/Si(100)", "graphite (HOPG)", "hop", "gra", "xx", "steel ball", "[BMIM][PF6]", "bmim pf6", "1-butyl-3-methylimidazolium hexafluorophosphate", "emim tfsi", "[EMIM] [TFSI]", "water", "oil-phase", "au(111) surface", "Gold", "diamond-like carbon", "unknown"]


def texts(spark):
    some = TEXTS + [a.upper() for t in (*SURFACES, *LIQUIDS) for a in (t.term, *t.aliases)] + [a[1:] for t in SURFACES for a in t.aliases] + [f"the {a} of it" for t in SURFACES for a in t.aliases]
    return spark.createDataFrame([(t, i) for i, t in enumerate(some * 2)], "x string, i int")


@pytest.mark.parametrize(("terms", "chain", "brackets"), [(SURFACES, T.surface, False), (LIQUIDS, T.liquid, True)], ids=["surfaces", "liquids"])
def test_same_answers_as_the_chain(spark, tmp_path, monkeypatch, terms, chain, brackets):
    monkeypatch.setattr(joins, "HOT_LEAST", 3)
    store = TermStore(spark, str(tmp_path / "t"), buckets=2)
    store.register(terms)
    rows = texts(spark)
    got = store.standard(rows, "x", "standard", brackets).withColumn("chain", chain(F.col("x"), terms))
    assert got.count() == rows.count()
    assert [(r.x, r.standard, r.chain) for r in got.where("NOT standard <=> chain").collect()] == []


def test_what_is_registered_stays(spark, tmp_path):
    store = TermStore(spark, str(tmp_path / "t"), buckets=2)
    store.register(SURFACES)
    store.add_aliases(spark.createDataFrame([("Mica", "glimmer"), ("Mica", "katzengold")], "term string, alias string"))
    with pytest.raises(ValueError, match="unknown term: Nothing"):
        store.add_aliases(spark.createDataFrame([("Mica", "x"), ("Nothing", "y")], "term string, alias string"))
    with pytest.raises(ValueError, match="not unique"):
        store.register(SURFACES[:1])
    again = TermStore(spark, str(tmp_path / "t"), buckets=2)
    rows = spark.createDataFrame([("Glimmer",), ("katzengold",), ("x",)], "x string")
    assert {r.x: r.s for r in again.standard(rows, "x", "s").collect()} == {"Glimmer": "Mica", "katzengold": "Mica", "x": "x"}
    assert again.terms().count() == len(SURFACES)


def test_a_hundred_thousand_terms(spark, tmp_path):
    store = TermStore(spark, str(tmp_path / "t"), buckets=2)
    store.register(SURFACES)
    name = F.concat(F.lit("compound "), F.col("id"))
    # Six letters, each from ten of its place, so that no letter repeats.
    places = ["abcdefghij", "klmnopqrst", "uvwxyzäöüå", "αβγδεζηθικ", "λμνξοπρστυ", "бвгджзийкл"]
    alias = F.concat(*[F.substr(F.lit(a), F.substring(F.lpad(F.col("id").cast("string"), 6, "0"), i + 1, 1).cast("int") + 1, F.lit(1)) for i, a in enumerate(places)])
    store.register(spark.range(100_000).select(F.col("id").alias("ord"), name.alias("term"), F.lit("").alias("chinese_name"), F.lit("").alias("formula"), F.array(alias).alias("aliases"), F.array().cast("array<string>").alias("patterns")))
    asked = spark.range(0, 100_000, 500).select("id", F.explode(F.array(F.upper(alias), F.concat(F.lit("<"), alias, F.lit(">")), F.substring(alias, 2, 5))).alias("x"))
    got = store.standard(asked, "x", "s").withColumn("want", name)
    assert got.count() == 600 and got.where("s <> want").collect() == []
    old = store.standard(texts(spark), "x", "s").withColumn("chain", T.surface(F.col("x")))
    assert old.where("NOT s <=> chain AND s NOT LIKE 'compound%'").count() == 0


def test_many_terms_with_one_alias(spark, tmp_path):
    """An alias that many terms share counts as the first one's, goes through the trigrams once, and no trigrams are broadcast."""
    store = TermStore(spark, str(tmp_path / "t"), buckets=2)
    rows = spark.range(2000).select(F.col("id").alias("ord"), F.concat(F.lit("t"), "id").alias("term"), F.lit("").alias("chinese_name"), F.lit("").alias("formula"), F.array(F.concat(F.lit("hot bolt"), F.col("id") % 2)).alias("aliases"), F.array().cast("array<string>").alias("patterns"))
    store.register(rows)
    asked = spark.createDataFrame([("a hot bolt0",), ("ot bolt1",), ("hot bolt1",), ("no. 7",)], "x string")
    got = store.standard(asked, "x", "s")
    assert {r.x: r.s for r in got.collect()} == {"a hot bolt0": "t0", "ot bolt1": "t1", "hot bolt1": "t1999", "no. 7": "no. 7"}
    assert _aliases(store.terms()).count() == 2
    texts = asked.select(F.col("x").alias("__low"), F.col("x").alias("__text"))
    assert "Broadcast" not in _fuzzy(texts, store.terms())._jdf.queryExecution().executedPlan().toString()
