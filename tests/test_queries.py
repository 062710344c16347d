"""Every registered query of the core against its SQL counterpart on the smallest tables."""

import os

import duckdb
import pytest

from labcurate.plans import queries, registry, source_queries  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(_norm(r[c]) for c in cols) for r in df.collect()], key=repr)
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted([tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()], key=repr)


def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["search_records"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_returnflag" in plan or "In(l_returnflag, [A,R])" in plan
    assert "BatchEvalPython" not in plan and "ArrowEval" not in plan


def test_the_flagship_runs_as_generated_code(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")  # code that cannot be compiled is an error then
    try:
        assert registry.QUERIES[registry.FLAGSHIP](spark, SF).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_curation_shuffles_once_and_joins_nothing(spark):
    from labcurate.operators import curate

    names = "material_name ionic_liquid cof friction_force load normal_load speed temperature potential".split()
    rows = spark.createDataFrame([tuple(["x"] * len(names) + [1])], [*names, "seq"])
    plan = curate.curate(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "BatchEval" not in plan
