"""The life cycle as a stream, micro-batch by micro-batch, and what is kept up to date beside the records."""

import datetime as dt

from pyspark.sql import functions as F
from test_library import payload

from labcurate.operators import explore as X
from labcurate.plans.library import FACETS, Library
from labcurate.streaming import ingest, lifecycle

START = dt.datetime(2024, 1, 1)


def test_states_outlast_micro_batches_and_stuck_files_fail(spark, tmp_path):
    schema = "file string, at timestamp, n long, state string"
    at = lambda minutes: START + dt.timedelta(minutes=minutes)

    def arrive(*rows):
        spark.createDataFrame([(f, at(m), i, s) for i, (f, m, s) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = ingest.file_stream(spark, str(tmp_path / "in"), schema)
        log = lifecycle.transitions(events, 60 * 60, late="5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        log.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema("file string, at timestamp, n long, before string, state string, note string").parquet(str(tmp_path / "out"))
        return {r.file: (r.state, r.moves, r.refused, r.timed_out) for r in lifecycle.latest(rows).collect()}

    # Out of order within one micro-batch; one event that is not allowed.
    got = arrive(("a", 2, "extracting"), ("a", 1, "processing"), ("a", 3, "completed"), ("b", 0, "completed"), ("b", 1, "processing"), ("c", 2, "processing"))
    assert got == {"a": ("completed", 3, 0, 0), "b": ("processing", 1, 1, 0), "c": ("processing", 1, 0, 0)}
    # The next job knows the states: a is taken up again, an older event comes late, b goes on; c is stuck, and its timer fires.
    got = arrive(("a", 10, "processing"), ("a", 2, "failed"), ("b", 50, "extracting"), ("d", 70, "processing"))
    assert got["a"] == ("processing", 4, 1, 0) and got["b"] == ("extracting", 2, 1, 0) and got["c"] == ("failed", 1, 0, 1)
    # b's next event shows that it was stuck; what failed may be taken up again.
    got = arrive(("b", 200, "completed"), ("c", 201, "processing"), ("d", 90, "extracting"))
    assert got["b"] == ("failed", 2, 2, 1) and got["c"] == ("processing", 2, 0, 1)


def test_kept_aggregates_equal_a_full_scan(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    record = lambda m, o, cof: {"material_name": m, "lubricant": o, "cof": cof}

    def same():
        records, entries = lib.records(), lib.literature()
        assert lib.stats().first().asDict() == X.summary(records, entries, "cof_value").first().asDict()
        assert sorted(map(str, lib.options().collect())) == sorted(map(str, X.option_lists(records, FACETS).collect()))
        for f in FACETS:
            assert [tuple(r) for r in lib.facets(f).collect()] == [tuple(r) for r in X.facet_counts(records, f, "id").collect()]
        assert [tuple(r) for r in lib.facets(FACETS[0], "i", 1).collect()] == [tuple(r) for r in X.facet_counts(records, FACETS[0], "id", "i", 1).collect()]

    same()
    lib.sync(payload(spark, ("10.1/a", None, "A", [record("Mica", "x", "0.5"), record("Silica", "y", None)]), ("10.1/b", None, "B", [record("Mica", "", "0.25")])))
    same()
    lib.sync(payload(spark, ("10.1/a", None, "A", [record("Gold", "x", "0.125")]), ("10.1/c", None, "C", [record(None, None, "1")])))
    same()
    lib.sync(payload(spark, ("10.1/a", None, "A", [record("Gold", "z", "2")])), append=True)
    lib.delete(lib.literature().where("doi = '10.1/b'").select("id"))
    same()
    scans = [r for r in lib.stats().inputFiles() if "/records/data/" in r]
    assert not scans and lib.records().count() == 3


def test_pages_by_cursor_equal_pages_by_offset(spark, tmp_path):
    rows = [(i, None if i % 11 == 0 else START + dt.timedelta(days=i % 7)) for i in range(60)]
    spark.createDataFrame(rows, "id long, created_at timestamp").write.parquet(str(tmp_path / "t"))
    df, after, seen = spark.read.parquet(str(tmp_path / "t")), None, []
    while page := X.page_after(df, "created_at", "id", after, 7).collect():
        assert [r.id for r in page] == [r.id for r in X.page_of(df, "created_at", "id", len(seen), 7).collect()]
        seen += [r.id for r in page]
        after = (page[-1].created_at, page[-1].id)
    assert sorted(seen) == list(range(60))
    plan = X.page_after(df, "created_at", "id", (START, 5), 7)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(created_at" in plan and df.where(F.col("id") < 0).count() == 0
