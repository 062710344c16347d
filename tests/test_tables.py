"""Versioned tables and the library's commits: failed and competing writers, replacement by buckets, unique values, kept failures."""

import json

import pytest
from pyspark.sql import functions as F

from labcurate.operators import storage as W
from labcurate.plans.library import NO_DATA, Library
from test_library import payload

ROWS = "k long, u string, v string"


def table(spark, tmp_path, **more):
    return W.SnapshotTable(spark, str(tmp_path / "t"), spark.createDataFrame([], ROWS).schema, unique=("u",), key="k", buckets=8, **more)


def made(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def held(df):
    return {f.split("/t/", 1)[1] for f in df.inputFiles()}


def files(spark, *hashes):
    return spark.createDataFrame([(h, f"/x/{h}.txt", f"text of {h}") for h in hashes], "file_hash string, path string, text string")


def test_replacing_a_key_rewrites_its_bucket_only(spark, tmp_path):
    t = table(spark, tmp_path)
    t.write(made(spark, *[(k, f"u{k}", "old") for k in range(40)]))
    before = held(t.read())
    t.change(new=made(spark, (7, "u7", "new"), (7, "u70", "more")), gone=spark.createDataFrame([(7,)], "k long"))
    after = held(t.read())
    bucket = {f.split("hash_bucket=")[1].split("/")[0] for f in after - before}
    assert len(bucket) == 1
    assert {f for f in before if f"hash_bucket={min(bucket)}/" in f} == before - after
    assert {r.v for r in t.read().where("k = 7").collect()} == {"new", "more"} and t.read().count() == 41
    assert t.read(1).where("v = 'new'").count() == 0
    assert [r.u for r in t.rows_of(spark.createDataFrame([(8,)], "k long")).collect()] == ["u8"]
    assert {(r.value, r.key) for r in t.known("u", spark.createDataFrame([("u70",), ("u71",)], "value string")).collect()} == {("u70", 7)}
    t.change(gone=spark.createDataFrame([(7,), (999,)], "k long"))
    t.append(made(spark, (100, "u7", "again")))  # a value that went may come again
    with pytest.raises(ValueError, match="u is not unique: u8"):
        t.append(made(spark, (101, "u8", "x")))
    with pytest.raises(ValueError, match="u is not unique: new"):
        t.append(made(spark, (101, "new", "x"), (102, "new", "x")))
    assert t.read().count() == 40 and t.version() == 4
    t.vacuum()
    assert t.read().count() == 40 and t.version() == 4 and t.known("u", spark.createDataFrame([("u7",)], "value string")).first().key == 100


def test_an_append_reads_no_old_rows_and_one_bucket_of_values(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.write(made(spark, *[(k, f"u{k}", "old") for k in range(200)]))
    old = held(t.read())
    read = []
    inner = W.SnapshotTable._read
    monkeypatch.setattr(W.SnapshotTable, "_read", lambda self, paths, schema: (read.extend(paths), inner(self, paths, schema))[1])
    t.append(made(spark, (1000, "new value", "x")))
    paths = [p.split("/t/", 1)[1] for p in read]
    assert not {p for p in paths if any(f.startswith(p) for f in old)}
    assert len({p.split("hash_bucket=")[1] for p in paths if p.startswith("unique-u")}) == 1


def test_of_two_writers_on_one_version_one_is_refused(spark, tmp_path):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.write(made(spark, (1, "a", "x")))
    base = t.version()
    other.append(made(spark, (2, "b", "x")), base=base)
    with pytest.raises(W.Conflict):
        t.append(made(spark, (3, "c", "x")), base=base)
    assert sorted(r.k for r in t.read().collect()) == [1, 2]
    t.append(made(spark, (3, "c", "x")))
    assert sorted(r.k for r in t.read().collect()) == [1, 2, 3]


def test_the_rename_decides_between_writers(spark, tmp_path, monkeypatch):
    """Both have seen that no version is newer; the second finds the name taken and then the version."""
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.write(made(spark, (1, "a", "x")))
    looked = []

    def late(self, *a):
        if not looked and a == ("version=*",):
            looked.append(1)
            names = found(self, *a)
            other.append(made(spark, (2, "b", "x")))
            return names
        return found(self, *a)

    found = W.SnapshotTable._found
    monkeypatch.setattr(W.SnapshotTable, "_found", late)
    with pytest.raises(W.Conflict):
        t.append(made(spark, (3, "c", "x")), base=1)
    assert looked and sorted(r.k for r in t.read().collect()) == [1, 2]


def test_a_failed_commit_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    lib.ingest(files(spark, "a"))
    publish = lib._commits.write

    def broken(*a, **k):
        raise OSError("the store is away")

    monkeypatch.setattr(lib._commits, "write", broken)
    with pytest.raises(OSError):
        lib.ingest(files(spark, "b"))
    monkeypatch.setattr(lib._commits, "write", publish)
    lib.ingest(files(spark, "c"))
    assert sorted((r.id, r.file_hash) for r in lib.literature().collect()) == [(1, "a"), (2, "c")]
    lib.ingest(files(spark, "b"))
    assert sorted((r.id, r.file_hash) for r in lib.literature().collect()) == [(1, "a"), (2, "c"), (3, "b")]
    lib.vacuum()
    assert lib.literature().count() == 3
    assert not list((tmp_path / "lib" / "staged").glob("*"))


def test_interleaved_changes_of_a_library(spark, tmp_path, monkeypatch):
    """A deletion that commits while a synchronisation is under way is not lost: the latter is refused and tried again."""
    lib, other = Library(spark, str(tmp_path / "lib"), buckets=2), Library(spark, str(tmp_path / "lib"), buckets=2)
    lib.sync(payload(spark, ("10.1/a", None, "A", [{"cof": "1"}]), ("10.1/b", None, "B", [{"cof": "2"}])))
    publish = lib._commits.write

    def meanwhile(*a, **k):
        monkeypatch.setattr(lib._commits, "write", publish)
        other.delete(other.literature().where("doi = '10.1/b'").select("id"))
        return publish(*a, **k)

    monkeypatch.setattr(lib._commits, "write", meanwhile)
    again = payload(spark, ("10.1/a", None, "A", [{"cof": "3"}]), ("10.1/c", None, "C", [{"cof": "4"}]))
    with pytest.raises(W.Conflict):
        lib.sync(again)
    assert sorted(r.cof_raw for r in lib.records().collect()) == ["1"]
    assert lib.sync(again) == {"synced": 2, "replaced": 1}
    rows = lib.records().collect()
    assert sorted(r.cof_raw for r in rows) == ["3", "4"] and len({r.id for r in rows}) == 2
    assert sorted((r.id, r.doi) for r in lib.literature().collect()) == [(1, "10.1/a"), (3, "10.1/c")]


def test_failures_stay_with_their_file(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    lib.ingest(files(spark, "good", "mixed", "dead", "empty"))
    good = json.dumps({"data": [{"material_name": "mica", "ionic_liquid": "bmim pf6", "cof": "0.1"}]})
    rows = [("good", 0, good, None), ("mixed", 0, "[]", "timeout"), ("mixed", 1, good, None), ("dead", 0, "[]", "later"), ("dead", 1, "[]", "404"), ("empty", 0, "[]", None), ("unknown", 0, good, None)]
    answers = spark.createDataFrame(rows, "file_hash string, batch_idx int, answer string, error string")
    titles = spark.createDataFrame([("good", "Title"), ("dead", "Never")], "file_hash string, title string")
    lib.store_answers(answers, titles, batch_id="run-1")
    state = {r.file_hash: (r.status, r.error_message, r.title) for r in lib.literature().collect()}
    assert state == {"good": ("completed", None, "Title"), "mixed": ("completed", None, "mixed.txt"), "dead": ("failed", "later", "dead.txt"), "empty": ("failed", NO_DATA, "empty.txt")}
    assert sorted((r.file_hash, r.batch_idx, r.error, r.batch_id) for r in lib.failures().collect()) == [("dead", 0, "later", "run-1"), ("dead", 1, "404", "run-1"), ("mixed", 0, "timeout", "run-1")]
    before = lib._commits.version()
    lib.store_answers(answers.where("false"), batch_id="run-1")  # stored before
    assert lib._commits.version() == before
    retry = spark.createDataFrame([("dead", 0, good), ("good", 0, "[]")], "file_hash string, batch_idx int, answer string")
    lib.store_answers(retry, batch_id="run-2")
    assert {r.file_hash: (r.status, r.error_message) for r in lib.literature().where("file_hash in ('dead', 'good')").collect()} == {"dead": ("completed", None), "good": ("completed", None)}
    assert lib.records().count() == 3 and {r.file_hash for r in lib.failures().collect()} == {"mixed"}
    assert {r.file_hash for r in lib.needs_extraction().select(F.col("file_hash")).collect()} == {"empty"}
