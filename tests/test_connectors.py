"""Calls to outside services: several at a time and in order, limits, fallbacks, answers that are kept, both passes of an extraction."""

import json
import threading
import time

from pyspark.sql import functions as F

from labcurate.plans.library import NO_CONTENT, Library
from labcurate.sources import connectors as N


def test_waiting_calls_overlap_and_answers_keep_their_rows(spark):
    def slow(key):
        began = time.time()
        time.sleep(1.2 if key == "r0" else 0.6)
        return f"{key} {began} {time.time()}"

    rows = spark.createDataFrame([(f"r{i}", i) for i in range(4)], "request string, n int").coalesce(1)
    got = N.answered(rows, "request", slow, at_once=4).collect()
    assert [(r.request, r.n, r.answer.split()[0]) for r in got] == [(f"r{i}", i, f"r{i}") for i in range(4)]
    spans = [tuple(map(float, r.answer.split()[1:])) for r in got]
    assert max(b for b, _ in spans) < min(e for _, e in spans)
    one = [tuple(map(float, r.answer.split()[1:])) for r in N.answered(rows, "request", slow, at_once=1).collect()]
    assert all(one[i][1] <= one[i + 1][0] for i in range(3))


def test_limits_and_refusals():
    try:
        N.with_limit(lambda k: time.sleep(2), 0.1)("k")
        raise AssertionError
    except TimeoutError as e:
        assert "0.1 s" in str(e)

    def ask(model, request):
        if model == "second":
            return "from the second"
        raise RuntimeError(request)

    run = N.with_fallback(ask, N.Models("first", "second"))
    assert run("HTTP 404: gone") == run("code 400") == run("model_not_found") == "from the second"
    for other in ("took 1400 ms", "id 84041 is down"):
        try:
            run(other)
            raise AssertionError
        except RuntimeError as e:
            assert str(e) == other


def test_threads_serve_many_calls_and_late_ones_are_given_up(spark):
    rows = spark.range(300).selectExpr("'f' AS file_hash", "cast(id AS int) AS batch_idx", "cast(id AS string) AS request").coalesce(1)
    got = N.extracted(rows, lambda model, request: f"{request} {threading.current_thread().name}", N.Models("first")).collect()
    assert [(r.batch_idx, r.answer.split()[0], r.error) for r in got] == [(i, str(i), None) for i in range(300)]
    assert len({r.answer.split(" ", 1)[1] for r in got}) <= N.AT_ONCE  # not a thread for each call

    def ask(model, request):
        if request in ("0", "1", "5"):
            time.sleep(20)
        return request

    began = time.time()
    got = N.extracted(rows.where("batch_idx < 8"), ask, N.Models("first", seconds=0.5, at_once=2)).collect()
    late = "no answer after 0.5 s"
    assert [(r.answer, r.error) for r in got] == [("[]", late) if i in (0, 1, 5) else (str(i), None) for i in range(8)]
    assert time.time() - began < 15


def test_answers_are_kept_and_asked_for_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def fetch(key):
        (log / f"{key}-{time.time_ns()}").touch()
        if key == "down":
            raise OSError("no line")
        return None if key == "unknown" else f"about {key}"

    calls = lambda: sorted(p.name.split("-")[0] for p in log.iterdir())
    cache = N.AnswerCache(spark, str(tmp_path / "cache"), buckets=2)
    keys = spark.createDataFrame([("a",), ("b",), ("a",), ("unknown",), ("down",), ("",), (None,)], "k string")
    want = {"a": "about a", "b": "about b", "unknown": None, "down": None}
    once = N.with_retries(fetch, attempts=1, quiet=False)
    first = cache.answers(keys, "k", once)
    assert dict(map(tuple, first.collect())) == want and dict(map(tuple, first.collect())) == want
    assert calls() == ["a", "b", "down", "unknown"]
    again = N.AnswerCache(spark, str(tmp_path / "cache"), buckets=2).answers(keys, "k", once)
    assert again.count() == 4 and calls() == ["a", "b", "down", "down", "unknown"]  # only what could not be reached
    assert N.AnswerCache(spark, str(tmp_path / "cache"), days=0, buckets=2).answers(keys.where("k = 'a'"), "k", once).count() == 1
    assert calls().count("a") == 2


def test_both_passes_of_an_extraction(spark, tmp_path):
    def ask(model, request):
        asked = json.loads(request)
        assert asked["model"] == ("reader" if model == "reader" else "first")
        if model == "reader":
            assert asked["system"] == "librarian" and len(asked["text"]) <= 4000 + len("head:")
            if "bad" in asked["text"]:
                raise RuntimeError("away")
            return json.dumps({"title": f"T {asked['text'][5:9]} {len(asked['images'])}", "year": "2001"})
        return json.dumps({"data": [{"material_name": "mica", "ionic_liquid": "bmim pf6", "cof": "0.1"}]}) if "none" not in asked["text"] else "[]"

    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    lib.ingest(spark.createDataFrame([("a", "a.txt", "good" + "x" * 9000), ("b", "b.txt", "bad text"), ("c", "c.txt", "none here"), ("d", "d.txt", None)], "file_hash string, path string, text string"))
    pages = spark.createDataFrame([(h, n, t, "img" if n == 0 else None) for h, t in (("a", "good"), ("b", "bad"), ("c", "none")) for n in range(4)], "file_hash string, page_no int, text string, image string")
    lib.extract(pages, None, ask, N.Models("first", text="reader"), head_prompt="head:", head_system="librarian")
    got = {r.file_hash: (r.title, r.year, r.status, r.error_message) for r in lib.literature().collect()}
    assert got == {"a": ("T good 1", 2001, "completed", None), "b": ("b.txt", None, "completed", None), "c": ("c.txt", None, "failed", "No valid data extracted."), "d": ("d.txt", None, "failed", NO_CONTENT)}
    assert lib.records().count() == 2 and lib.failures().select(F.col("file_hash")).first()[0] == "d"


def test_processing_again(spark, tmp_path):
    def ask(model, request):
        asked = json.loads(request)
        if asked["temperature"] == N.HEAD_TEMPERATURE:
            return json.dumps({"title": "Better", "authors": "A, B", "journal": "J", "year": 1999} if "rich" in asked["text"] else {"title": "Worse"})
        if "broken" in asked["text"]:
            raise RuntimeError("away")
        return json.dumps({"data": [{"material_name": "gold", "ionic_liquid": "x", "cof": f"0.{i}"} for i in (1, 2)]}) if "rich" in asked["text"] else "[]"

    lib = Library(spark, str(tmp_path / "lib"), buckets=2)
    lib.ingest(spark.createDataFrame([(h, f"{h}.txt", t * 200 if t else t) for h, t in (("a", "rich "), ("b", "poor "), ("c", None), ("d", "broken ")) ] + [("e", "e.txt", "short")], "file_hash string, path string, text string"))
    first = json.dumps({"data": [{"material_name": "mica", "ionic_liquid": "x", "cof": "0.5"}]})
    lib.store_answers(spark.createDataFrame([(h, 0, first) for h in "abcde"], "file_hash string, batch_idx int, answer string"))
    ids = {r.file_hash: r.id for r in lib.literature().collect()}
    wanted = [(i, None) for i in ids.values()] + [(99, None)]
    out = {r.literature_id: r for r in lib.reprocess(spark.createDataFrame(wanted, "id long, content string"), ask, N.Models("first")).collect()}
    assert (out[ids["a"]].success, out[ids["a"]].reprocessed_count, out[ids["a"]].needs_upload) == (True, 2, False)
    assert (out[ids["b"]].success, out[ids["b"]].reprocessed_count) == (True, 0)
    assert not out[ids["c"]].success and out[ids["c"]].needs_upload and "does not have stored file content" in out[ids["c"]].message
    assert not out[ids["d"]].success and out[ids["d"]].message.endswith("away")
    assert out[ids["e"]].message == "File content is empty or too short" and not out[ids["e"]].needs_upload
    assert out[99].message == "Literature ID=99 not found"
    titles = {r.file_hash: (r.title, r.year, r.status) for r in lib.literature().collect()}
    assert titles["a"] == ("Better", 1999, "completed") and titles["b"] == ("b.txt", None, "completed")
    cofs = {k: sorted(r.cof_raw for r in lib.records().where(F.col("literature_id") == i).collect()) for k, i in ids.items()}
    assert cofs == {"a": ["0.1", "0.2"], "b": ["0.5"], "c": ["0.5"], "d": ["0.5"], "e": ["0.5"]}
    given = lib.reprocess(spark.createDataFrame([(ids["c"], "rich " * 200)], "id long, content string"), ask, N.Models("first")).first()
    assert given.success and given.reprocessed_count == 2
    assert lib.literature().where(F.col("id") == ids["c"]).first().content.startswith("rich ")
