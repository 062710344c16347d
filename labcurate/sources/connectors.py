"""Outside services as replaceable functions that run once for each distinct key or batch; a replay table stands in offline."""

from __future__ import annotations

import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as NoResult
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labcurate.functions import json_fields as J
from labcurate.functions import parsing as P
from labcurate.operators.tables import Conflict, SnapshotTable

Fetch = Callable[[str], str | None]
#: (model, request as JSON text) -> answer
Ask = Callable[[str, str], str]
#: Requests that one task has under way at a time.
AT_ONCE = 8
#: The first pass: characters of a text that it sees, its temperature, and seconds that it may take.
HEAD, HEAD_TEMPERATURE, HEAD_SECONDS = 4000, 0.1, 30.0


@dataclass(frozen=True)
class Models:
    """What an extractor calls.  The fallback is asked where the first model is not there or refuses the request as such; ``text`` is
    the model of the first pass, by default the first one.  ``seconds`` is how long a request may take."""

    first: str
    fallback: str | None = None
    temperature: float = 0.0
    text: str | None = None
    seconds: float | None = 180.0
    at_once: int = AT_ONCE


def with_fallback(ask: Ask, models: Models) -> Fetch:
    """One request to the first model, and to the fallback where the error says so; other errors go on."""

    def run(request: str) -> str | None:
        try:
            return ask(models.first, request)
        except Exception as e:  # a client library's own kinds of error
            refused = getattr(e, "status_code", None) in (400, 404) or re.search(r"model_not_found|\b40[04]\b", str(e))
            if models.fallback is None or not refused:
                raise
            return ask(models.fallback, request)

    return run


def with_limit(fetch: Fetch, seconds: float | None) -> Fetch:
    """An error where no answer comes in time.  The call itself is left to end by its client's own limit."""

    def run(key: str) -> str | None:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(fetch, key).result(seconds)
        except NoResult:
            raise TimeoutError(f"no answer after {seconds:g} s") from None
        finally:
            pool.shutdown(wait=False)

    return fetch if seconds is None else run


def with_retries(fetch: Fetch, attempts: int = 3, first_wait: float = 1.0, quiet: bool = True) -> Fetch:
    """Try again after transport errors, waiting twice as long each time; then, and after any other error, null.  If not ``quiet`` the
    last transport error goes on, so that no line is not taken for no answer."""

    def run(key: str) -> str | None:
        for n in range(attempts):
            try:
                return fetch(key)
            except OSError:
                if n + 1 < attempts:
                    time.sleep(first_wait * 2**n)
                elif not quiet:
                    raise
            except ValueError:
                return None
        return None

    return run


def called(keys: DataFrame, key: str, fetch: Fetch, answer: str = "answer") -> DataFrame:
    """(key, answer) for each distinct key that is not null or empty."""
    return answered(keys.select(key).where(F.col(key) != "").distinct(), key, fetch, answer).drop("error")


def _under_way(one: Callable[[str], tuple], keys: list, at_once: int, seconds: float | None) -> list[tuple]:
    """What ``one`` makes of each key, in order, by at most ``at_once`` threads that take one key after the other.

    A call that takes longer than ``seconds`` is left to end by its client's own limit: its key gets an error, its thread takes no more,
    and a new one stands in.
    """
    made, todo, begun = [None] * len(keys), deque(range(len(keys))), {}

    def work() -> None:
        while True:
            try:
                i = todo.popleft()
            except IndexError:
                return
            begun[i] = time.monotonic(), threading.current_thread()
            out = one(keys[i])
            if begun.pop(i, None) is None:  # given up; of the two that take it out of begun one does
                return
            made[i] = out

    def start() -> threading.Thread:
        t = threading.Thread(target=work, daemon=True)
        t.start()
        return t

    threads = [start() for _ in range(min(at_once, len(keys)))]
    while threads:
        now = time.monotonic()
        since = min((t for t, _ in begun.copy().values()), default=now)
        threads[-1].join(None if seconds is None else max(0.0, since + seconds - now))
        if not threads[-1].is_alive():
            threads.pop()
        elif seconds is not None:
            for i, (since, thread) in begun.copy().items():
                if time.monotonic() - since >= seconds and begun.pop(i, None):
                    made[i] = None, f"no answer after {seconds:g} s"
                    threads.remove(thread)
                    threads.insert(0, start())
    return made


def answered(requests: DataFrame, request: str, fetch: Fetch, answer: str = "answer", at_once: int = AT_ONCE, seconds: float | None = None) -> DataFrame:
    """All columns of ``requests``, the answer to each row's request, and error: what went wrong with a row stays with it, and so does that
    no answer came within ``seconds``.

    A task has up to ``at_once`` requests under way; each answer goes to its row, in whatever order they come.  How many are under way
    in all is that times the running tasks, which repartitioning bounds.
    """
    at = requests.columns.index(request)

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return fetch(text), None
        except Exception as e:  # whatever a client library raises concerns this row only
            return None, str(e) or type(e).__name__

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _under_way(one, b.column(at).to_pylist(), at_once, seconds)
            new = [pa.array([m[i] for m in made], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, answer, "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInArrow(run, f"{schema}, `{answer}` string, error string")


class AnswerCache:
    """Answers that outlive the job that asked for them: one call a key until its entry expires, also for keys that the service does
    not know.  What failed on the way is not kept."""

    def __init__(self, spark: SparkSession, path: str, days: float = 30.0, buckets: int = 8):
        self.days = days
        self._table = SnapshotTable(spark, path, StructType.fromDDL("key string, answer string, asked_at timestamp"), key="key", buckets=buckets)

    def _fresh(self, keys: DataFrame) -> DataFrame:
        age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("asked_at")
        return self._table.rows_of(keys.select("key")).where(age < self.days * 86400)

    def answers(self, keys: DataFrame, key: str, fetch: Fetch, answer: str = "answer", at_once: int = AT_ONCE) -> DataFrame:
        """(key, answer) for each distinct key that is not null or empty, null where the service knows nothing or could not be reached.
        Keys without an entry are asked for now; those in the table are looked up in their buckets only."""
        wanted = keys.select(F.col(key).alias("key")).where(F.col("key") != "").distinct()
        while True:
            base = self._table.version()
            missing = wanted.join(self._fresh(wanted), "key", "left_anti")
            if missing.isEmpty():
                break
            asked = answered(missing, "key", fetch, at_once=at_once).where(F.col("error").isNull())
            try:  # the answers are written once, in the place of expired ones
                self._table.change(new=asked.select("key", "answer", F.current_timestamp().alias("asked_at")), gone=missing, base=base)
                break
            except Conflict:  # another job has asked; what it has is looked up first
                continue
        return wanted.join(self._fresh(wanted), "key", "left").select(F.col("key").alias(key), F.col("answer").alias(answer))


def extraction_messages(prompt: str, images: Column, text: Column, models: Models, system: str | None = None) -> Column:
    """The request for one batch as JSON text: instructions and text, then its images; images that could not be read are left out.
    ``system`` is what the model is told about its part, if anything."""
    kept = F.filter(images, lambda x: x.isNotNull())
    told = [F.lit(system).alias("system")] if system is not None else []
    return F.to_json(F.struct(F.lit(models.first).alias("model"), F.lit(models.temperature).alias("temperature"), *told, F.concat(F.lit(prompt), F.coalesce(text, F.lit(""))).alias("text"), kept.alias("images")))


def head_messages(prompt: str, text: Column, image: Column, models: Models, system: str | None = None) -> Column:
    """The first pass's request for one document as JSON text: instructions and the text's head, and the first page's image if any."""
    kept = F.filter(F.array(image), lambda x: x.isNotNull())
    told = [F.lit(system).alias("system")] if system is not None else []
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD)
    return F.to_json(F.struct(F.lit(models.text or models.first).alias("model"), F.lit(HEAD_TEMPERATURE).alias("temperature"), *told, F.concat(F.lit(prompt), head).alias("text"), kept.alias("images")))


def first_pass(requests: DataFrame, ask: Ask, models: Models) -> DataFrame:
    """file_hash, answer: bibliographic data for each document (column request), an empty object where none came in time."""
    out = answered(requests.select("file_hash", "request"), "request", lambda request: ask(models.text or models.first, request), at_once=models.at_once, seconds=HEAD_SECONDS)
    return out.select("file_hash", F.coalesce("answer", F.lit("{}")).alias("answer"))


def extracted(requests: DataFrame, ask: Ask, models: Models) -> DataFrame:
    """file_hash, batch_idx, answer, error: each batch's request (column request) is answered for itself; an error leaves an empty list."""
    out = answered(requests.select("file_hash", "batch_idx", "request"), "request", with_fallback(ask, models), at_once=models.at_once, seconds=models.seconds)
    return out.select("file_hash", "batch_idx", F.coalesce("answer", F.lit("[]")).alias("answer"), "error")


def chat_answers(questions: DataFrame, context: DataFrame, ask: Ask, models: Models, key: str = "conv_id") -> DataFrame:
    """key, answer, error: each question (key, message) with its context (key, context), which may be missing."""
    request = F.to_json(F.struct(F.col("message"), F.coalesce("context", F.lit("")).alias("context")))
    asked = questions.select(key, "message").join(context.select(key, "context"), key, "left").select(key, request.alias("request"))
    return answered(asked, "request", with_fallback(ask, models)).select(key, "answer", "error")


def replayed(keys: DataFrame, key: str, recorded: DataFrame, answer: str = "answer") -> DataFrame:
    """As called(), from a table of recorded answers (key, answer)."""
    return keys.select(key).where(F.col(key) != "").distinct().join(recorded.select(key, answer), key, "left")


def bibliographies(dois: DataFrame, column: str, answers: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """doi and the fields of the registry's entry, for each distinct normalised DOI; nulls where the service knows nothing."""
    keys = dois.select(P.normalize_doi(F.col(column)).alias("doi"))
    return answers(keys, "doi").select("doi", J.bibliography(F.col("answer"), F.col("doi")).alias("b")).select("b.*")


def extraction_requests(pages: DataFrame, size: int = 3) -> DataFrame:
    """file_hash, batch_idx, pages array<struct>: the selected pages of a file in order, ``size`` to a request."""
    from labcurate.operators.curate import batches

    numbered = batches(pages, "file_hash", "page_no", size)
    return numbered.groupBy("file_hash", "batch_idx").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))


def metadata_requests(texts: DataFrame, most: int = HEAD) -> DataFrame:
    """The head of each text, for the pass that asks for bibliographic data."""
    return texts.select("file_hash", F.substring("text", 1, most).alias("head"))


def metadata_answers(answers: DataFrame) -> DataFrame:
    """Adds title, authors, journal, doi, year: missing text is empty, a year that is not a number is null."""
    v = F.try_parse_json(P.json_body(F.col("answer")))
    text = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")).alias(k)
    return answers.select("file_hash", *[text(k) for k in ("title", "authors", "journal", "doi", "issn", "volume", "issue", "pages")], F.trim(F.try_variant_get(v, "$.year", "string")).try_cast("int").alias("year"))
