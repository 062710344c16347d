"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text, reading what stands before and after it; the labels' probabilities at letters are averaged
over the document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labcurate.llm import gru
from labcurate.llm.common import bounded_batches, held_out, make_way, small_batches

UNKNOWN = "und"
#: Bounds of the labelled sample that the network is fitted on: so many documents of each language (of so many languages, the most
#: frequent), so many characters of each.
LANGUAGES = 256
SAMPLE_PER_LANG = 256
SAMPLE_CHARS = 512
UNITS = 8
STEPS = 300
SPAN, MARGIN = 96, 16  # bytes labelled in one run of the network, and read before and after them
ROWS = 1024  # spans in one pass

_LETTER = regex.compile(r"\p{L}")
#: Bytes that may belong to a letter.
_LETTER_BYTE = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


class Model:
    """Weights and labels; small enough to travel with the tasks."""

    def __init__(self, params: gru.Params, labels: list[str]):
        self.params, self.labels = params, labels

    def position_probabilities(self, chunks: np.ndarray) -> np.ndarray:
        """chunks: (N, MARGIN + T + MARGIN) bytes -> (labels, T, N)."""
        p = self.params
        ids = np.ascontiguousarray(chunks.T).astype(np.intp)
        steps, batch = ids.shape
        logits = np.repeat(p["bias"][:, None], (steps - 2 * MARGIN) * batch, axis=1)
        for d in "fb":
            scaled = p["e" + d].copy()
            scaled[: 2 * UNITS] *= 0.25
            states = gru.run(lambda t, out, e=scaled: np.take(e, ids[t], axis=1, out=out, mode="clip"), steps, batch, p["u" + d], d == "b")
            logits += p["w" + d] @ states[:, MARGIN : steps - MARGIN].reshape(UNITS, -1)
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(len(logits), -1, batch)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [t is not None and _LETTER.search(t) is not None for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, k in enumerate(known) if k]
        if not rows or not self.labels:
            return names, scores
        raw = [texts[i].encode() for i in rows]
        counts = np.array([-(-len(b) // SPAN) for b in raw])
        gap = b"\0" * MARGIN
        flat = np.frombuffer(gap + b"".join(b.ljust(n * SPAN, b"\0") + gap for b, n in zip(raw, counts.tolist(), strict=True)), np.uint8)
        begin = SPAN * np.arange(int(counts.sum())) + MARGIN * np.repeat(np.arange(len(raw)), counts)  # of each span's margin
        sums, weight = np.zeros((len(begin), len(self.labels))), np.zeros(len(begin))
        for at in range(0, len(begin), ROWS):
            part = flat[begin[at : at + ROWS, None] + np.arange(SPAN + 2 * MARGIN)]
            mask = _LETTER_BYTE[part[:, MARGIN : MARGIN + SPAN].T].astype(np.float32)
            sums[at : at + ROWS] = (self.position_probabilities(part) * mask).sum(axis=1).T
            weight[at : at + ROWS] = mask.sum(axis=0)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        total = np.add.reduceat(sums, first) / np.maximum(np.add.reduceat(weight, first), 1)[:, None]
        for i, best, s in zip(rows, total.argmax(axis=1).tolist(), total.max(axis=1).tolist(), strict=True):
            names[i], scores[i] = self.labels[best], min(1.0, max(0.0, s))
        return names, scores


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, piece of text) of labelled documents outside the held-out fold: of each language at most SAMPLE_PER_LANG documents,
    one for each slot of a hash of the id, and of each at most SAMPLE_CHARS characters from a place that the hash gives."""
    hashed = F.xxhash64(F.col("doc_id"))
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", hashed.alias("h"), F.pmod(hashed, F.lit(SAMPLE_PER_LANG)).alias("slot"))
    frequent = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).select("lang")
    chosen = rows.groupBy("lang", "slot").agg(F.min("h").alias("h")).join(F.broadcast(frequent), "lang").collect()  # at most LANGUAGES * SAMPLE_PER_LANG
    if not chosen:
        return []
    wanted = {(r.lang, r.h) for r in chosen}
    start = 1 + F.pmod(F.col("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)))
    piece = F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS))
    picked = rows.where(F.col("h").isin(sorted({h for _, h in wanted}))).select("lang", "h", piece.alias("piece")).limit(2 * len(wanted)).collect()
    return sorted({(r.lang, r.piece) for r in picked if (r.lang, r.h) in wanted})


def train(pieces: list[tuple[str, str]], seed: int = 7) -> Model:
    """Backpropagation through time over random windows, each language as often as the others."""
    labels = sorted({lang for lang, _ in pieces})
    rng = np.random.default_rng(seed)
    params: gru.Params = {"bias": np.zeros(len(labels), np.float32)}
    for d in "fb":
        params |= {"e" + d: gru.init(rng, 3 * UNITS, 256, scale=0.3), "u" + d: gru.init(rng, 3 * UNITS, UNITS), "w" + d: gru.init(rng, len(labels), UNITS)}
    model = Model(params, labels)
    texts = [[np.frombuffer(p.encode(), np.uint8) for lang, p in pieces if lang == name and p] for name in labels]
    if len(labels) < 2 or not all(texts):
        return model
    adam, length, batch = gru.Adam(params, 0.02), 64, 64
    for _ in range(STEPS):
        y = rng.integers(0, len(labels), batch)
        ids, mask = np.zeros((length, batch), np.intp), np.zeros((length, batch), np.float32)
        for i, k in enumerate(y):
            raw = texts[k][rng.integers(len(texts[k]))]
            at = rng.integers(0, max(1, len(raw) - length + 1))
            part = raw[at : at + length]
            ids[: len(part), i], mask[: len(part), i] = part, _LETTER_BYTE[part]
        states, caches = {}, {}
        for d in "fb":
            pre = params["e" + d][:, ids].transpose(1, 0, 2)
            states[d], caches[d] = gru.forward(pre, params["u" + d], d == "b")
        logits = np.matmul(params["wf"], states["f"]) + np.matmul(params["wb"], states["b"]) + params["bias"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        g = np.exp(logits)
        g /= g.sum(axis=1, keepdims=True)
        g[:, y, np.arange(batch)] -= 1
        g *= mask[:, None, :] / max(1.0, mask.sum())
        grads: gru.Params = {"bias": g.sum(axis=(0, 2))}
        for d in "fb":
            grads["w" + d] = np.einsum("tlb,thb->lh", g, states[d])
            d_pre, grads["u" + d] = gru.backward(np.matmul(params["w" + d].T, g), caches[d], params["u" + d], d == "b")
            d_e = np.zeros((256, 3 * UNITS), np.float32)
            np.add.at(d_e, ids.ravel(), d_pre.transpose(0, 2, 1).reshape(-1, 3 * UNITS))
            grads["e" + d] = d_e.T
        adam.step(grads)
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (replaced where they exist).

    Every whole text is labelled, row by row; no shuffle.  Null texts and texts without a letter get ``und`` and 0, as does
    everything where no label can be learnt.  Repeated rows get the same answer; an empty table gives none.  lang is used for
    fitting only.
    """
    if model is None:
        model = train(sample(docs))
    base = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", lang_pred string, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_way("langid")
        for batch in bounded_batches(batches, "text", 1 << 20):
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return small_batches(base).mapInArrow(run, schema)
