"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as words; a word's input joins a word vector and the mean of its character n-grams' vectors.  Attention pools the
network's states over windows; every window of a text is scored, one beginning at each word, and the worst is the text's score.
A label says that some window of its document is toxic, so training follows the window that scores highest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labcurate.llm import gru
from labcurate.llm.common import bounded_batches, held_out, make_way, small_batches

#: Bounds of the labelled sample that the network is fitted on: documents of each label, and their length in characters.
SAMPLE_PER_LABEL = 1024
SAMPLE_CHARS = 20_000
#: A document is predicted toxic from this score on.
TOXIC_FROM = 0.3
WINDOW = 32  # words; a power of two
SPAN, MARGIN = 96, 12  # words scored in one run of the network, and read before and after them
GAP = max(WINDOW, MARGIN)
UNITS = 8
WORD_DIM, CHAR_DIM = 8, 8
VOCABULARY = 20_000
LEAST_DOCS = 3  # a word of the vocabulary is in so many documents of the sample
CHAR_BUCKETS = 4096
STEPS, WARM, HALF = 400, 150, 16
RATE = 0.01
WORD_RATE, CHAR_RATE = 16.0, 4.0
DECAY = 0.001  # of the word and n-gram vectors in each step
CLIP = 8.0  # of the logarithm of a word's weight in the pooling
CLEAN_WEIGHT = 4  # a clean document flagged counts as so many toxic ones missed when the cut is set
ROWS = 512  # spans in one pass
MEMO_ENTRIES = 50_000

_WORD = re.compile(r"\w+")
_DIM = WORD_DIM + CHAR_DIM


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def char_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-grams of ``<word>`` for all words end to end, and where each word's begin."""
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.intp)  # as many 3-grams as characters
    h = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)
    h ^= h >> np.uint64(15)
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(len(words)), sizes)
    return (h[at] % np.uint64(CHAR_BUCKETS)).astype(np.intp), first


class Layout:
    """Texts laid end to end with room between them, each filled up to whole spans.

    at: first place of each text; spans: first place of every span; windows(): for each text the places where its windows of WINDOW
    words begin, all of them (one for a shorter text).
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        whole = -(-counts // SPAN) * SPAN
        self.at = GAP + np.cumsum(whole + GAP) - (whole + GAP)
        self.size = int((whole + GAP).sum()) + GAP
        n = whole // SPAN
        self.spans = np.repeat(self.at, n) + SPAN * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))

    def places(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of the first n places of each text."""
        doc = np.repeat(np.arange(len(n)), n)
        return doc, self.at[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return self.places(np.where(self.counts > 0, np.maximum(self.counts - WINDOW, 0) + 1, 0))


class Model:
    """Weights and vocabulary; small enough to travel with the tasks."""

    def __init__(self, params: gru.Params, vocabulary: dict[str, int]):
        self.params, self.vocabulary = params, vocabulary

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("params", "vocabulary")}

    def inputs(self, words: list[str]) -> np.ndarray:
        """(words, _DIM)"""
        p = self.params
        at = np.array([self.vocabulary.get(w, 0) for w in words], np.intp)
        flat, first = char_ids(words)
        sizes = np.diff(np.append(first, len(flat)))
        chars = np.add.reduceat(p["char"][flat], first) / sizes[:, None]
        return np.concatenate([p["word"][at], chars], axis=1).astype(np.float32)

    def pre(self, x: np.ndarray) -> np.ndarray:
        """What inputs add to the gates, (2, inputs, 3 * UNITS), scaled as gru.run() wants it."""
        p = self.params
        both = np.stack([x @ p["w" + d].T + p["c" + d] for d in "fb"])
        both[:, :, : 2 * UNITS] *= 0.25
        return both

    def places(self, pre: np.ndarray, flat: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """For each place its weight in the pooling (0 where no word stands) and weight times evidence.  flat: rows of ``pre``.

        The network reads each span with MARGIN words of what stands before and after it.
        """
        p = self.params
        weight, evidence = np.zeros(layout.size, np.float32), np.zeros(layout.size, np.float32)
        steps = SPAN + 2 * MARGIN
        for at in range(0, len(layout.spans), ROWS):
            begin = layout.spans[at : at + ROWS]
            i = np.ascontiguousarray(flat[begin - MARGIN + np.arange(steps)[:, None]])
            rows = np.empty((len(begin), 3 * UNITS), np.float32)

            def fill(t: int, o: np.ndarray, table: np.ndarray, i: np.ndarray = i, rows: np.ndarray = rows) -> None:
                np.take(table, i[t], axis=0, out=rows, mode="clip")
                np.copyto(o, rows.T)

            states = [gru.run(lambda t, o, k=k: fill(t, o, pre[k]), steps, len(begin), p["u" + d], d == "b") for k, d in enumerate("fb")]
            h = np.concatenate([s[:, MARGIN : MARGIN + SPAN] for s in states]).reshape(2 * UNITS, -1)
            both = (np.stack([p["attend"], p["out"]]) @ h).reshape(2, SPAN, -1)
            e = np.exp(np.clip(both[0], -CLIP, CLIP))
            where = begin + np.arange(SPAN)[:, None]
            weight[where], evidence[where] = e, e * both[1]
        _, held = layout.places(layout.counts)
        words = np.zeros(layout.size, bool)
        words[held] = True
        weight[~words] = 0
        evidence[~words] = 0
        return weight, evidence

    def logits(self, weight: np.ndarray, evidence: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Attention pooling over the windows that begin at the places given."""
        for k in range(WINDOW.bit_length() - 1):  # sums of 2, 4, 8 ... places
            weight, evidence = (x + np.append(x[1 << k :], np.zeros(1 << k, x.dtype)) for x in (weight, evidence))
        return evidence[begin] / weight[begin] + self.params["bias"][0]

    def score(self, texts: list[str | None]) -> list[float]:
        """Of whole texts: the worst of all windows; one without words scores 0."""
        memo: dict[str, int] = self.__dict__.setdefault("memo", {})
        if len(memo) > MEMO_ENTRIES or "table" not in self.__dict__:
            memo.clear()
            self.table = np.empty((2, 1 << 14, 3 * UNITS), np.float32)
            self.table[:, 0] = self.pre(np.zeros((1, _DIM), np.float32))[:, 0]  # no word
        split = [words_of(t) for t in texts]
        new = list(set().union(*split).difference(memo)) if split else []
        if new:
            n = 1 + len(memo)
            memo.update(zip(new, range(n, n + len(new)), strict=True))
            while n + len(new) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.empty_like(self.table)], axis=1)
            self.table[:, n : n + len(new)] = self.pre(self.inputs(new))
        layout = Layout(np.array([len(w) for w in split], np.intp))
        flat = np.zeros(layout.size, np.intp)
        _, held = layout.places(layout.counts)
        flat[held] = np.fromiter((memo[w] for words in split for w in words), np.intp, len(held))
        doc, begin = layout.windows()
        best = np.full(len(texts), -np.inf)
        if len(doc):
            z = self.logits(*self.places(self.table, flat, layout), begin)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            best[doc[first]] = np.maximum.reduceat(z, first)
        return np.where(layout.counts > 0, 1 / (1 + np.exp(-np.clip(best, -60, 30))), 0.0).tolist()


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str]]:
    """(toxic, text) of labelled documents outside the held-out fold: of each label at most SAMPLE_PER_LABEL documents of at most
    SAMPLE_CHARS characters, one for each slot of a hash of the id.  A document with labels that differ counts as toxic."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(~held_out(F.col("doc_id")) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    h = F.xxhash64("doc_id")
    known = marks.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic", h.alias("h"), F.pmod(h, F.lit(SAMPLE_PER_LABEL)).alias("slot"))
    have = rows.select("doc_id").join(known, "doc_id")
    chosen = have.groupBy("toxic", "slot").agg(F.min_by("doc_id", "h").alias("doc_id")).collect()  # at most SAMPLE_PER_LABEL for each label
    toxic = {r.doc_id: r.toxic for r in chosen}
    if not toxic:
        return []
    picked = rows.where(F.col("doc_id").isin(sorted(toxic))).limit(2 * len(toxic)).collect()
    return sorted({(toxic[r.doc_id], r.text) for r in picked})


def train(docs: list[tuple[int, str]], seed: int = 11) -> Model:
    """Backpropagation through time over one window of each document drawn: at random in the first WARM steps, then the window that
    scores highest."""
    rng = np.random.default_rng(seed)
    split = [(y, w) for y, t in docs if (w := words_of(t))]
    n = [sum(1 for y, _ in split if y == k) for k in (0, 1)]
    common = Counter(w for _, words in split for w in set(words)).most_common(VOCABULARY)
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, c in common if c >= LEAST_DOCS))}
    p: gru.Params = {"word": np.zeros((len(vocabulary) + 1, WORD_DIM), np.float32), "char": gru.init(rng, CHAR_BUCKETS, CHAR_DIM, scale=0.02), "attend": gru.init(rng, 2 * UNITS, scale=0.1), "out": gru.init(rng, 2 * UNITS), "bias": np.full(1, -1, np.float32)}
    for d in "fb":
        p |= {"w" + d: gru.init(rng, 3 * UNITS, _DIM), "u" + d: gru.init(rng, 3 * UNITS, UNITS), "c" + d: np.zeros(3 * UNITS, np.float32)}
    model = Model(p, vocabulary)
    if not all(n):
        return model
    names = ["", *sorted({w for _, words in split for w in words})]  # the first stands for no word
    number = {w: i for i, w in enumerate(names)}
    at = np.array([vocabulary.get(w, 0) for w in names], np.intp)
    flat_grams, first_gram = char_ids(names[1:])
    gram_begin = np.concatenate([[0], first_gram, [len(flat_grams)]])  # none for the first
    ids = [np.array([number[w] for w in words], np.intp) for _, words in split]
    labels = np.array([y for y, _ in split])
    groups = [np.flatnonzero(labels == k) for k in (0, 1)]
    adam = gru.Adam({k: v for k, v in p.items() if k not in ("word", "char")}, RATE)
    rows = np.arange(-MARGIN, WINDOW + MARGIN)

    def looked_up(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The distinct words of places as inputs, the places as rows of those, and what their gradients need."""
        used, inverse = np.unique(places, return_inverse=True)
        sizes = gram_begin[used + 1] - gram_begin[used] if used[0] else np.concatenate([[0], gram_begin[used[1:] + 1] - gram_begin[used[1:]]])
        first = np.cumsum(sizes) - sizes
        grams = flat_grams[np.arange(int(sizes.sum())) + np.repeat(gram_begin[used] - first, sizes)]
        chars = np.zeros((len(used), CHAR_DIM), np.float32)
        np.add.at(chars, np.repeat(np.arange(len(used)), sizes), p["char"][grams])
        x = np.concatenate([np.where(used[:, None] > 0, p["word"][at[used]], 0), chars / np.maximum(sizes, 1)[:, None]], axis=1).astype(np.float32)
        return x, inverse.reshape(places.shape), (used, grams, sizes)

    for step in range(STEPS):
        chosen = np.concatenate([rng.choice(groups[0], HALF), rng.choice(groups[1], HALF)])
        y = labels[chosen]
        layout = Layout(np.array([len(ids[i]) for i in chosen]))
        flat = np.zeros(layout.size, np.intp)
        _, held = layout.places(layout.counts)
        flat[held] = np.concatenate([ids[i] for i in chosen])
        doc, begin = layout.windows()
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        if step < WARM:
            best = begin[first + (rng.random(len(first)) * np.diff(np.append(first, len(doc)))).astype(np.intp)]
        else:
            x, where, _ = looked_up(flat)
            z = model.logits(*model.places(model.pre(x), where, layout), begin)
            best = np.array([begin[f + z[f:e].argmax()] for f, e in zip(first, np.append(first[1:], len(z)), strict=True)])
        x, win, (used, grams, sizes) = looked_up(flat[best + rows[:, None]])  # (T, B)
        mask = (rows[:, None] >= 0) & (rows[:, None] < WINDOW) & (best + rows[:, None] < (layout.at + layout.counts))
        xs = x[win].transpose(0, 2, 1)  # (T, D, B)
        states, caches = [], []
        for d in "fb":
            h, c = gru.forward(np.matmul(p["w" + d], xs) + p["c" + d][:, None], p["u" + d], d == "b")
            states.append(h)
            caches.append(c)
        h = np.concatenate(states, axis=1)  # (T, 2H, B)
        e = np.where(mask, np.exp(np.clip(np.einsum("h,thb->tb", p["attend"], h), -CLIP, CLIP)), 0)
        e /= e.sum(axis=0)
        v = np.einsum("h,thb->tb", p["out"], h)
        pooled = (e * v).sum(axis=0)
        g = (1 / (1 + np.exp(-(pooled + p["bias"][0]))) - y) / len(chosen)
        d_e = e * (v - pooled) * g
        grads: gru.Params = {"bias": np.array([g.sum()], np.float32), "out": np.einsum("tb,thb->h", e * g, h), "attend": np.einsum("tb,thb->h", d_e, h)}
        d_h = (p["out"][:, None] * (e * g)[:, None, :] + p["attend"][:, None] * d_e[:, None, :]).astype(np.float32)
        d_x = np.zeros_like(xs)
        for k, d in enumerate("fb"):
            d_pre, grads["u" + d] = gru.backward(d_h[:, k * UNITS : (k + 1) * UNITS], caches[k], p["u" + d], d == "b")
            grads["w" + d] = np.einsum("tgb,tdb->gd", d_pre, xs)
            grads["c" + d] = d_pre.sum(axis=(0, 2))
            d_x += np.matmul(p["w" + d].T, d_pre)
        by_word = np.zeros((len(used), _DIM), np.float32)
        np.add.at(by_word, win.ravel(), d_x.transpose(0, 2, 1).reshape(-1, _DIM))
        # Plain steps for the tables: a word seen once moves little, one that keeps to a label moves far.
        known = at[used] > 0
        np.add.at(p["word"], at[used][known], -WORD_RATE * by_word[known, :WORD_DIM])
        np.add.at(p["char"], grams, -CHAR_RATE * np.repeat(by_word[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
        p["word"] *= 1 - DECAY
        p["char"] *= 1 - DECAY
        adam.step(grads)
    # The cut that parts the sample best is moved to TOXIC_FROM.
    s = np.clip(np.array(model.score([" ".join(words) for _, words in split])), 1e-12, 1 - 1e-12)
    z, order = np.log(s / (1 - s)), np.argsort(s)
    z, y = z[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) / n[1] + CLEAN_WEIGHT * np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]]) / n[0]
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gap = np.concatenate([[0], np.diff(z), [0]])
    p["bias"] += np.float32(np.log(TOXIC_FROM / (1 - TOXIC_FROM)) - edges[least[gap[least].argmax()]])
    model.__dict__.pop("table", None)
    return model


def detect(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` and score, predicted (replaced where they exist).

    Every whole text is scored, row by row; no shuffle.  A null or empty text, or one without words, scores 0 and is not toxic.
    Repeated rows get the same answer; an empty table gives none.  labels (doc_id, toxic) serve to fit the model only; without any
    labelled row of both kinds the scores say nothing.
    """
    if model is None:
        model = train(sample(docs, labels))
    base = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", score double, predicted int"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_way("toxicity")
        for batch in bounded_batches(batches, "text", 1 << 20):
            scores = model.score(batch.column("text").to_pylist())
            marks = pa.array([int(s >= TOXIC_FROM) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), marks], [*batch.schema.names, "score", "predicted"])

    return small_batches(base).mapInArrow(run, schema)
