"""Fill-in-middle against a plain version, on odd texts and on texts longer than a window of the index."""

import hashlib
import random
import re

import pytest

from labcurate.llm import fill_middle as fm
from labcurate.llm import queries

SF = "/root/testdata/sf0.001"
LONG = "".join(random.Random(5).choice(["word", " ", "é", "x" * 700, "日", "\n", "9", "😀", "ß"]) for _ in range(30000))
TEXTS = [None, "", " ", "abc", "a" * 200_000, LONG, "é" * 3000, "text with <M> in it", "< P> <S <M", "x<S", "\x00\x01 nul", "same", "same", "a<P\n<S\r<M"]


def plain(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows(spark, pairs):
    """Extra columns carry names that the operator uses itself."""
    return spark.createDataFrame([(i, t, 1, "f", "o") for i, t in pairs], "doc_id long, text string, n int, form string, output string")


def test_matches_a_plain_version(spark):
    pairs = [(i * 100 + k, t) for i, t in enumerate(TEXTS) for k in range(12)]
    out = fm.transform(rows(spark, pairs))
    want = {i: plain(i, t) for i, t in pairs}
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()}
    assert got == want
    assert {w[1] for w in want.values()} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in fm.digests(out).collect():
        assert (r.output_sha256, r.restored_sha256) == (sha(want[r.doc_id][4]), sha(dict(pairs)[r.doc_id] or ""))


def test_index_finds_every_unit():
    text = LONG.encode()
    units = fm.Units(text)
    spans = [m.span() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", LONG)]
    assert units.count == len(spans) and units.chars == len(LONG)
    assert len(units.numbers) <= len(spans) / fm.STEP + 2
    for k in [0, 1, fm.STEP - 1, fm.STEP, fm.STEP + 1, len(spans) - 1, *random.Random(1).sample(range(len(spans)), 300)]:
        char = spans[k][0]
        assert units.offset(k) == (len(LONG[:char].encode()), char)
    assert units.offset(len(spans)) == (len(text), len(LONG))


@pytest.mark.parametrize("window", [1, 2, 3, 7, 64])
def test_words_may_cross_windows(monkeypatch, window):
    monkeypatch.setattr(fm, "WINDOW", window)
    monkeypatch.setattr(fm, "STEP", 3)
    text = "abc défg  hij😀klm"
    units = fm.Units(text.encode())
    spans = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    assert [units.offset(k)[1] for k in range(units.count)] == spans and units.chars == len(text)


def test_null_ids_repeats_and_empty_tables(spark):
    got = [tuple(r) for r in fm.transform(rows(spark, [(None, "one two"), (None, "one two"), (3, "x y"), (3, "z")])).collect()]
    assert len(got) == 4 and got[0] == got[1]
    empty = fm.digests(fm.transform(rows(spark, [])))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_query_restores_every_document(spark):
    out = queries.op11_fill_middle(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(docs)
    for r in out:
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
