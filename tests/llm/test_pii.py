"""Personal data: fixed patterns against Python's regular expressions, and the bootstrapped contexts against a plain version."""

import hashlib
import re
import time

from labcurate.llm import common, pii, queries

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)


def luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base(text):
    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if valid(k, m.group())]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def identifiers(text):
    """(start, end, name, kind, contexts)"""
    hits = [m.span() for m in re.finditer(pii.IDENTIFIER, text)]
    out = []
    for k, (a, b) in enumerate(hits):
        before = text[hits[k - 1][1] if k else 0 : a][-pii.CONTEXT :]
        after = text[b : hits[k + 1][0] if k + 1 < len(hits) else len(text)][: pii.CONTEXT]
        a += len(text[a:b]) - len(text[a:b].lstrip(pii.MARKS.replace("+", "")))
        name = text[a:b].rstrip(pii.MARKS)
        if len(re.sub("[^0-9]", "", name)) < pii.LEAST_DIGITS and not re.search("[A-Za-z0-9]@[A-Za-z0-9]", name):
            continue
        words = lambda t: re.sub("[0-9]+", "0", t.lower()).split()
        left, right = words(before), words(after)
        last = left[-1] if left else ""
        ctx = {f"{left[-2] if len(left) > 1 else ''} {last} _", f"{last} _ {right[0] if right else ''}"} if any(c.isalpha() for c in last) else set()
        kind = next((k for k in KINDS if re.fullmatch(BASE[k], name) and valid(k, name)), None)
        out.append((a, a + len(name), name.lower(), kind, ctx))
    return out


def plain(texts):
    found = [identifiers(t or "") for t in texts]
    edges = {(c, n, k) for f in found for _, _, n, k, ctx in f for c in ctx}
    kinds = {n: k for _, n, k in edges}
    score = {(n, k): 1.0 for n, k in kinds.items() if k}
    for step in range(pii.ROUNDS + 1):
        good = {}
        for p in {c for c, _, _ in edges}:
            names = [n for c, n, _ in edges if c == p]
            for k in reversed(KINDS):
                s = [score[n, k] for n in names if (n, k) in score]
                conf = sum(s) / (len(names) + pii.UNSEEN)
                if len(s) >= pii.LEAST_SUPPORT and conf >= pii.CONFIDENT and conf >= good.get(p, (0,))[0]:
                    good[p] = (conf, k)
        if step < pii.ROUNDS:
            score = {(n, k): 1.0 for n, k in kinds.items() if k}
            for n in {n for n, k in kinds.items() if not k}:
                miss = {}
                for c, m, _ in edges:
                    if m == n and c in good:
                        miss[good[c][1]] = miss.get(good[c][1], 1) * max(1 - good[c][0], 1e-9)
                if miss:
                    k = min(KINDS, key=lambda k: miss.get(k, 2))
                    score[n, k] = 1 - miss[k]
    out = []
    for t, f in zip(texts, found, strict=True):
        have = base(t)
        more = [(max(good[c] for c in ctx if c in good)[1], a, b) for a, b, _, k, ctx in f if not k and any(c in good for c in ctx) and not any(x < b and a < y for _, x, y in have)]
        out.append((listed(have), listed(have + more)))
    return out


def frame(spark, texts):
    """Extra columns carry names that the operator uses itself."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in enumerate(texts)], "doc_id long, text string, row int, base string, kind int, spans string")


def check(spark, texts):
    got = {r.doc_id: r for r in pii.digests(pii.find(frame(spark, texts))).collect()}
    want = plain(texts)
    for i, (b, s) in enumerate(want):
        assert got[i].spans == s, texts[i] and texts[i][:200]
        assert got[i].base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in KINDS] == [len(re.findall(f"{k}:", b)) for k in KINDS]
    return want


ODD = [
    None, "", " ", "a@b.c_d@e.f+g-h@i.j", "a@b@c.d", "a@b", "@", "x.@y.z.", "1.2.3.4.5.6.7.8", "001.2.3.255 256.1.1.1 1.2.3 0000.0.0.00", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111111111111111a 79927398713 0000000000000",
    "+1 (017) 555-7713 +12 +123456789-", "é😀 a@b.co 😀 10.0.0.1", "+1 (2) +3 (4) 555 666 777 8", "same a@b.co", "same a@b.co", "\n+49 30\n123456789", "a" * 3000 + "@" + "b." * 500 + "c", "7 " * 500, "x1@" * 300,
]


def test_fixed_patterns_on_odd_texts(spark):
    want = check(spark, ODD)
    assert {k for b, _ in want for k in re.findall("[a-z]+", b)} == set(KINDS)


def test_contexts_discover_unseen_identifiers(spark):
    seen = [f"Please call me at +1 (20{i}) 555-01{i}7 today." for i in range(8)] + [f"my mail is: user{i}@mail.example.com thanks" for i in range(9)]
    new = ["Please call me at 555-01234 today.", "my mail is: bob.1234@localhost thanks", "call me at 555-01234 or so", "order 55501234 was sent", "the lot 12345678 is 87654321 today"]
    second = [f"reach us under 555-9{i}234 now" for i in range(2)] + ["Please call me at 555-90234 today. Please call me at 555-91234 today."]
    want = check(spark, (seen + new + second) * 2)
    added = [s for b, s in want if s != b]
    assert want[17][1] == "phone:18:27" and want[18][1] == "email:12:30"
    assert want[20][0] == want[20][1] == "" and want[21][1] == ""
    assert len(added) >= 4


def test_hot_contexts_and_names(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    check(spark, [f"mail to: u{i % 30}@mail.example.com now" for i in range(60)] + ["mail to: someone7@intranet now"] * 20 + [f"host {i} is 10.0.0.1 up" for i in range(40)])


RUNS = ["a", "1", "1.", "a@", "+1", "1 ", "a.b-", "1a", "a@b.", "(1"]


def test_long_runs(spark):
    check(spark, [r * 700 for r in RUNS])


def test_linear_time_and_empty_table(spark):
    began = time.time()
    assert pii.digests(pii.find(frame(spark, [r * 200_000 for r in RUNS]))).count() == len(RUNS)
    assert time.time() - began < 60
    assert pii.find(frame(spark, [])).count() == 0


def test_query_finds_every_fixed_match(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_pii(spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(listed(base(docs[r.doc_id])).encode()).hexdigest()
