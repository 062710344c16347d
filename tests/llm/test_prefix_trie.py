"""The prefix trie against a plain one: long, shared, repeated, turnless and odd conversations."""

import hashlib
import random
import zlib

import pytest

from labcurate.llm import common, prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, name long, depth string"


def frame(spark, rows):
    """Extra columns carry names that the operator uses itself."""
    return spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)


def plain(rows):
    item = lambda r: (r[2] or "", r[3] or "")
    digest = lambda r: hashlib.sha256(f"{len(item(r)[0])}:{''.join(item(r))}".encode()).hexdigest()[:32]
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    for c in own:
        own[c] = [item(r) for r in sorted(own[c], key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))]
    members, ends, kids = {}, {}, {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = own.get(base, [])[:h] + t[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(whole[: d - 1]), set()).add(whole[d - 1])
        ends.setdefault(tuple(whole), []).append(c)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, ())), leaves[k], saved[k], sha(ends.get(k, ()))) for k, m in members.items()), key=str)


def check(spark, rows):
    out = prefix_trie.trie(*prefix_trie.rebuilt(frame(spark, rows)))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows)


def test_matches_a_plain_trie(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", "hello é😀"])) for c in [*range(0, 30), 100, 101, 205, 399, -5, -101, 7_000_000_000] for t in range(r.choice([1, 2, 3, 5, 8, 9, 11]))]
    rows += [(31, t, "user", "same") for t in range(70)] + [(32, t, "user", "same") for t in range(67)]  # prefixes of each other, longer than blocks
    rows += [(None, 1, "user", "nobody's"), (33, None, None, None), (33, None, None, None), (33, 2, "user", None), (33, 2, "user", "b"), (33, 2, "a", "b"), (33, 2, "user", "")]
    check(spark, rows)


def test_a_conversation_and_a_turn_that_hold_most_rows(spark, monkeypatch):
    """Hot conversations, turns and ends go their own way; the answers stay."""
    monkeypatch.setattr(common, "HOT_LEAST", 4)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    check(spark, [(0, t, "user", f"{t}") for t in range(90)] + [(c, t, "user", "hi" if t < 2 else f"{c % 3}") for c in range(200, 300) for t in range(3)])


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(150, 0, "user", "x")], [(c, 0, None, "x" * 200_000) for c in range(2)]], ids=["empty", "no id", "one", "long"])
def test_small_tables(spark, rows):
    check(spark, rows)
