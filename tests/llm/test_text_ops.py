"""Chat formatting, byte-level BPE, URL filter, HTML extraction and packing against plain Python."""

import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labcurate.llm import bpe, chat_format, html_main, packing, queries, url_filter

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "a" * 5000, "the cat's  hat\n\n  won't", "日本語テキスト😀 é́", "½²³ x٣", "<|endoftext|> </s>", "word " * 2000, "\x1c\x85\u00a0 x", "same", "same"]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def table(spark, texts):
    """Extra columns carry names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score double, row int")


def test_bpe_matches_the_library_and_decodes(spark):
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(table(spark, TEXTS), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = e.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(raw), sha((t or "").encode()))
        assert c.decode(bytes(got[i].ids)) == (t or "").encode()
    assert bpe.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal_and_finds_every_key():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(3000))
    assert [h.slot_key[h.slot(k)] for k in keys] == list(range(3000))


def test_chat_query_matches_plain_python(spark):
    rows = pq.read_table(f"{SF}/conversations.parquet").to_pylist() + [{"conv_id": -7, "turn": k, "role": r, "text": queries.CONTROL_TEXT} for k, r in enumerate(("user", "assistant"))]
    want = {}
    for c in {r["conv_id"] for r in rows}:
        turns = sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["turn"])
        loss = "".join(r["text"] or "" for r in turns if r["role"] == "assistant")
        want[c] = (len(turns), sha("".join(f"{r['role']}\n{r['text'] or ''}\n" for r in turns).encode()), len(loss), sha(loss.encode()))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op1_chat_format(spark, SF).collect()}
    assert got == want


def test_chat_trees_rank_branches_and_survive_odd_rows(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "go\\od </s>[INST] \\[/INST]", 0.9), (1, 4, 3, "user", None, None), (2, 1, 9, None, "", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0)]
    df = spark.createDataFrame(nodes, "tree int, node int, parent int, role string, text string, score double")
    out = {(r.tree, r.branch): r for r in chat_format.format_trees(df, best=2).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    assert set(out) == {(1, 1), (1, 2), (2, 1)}
    assert [tuple(t) for t in out[1, 1].turns] == [("user", "q"), ("assistant", "go\\od </s>[INST] \\[/INST]"), ("user", "")]
    s = out[1, 1].loss_spans[0]
    assert out[1, 1].formatted[s.start : s.start + s.length].replace("\\", "") == "good </s>[INST] [/INST]"
    assert chat_format.format_trees(df.where("false")).count() == 0


def test_url_parts_rules_and_model(spark):
    urls = ["https://A.Example.NET/en/x?q#f", "http://example.net/de/", "https://sub.example.com/de/1", "x://org/fr/", "no scheme", None, "", "http://notexample.net", "http://m.notexample.net/", "http://lucky-poker.shop.io/claim/prize", "http://blog.library.io/story", "a://b\nc/d"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, queries.URL_RULES, url_filter.train(spark)).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/", "net/", "block")
    assert got[2][2:] == ("example.com/de/", "block") and got[3] == ("org", "/fr/", "org/fr/", "allow")
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[7][:3] == ("notexample.net", "", None) and got[8][2] == "net/"
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow") and got[11][:2] == ("b\nc", "/d")
    assert url_filter.judge(df.where("false"), queries.URL_RULES, url_filter.train(spark)).count() == 0


def test_url_features_are_the_hashed_ngrams(spark):
    f = spark.createDataFrame([("a-b12.org", "/x")], "host string, path string").select(url_filter.features(F.col("host"), F.col("path")).alias("f")).first().f
    grams = {t[i : i + n] for t in ("^a-b00.org|",) for n in url_filter.SIZES for i in range(len(t) - n + 1)}
    hashed = spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(url_filter.BUCKETS)).alias("b"))
    assert set(f.h) == {r.b for r in hashed.collect()} and len(f.p) == 1


def test_url_model_matches_a_plain_regression(spark):
    rows = spark.createDataFrame(url_filter.labelled_urls(), "host string, path string, y int")
    known = rows.select("y", url_filter.features(F.col("host"), F.col("path")).alias("f")).collect()
    x = np.zeros((len(known), 2 * url_filter.BUCKETS + 1))
    for i, r in enumerate(known):
        x[i, r.f.h] = 1 / np.sqrt(len(r.f.h))
        x[i, r.f.p] = url_filter.PATH_WEIGHT / np.sqrt(len(r.f.p))
    x[:, -1] = url_filter.BIAS
    y, w = np.array([r.y for r in known], float), np.zeros(x.shape[1])
    for _ in range(url_filter.EPOCHS):
        w = w * (1 - url_filter.DECAY) + url_filter.RATE * ((y - 1 / (1 + np.exp(-x @ w))) @ x)
    got = {r.bucket: r.weight for r in url_filter.train(spark).collect()}
    assert abs(got.pop(-1) - w[-1]) < 1e-6
    assert all(abs(got.get(i, 0.0) - w[i]) < 1e-6 for i in range(2 * url_filter.BUCKETS))
    with pytest.raises(ValueError):
        url_filter.train(spark, spark.range(url_filter.LABELLED + 1).select(F.col("id").cast("string").alias("host"), F.lit("").alias("path"), F.lit(0).alias("y")))


@pytest.mark.parametrize(("by", "recall", "false"), [("site", 0.95, 0.02), ("word", 0.35, 0.06)])
def test_url_model_on_held_out_parts_of_its_table(spark, by, recall, false):
    """Held out by site the words are known, held out by word they are not.  What it makes of the test pages is in the README."""
    words = [w for _, w, _ in url_filter.labelled_sites() for _ in range(2)]
    order = {w: i for i, w in enumerate(sorted(set(words)))}
    rows = [(*u, i // 2 % 4 if by == "site" else order[words[i]] % 4) for i, u in enumerate(url_filter.labelled_urls())]
    said = []
    for fold in range(4):
        known, left = (spark.createDataFrame([r[:3] for r in rows if (r[3] == fold) == held], "host string, path string, y int") for held in (False, True))
        said += left.select("y", url_filter.score(F.col("host"), F.col("path"), url_filter.train(spark, known)).alias("s")).collect()
    blocked = {y: np.mean([r.s >= url_filter.BLOCK_FROM for r in said if r.y == y]) for y in (0, 1)}
    assert len(said) == len(rows) and blocked[1] >= recall and blocked[0] <= false


def test_url_table_is_even_and_shares_no_name_with_the_pages():
    sites = {y: [s for s, _, k in url_filter.labelled_sites() if k == y] for y in (0, 1)}
    assert len(sites[0]) == len(sites[1]) == len(set(sites[0])) == len(set(sites[1])) >= 100
    assert abs(np.mean([len(x) for x in sites[0]]) - np.mean([len(x) for x in sites[1]])) < 1
    for part in ("th", "-", "0"):
        assert abs(sum(part in x for x in sites[0]) - sum(part in x for x in sites[1])) <= 0.05 * len(sites[0]), part
    hosts = {r["url"].split("://")[1].split("/")[0].lower() for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["url"]).to_pylist() if r["url"] and "://" in r["url"]}
    names = {w for h in hosts for w in re.split(r"[.\-]", h)[:-1] if len(w) > 2}
    assert not [x for y in sites for x in sites[y] if set(re.split("-", x)) & names]
    halves = {w for h in hosts if "-" in h for w in re.split(r"[.\-]", h)[:2] if len(w) > 2}  # the pages' unwanted hosts have a hyphen
    assert halves and not [(x, w) for y in sites for x in sites[y] for w in halves if w in x]


def test_url_parts_and_rules_match_sql(spark):
    sql = """
    WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
    parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    rules(said, rule, host, path) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/'))
    SELECT a.page_id, a.host, a.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.said, length(r.rule)) AS said
    FROM parts a LEFT JOIN rules r ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path) GROUP BY 1, 2, 3"""
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    got = queries.op10_url_filter(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, said = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (said is None or r.verdict == said)


def test_url_odd_rows(spark):
    long = "http://" + "a" * 30000 + ".net/" + "b/" * 30000
    df = spark.createDataFrame([(1, long, 1), (1, long, 1), (None, "http://x.org", 1)], "page_id long, url string, score int")
    got = url_filter.judge(df, queries.URL_RULES, url_filter.train(spark)).collect()
    assert [r.rule for r in got] == ["net/", "net/", None] and len(got[0].path) == 60001


PAGES = {
    "<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp; U</h1><p>one  two<p>three<br>four<aside>no</aside></article><footer>&copy;</footer>": "T & U\none two\nthree four",
    "<div class='sidebar'>" + "s " * 200 + "</div><div><h2>Head</h2><p>" + "w " * 100 + "</p></div><div id=comments><p>" + "c " * 300 + "</p></div>": "Head\n" + ("w " * 100).strip(),
    "<script>var a='<article>x</article>'</script><style>p{}</style><!-- <article>y</article> --><article>z<form>f</form></article>": "z",
    "<div class=ad>unclosed <article><p>kept</p></article>": "kept",
    "<p>a < b " + "text " * 30: "a < b " + ("text " * 30).strip(),
    "": "",
    "<p>tiny</p>": "tiny",
    "<a href=x>only a link</a>": "",
}


@pytest.mark.parametrize("n", range(len(PAGES)))
def test_main_text(n):
    page = list(PAGES)[n]
    assert html_main.main_text(page) == PAGES[page]


@pytest.mark.parametrize("tag", ["<b title='A hidden valley'>two</b>", "<a href=\"/hidden-gems\">two</a>", "<a href=/x?class=ad>two</a>", "<p data-id=social data-role='menu'>two</p>", "<img class=social-icon src=x>two", "<img alt='A hidden valley'>two", "<br id=share>two", "<hr class=banner>two", "<input role=search hidden>two"])
def test_main_text_keeps_what_only_looks_unwanted(tag):
    got = html_main.main_text(f"<article><p>one</p><div>{tag}<div>three</div></div><p>four</p></article>")
    assert got.split() == ["one", "two", "three", "four"]


def paragraphs(*texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


TEXT = [("a b c " * 20).strip() + ".", ("d e f " * 25).strip() + ".", ("g h i " * 15).strip() + "."]
MENU, END = ["Home", "News", "Sport", "Culture", "Travel", "Weather", "Shop", "About"], ["Privacy", "Terms", "Contact", "Imprint", "Careers", "\u00a9 2020 Example Ltd. All rights reserved."]
CALLS = ["Log in.", "What's new?", "Join now!", "See plans.", "Ask us!", "Why wait?"]
#: Pages whose menu, text and footer share one element, and pages that name their parts in ways that only look like boilerplate.
WINDOWED = {
    "one div": (f"<div>{paragraphs(*MENU, tag='div')}{paragraphs(*TEXT)}{paragraphs(*END)}</div>", TEXT),
    "all paragraphs": (f"<body>{paragraphs(*MENU, *TEXT, *END)}</body>", TEXT),
    "one article": (f"<article>{paragraphs(*MENU)}{paragraphs(*TEXT)}{paragraphs(*END)}</article>", TEXT),
    "title under a menu": (f"<div>{paragraphs(*MENU)}<h1>My title</h1>{paragraphs('By A. Writer', '3 May')}{paragraphs(*TEXT)}</div>", ["My title", "By A. Writer", "3 May", *TEXT]),
    "short ends": (f"<div>{paragraphs(*MENU)}<p>So it began.</p>{paragraphs(*TEXT)}{paragraphs('It ended.', 'Really!', *END)}</div>", ["So it began.", *TEXT, "It ended.", "Really!"]),
    "calls before": (f"<div>{paragraphs(*CALLS, *TEXT)}</div>", TEXT),
    "calls after": (f"<div>{paragraphs(*TEXT, *CALLS)}</div>", TEXT),
    "calls around": (f"<article><div>{paragraphs(*CALLS)}</div>{paragraphs(*TEXT)}<div>{paragraphs(*CALLS)}</div></article>", TEXT),
    "links within": (f"<div>{paragraphs(TEXT[0])}{paragraphs(*[f'<a href=x>{m}</a>' for m in MENU])}{paragraphs('<a href=y>one link</a>', TEXT[1])}</div>", [TEXT[0], TEXT[1]]),
    "one link between": (f"<div>{paragraphs(TEXT[0], '<a href=y>one link</a>', TEXT[1])}</div>", [TEXT[0], "one link", TEXT[1]]),
    "article header": (f"<article><div class='article-header'><h1>My title</h1></div>{paragraphs(*TEXT)}</article>", ["My title", *TEXT]),
    "header of a post": (f"<div class='post'><header><h1>My title</h1></header>{paragraphs(*TEXT)}</div>", ["My title", *TEXT]),
    "header of the page": (f"<body><header><p>Example daily news.</p></header>{paragraphs(*TEXT)}</body>", TEXT),
    "sections": (f"<p>{TEXT[0]}</p><section class='related-work'><p>{TEXT[1]}</p></section><section id='search-algorithms'><p>{TEXT[2]}</p></section>", TEXT),
    "named parts": (f"<div class='ad-slot_300x250'>{paragraphs(TEXT[1])}</div><p>{TEXT[0]}</p><div id='comment-list'>{paragraphs(TEXT[2])}</div><div class='x share-buttons'>{paragraphs(TEXT[2])}</div>", [TEXT[0]]),
    "closing part": (f"<div>{paragraphs(*[TEXT[1]] * 20)}</div><div><p>{TEXT[2]}</p></div>", [TEXT[1]] * 20 + [TEXT[2]]),
    "two articles": (f"<article>{paragraphs(TEXT[0])}</article>{paragraphs('x', 'y')}<article>{paragraphs(TEXT[1])}</article>", [TEXT[0], "x", "y", TEXT[1]]),
    "short lines between": (paragraphs(TEXT[0], *"sssss", TEXT[1]), [TEXT[0], *"sssss", TEXT[1]]),
}


@pytest.mark.parametrize("name", list(WINDOWED))
def test_windows_find_the_text(name):
    page, want = WINDOWED[name]
    assert html_main.main_text(page).split("\n") == want


def test_without_windows_the_text_is_not_found(monkeypatch):
    monkeypatch.setattr(html_main, "surging", lambda weights: weights > 0)
    wrong = [n for n, (page, want) in WINDOWED.items() if html_main.main_text(page).split("\n") != want]
    assert set(wrong) == {"calls before", "calls after", "calls around"}


@pytest.mark.parametrize("page", ["<a " * 340_000, "<div>" * 90_000 + "</p>" * 90_000, '<a ">" ' * 150_000, "<div>" * 60_000 + "<nav>" + "<article></article>" * 25_000, "<body><head>" * 80_000, "<p x='\">" * 110_000])
def test_main_text_takes_linear_time(page):
    began = time.process_time()
    html_main.main_text(page)
    assert time.process_time() - began < 8


class Article(HTMLParser):
    """The article of a test page by the tag, block by block."""

    def __init__(self):
        super().__init__()
        self.blocks, self.open = [[]], False

    def handle_starttag(self, tag, attrs):
        self.open = self.open or tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append([])
        elif tag == "br":
            self.blocks[-1].append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.blocks[-1].append(data)


def test_main_text_of_all_pages_with_and_without_the_mark():
    """Windows alone find the marked article of nearly every page; on the others short sentences in a row at its end are lost."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()
    found = 0
    for r in pages:
        a = Article()
        a.feed(r["html"])
        a.close()
        want = "\n".join(t for b in a.blocks if (t := " ".join("".join(b).split())))
        got = html_main.main_text(r["html"])
        found += got == want
        assert got and want.startswith(got[: len(want)])
        assert html_main.main_text(re.sub(r"<(/?)article\b", r"<\1div", r["html"])) == got
    assert found >= 0.98 * len(pages)


def test_main_text_reads_attributes_after_others():
    page = "<article><p>one</p><div title='a=b' CLASS = \"x share\">two</div><p alt='' hidden>three</p><div data-x=1 aria-hidden=true>four</div></article>"
    assert html_main.main_text(page) == "one"


def test_html_extract_rows(spark):
    page = "<article><p>x</p></article>"
    df = spark.createDataFrame([(1, "u", page, 3), (1, "u", page, 3), (2, None, None, 1), (3, "u", "<b>" * 20000 + "deep", 0)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_main.extract(df).collect())
    assert got == [(1, "x", 1), (1, "x", 1), (2, "", 0), (3, "deep", 4)]
    assert html_main.extract(df.where("false")).count() == 0


def test_packing_keeps_every_token_once(spark):
    t = Tokenizer.from_file(JSON)
    texts = [*TEXTS, "x<|endoftext|>y <s>", "<|endoftext|>", *[("lorem ipsum %d " % i) * (1 + i * 7 % 150) for i in range(150)]]
    want = {}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        for k, (s, n) in enumerate(packing.pieces_of(len(ids) // 4)):
            want[i, k] = (s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]))
    rows = packing.pack_documents(table(spark, texts), JSON, public_tokenizers.PATTERN).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(n for _, n, _ in want.values())
    assert len(sequences) <= 1.1 * total / packing.CAPACITY + 2
    assert packing.pack_documents(table(spark, []), JSON, public_tokenizers.PATTERN).count() == 0


def test_plan_slots_hold_their_pieces():
    rng = np.random.default_rng(1)
    length = np.sort(rng.integers(1, 1024, 20000))
    counts = np.bincount(length, minlength=1025)
    rank = np.arange(len(length)) - np.searchsorted(length, length)
    plan = packing.Plan(counts)
    at = plan.place(length, rank)
    fill = np.bincount(at[at >= 0], weights=length[at >= 0])
    assert fill.max() <= 1024
    _, new = packing.best_fit(np.bincount(length[at < 0], minlength=1025), np.bincount(1024 - fill[fill > 0].astype(int), minlength=1025))
    assert (fill > 0).sum() + new <= 1.02 * length.sum() / 1024


def test_packing_ids_match_the_library_while_the_memo_turns_over():
    rng = random.Random(3)
    parts = ["it's", " '", "'", " ''s", "don't", " 12", "3a", " été", "Ünd", "!!", " ?!", "\n", " \n ", "   ", "\t", " x" * 40, "y" * 70, " " + "z" * 70, "a_b", " _", "€5", "'re", " 're", "漢字", " "]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.5 else " " + "".join(rng.choices("abcdeé", k=5)) for _ in range(60)) for _ in range(400)] + [None, "", " ", "\n\n", "'s"]
    library = Tokenizer.from_file(JSON)
    texts += ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext"]
    t = packing._Tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    t.memo.entries = 50
    got = [x for at in range(0, len(texts), 45) for x in t.ids(texts[at : at + 45])]
    assert got == [np.array(library.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert len(t.memo) < 5000 and t.memo.older
