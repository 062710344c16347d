"""URL filter: host rules first, then logistic regression on hashed character n-grams of host and path.

Training and scoring use SQL functions only.  The labelled table has at most LABELLED rows; its Gram matrix lives in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labelled table, of invented sites: words of common kinds of sites, each beside words that stand with both labels
# alike and say nothing.  Endings, prefixes and plain paths are dealt out alike too, and every other URL has a path of its own label.
BLOCKED_WORDS = (
    # games of chance; sex; medicines
    "slots poker jackpot lotto roulette bingo porn xxx escort camgirls nudes erotic viagra cialis steroids botox "
    # money; phishing and harmful software; imitations
    "payday bitcoins forex quickcash login-verify wallet-alert malware warez keygen torrents replica knockoff "
    # advertising, counting and links for sale; enticements
    "popup banner clickthru beacon backlinks followers prizes giveaway"
).split()
ALLOWED_WORDS = (
    # offices and schools; learning
    "library council archive college academy museum physics botany history grammar geology textbook "
    # news and letters; software and crafts
    "gazette herald essays poetry compiler database handbook carpentry knitting recipes "
    # leisure and travel; health, care and belief
    "orchestra chess canoeing timetable alpine-huts theatre hospital dental parish refugee-aid shelter weather elections genealogy"
).split()
BESIDE = ("north", "blue", "river", "city", "royal", "daily", "star", "open", "golden", "first", "green", "central")
SITES_OF_A_WORD = 4
BLOCKED_PATHS = ("/claim/prize", "/signup/bonus", "/out/click", "/xxx/live", "/order/now", "/download/crack.exe")
ALLOWED_PATHS = ("/guide/setup", "/papers/2019", "/wiki/Physics", "/thread/31", "/exhibits/now", "/stories/spring.html")
PLAIN_PATHS = ("/", "/a/7", "/index.html", "/2021/05/", "/page")
PREFIXES, ENDINGS = ("", "www.", "shop.", "my."), ("info", "co", "biz", "eu")


def labelled_sites() -> list[tuple[str, str, int]]:
    """(site, its kind's word, 1 = block): each word with SITES_OF_A_WORD of the words beside, before it or after it."""
    out = []
    for words, y in ((BLOCKED_WORDS, 1), (ALLOWED_WORDS, 0)):
        for i, word in enumerate(words):
            for k in range(SITES_OF_A_WORD):
                other = BESIDE[(i + k * 5) % len(BESIDE)]
                out.append((f"{other}-{word}" if k == 0 else f"{word}-{other}" if k == 1 else f"{other}{word}" if k == 2 else f"{word}{other}", word, y))
    return out


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 = block): two for each site."""
    out = []
    for i, (site, _, y) in enumerate(labelled_sites()):
        own = BLOCKED_PATHS if y else ALLOWED_PATHS
        for k in range(2):
            path = own[i % len(own)] if (i + k) % 2 else PLAIN_PATHS[i % len(PLAIN_PATHS)]
            out.append((f"{PREFIXES[(i + k) % len(PREFIXES)]}{site}.{ENDINGS[(i + 2 * k) % len(ENDINGS)]}", path, y))
    return out


BUCKETS = 1 << 15
SIZES = (3, 4)
#: Most labelled URLs; more are an error, since all of them meet in one row.
LABELLED = 2000
EPOCHS = 400
RATE = 0.06  # below 2 over a quarter of the matrix's greatest eigenvalue, or steps would swing
DECAY = 1e-4
#: Weight of a path's evidence against its host's.
PATH_WEIGHT = 0.3
#: The constant feature beside the n-grams.
BIAS = 0.3
#: Chosen on the table alone: where whole kinds are held out, below one in twenty of the allowed sites reach it.
BLOCK_FROM = 0.75


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII-lower-cased) and path; both empty for null and where there is no ``://``."""
    p = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, p, 1), upper, lower), F.regexp_extract(url, p, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits, null if none does.

    A rule is (verdict, "host/path"); it fits its host and every subdomain where the path starts with the rule's.  Of two rules
    equally long the one first in text order wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last that fits is outermost
        h, slash, rest = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def features(host: Column, path: Column) -> Column:
    """struct<h, p>: distinct bucket numbers of the character n-grams of ``^host|`` and of the path, digits all alike; neither is empty.
    A path's buckets follow the host's."""

    def grams(text: Column, first: int) -> Column:
        bucket = lambda chars, i, n: (F.pmod(F.xxhash64(F.array_join(F.slice(chars, i, n), "")), F.lit(BUCKETS)) + first).cast("int")
        at = lambda chars, n: F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))

        def all_of(chars: Column) -> Column:  # bound once, and each n-gram taken in constant time
            return F.concat(*[F.transform(at(chars, n), (lambda n: lambda i: bucket(chars, i, n))(n)) for n in SIZES])

        characters = F.filter(F.split(F.regexp_replace(text, "[0-9]", "0"), ""), lambda c: c != "")
        return F.array_distinct(F.flatten(F.transform(F.array(characters), all_of)))

    return F.struct(grams(F.concat(F.lit("^"), host, F.lit("|")), 0).alias("h"), grams(path, BUCKETS).alias("p"))


def train(spark: SparkSession, labelled: DataFrame | None = None) -> DataFrame:
    """Weights (bucket int, weight double); bucket -1 is the bias.  labelled: host, path, y; at most LABELLED rows.

    Logistic regression by gradient steps in its dual form: the weight vector is a sum of the rows' feature vectors, so one
    coefficient for each labelled row is learnt from the matrix of inner products.
    """
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "host string, path string, y int")
    rows = labelled.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("y", F.lit(0)).cast("double").alias("y"))
    rows = rows.select("y", features(F.col("host"), F.col("path")).alias("f"))
    if rows.limit(LABELLED + 1).count() > LABELLED:
        raise ValueError(f"more than {LABELLED} labelled URLs")
    all_rows = rows.agg(F.array_sort(F.collect_list(F.struct("y", "f"))).alias("r"))
    part = lambda a, b: F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))
    dot = lambda a, b: part(a.f.h, b.f.h) + PATH_WEIGHT**2 * part(a.f.p, b.f.p) + F.lit(BIAS**2)
    gram = all_rows.select("r", F.transform("r", lambda a: F.struct(a.y.alias("y"), F.transform("r", lambda b: dot(a, b)).alias("k"))).alias("g"))
    inner = lambda c, k: F.aggregate(F.zip_with(c, k, lambda x, z: x * z), F.lit(0.0), lambda s, x: s + x)
    step = lambda c: F.zip_with(c, F.col("g"), lambda x, g: x * (1 - DECAY) + RATE * (g.y - 1 / (1 + F.exp(-inner(c, g.k)))))
    start = F.transform("g", lambda _: F.lit(0.0))
    learnt = gram.select("r", F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), start, lambda c, _: step(c)).alias("c"))
    each = learnt.select(F.inline(F.zip_with("r", "c", lambda r, c: F.struct(r.f.alias("f"), c.alias("c")))))
    share = lambda f, weight: F.transform(f, lambda b: F.struct(b.alias("bucket"), (F.col("c") * weight / F.sqrt(F.size(f).cast("double"))).alias("x")))
    bias = F.array(F.struct(F.lit(-1).alias("bucket"), (F.col("c") * BIAS).alias("x")))
    return each.select(F.inline(F.concat(share(F.col("f.h"), 1.0), share(F.col("f.p"), PATH_WEIGHT), bias))).groupBy("bucket").agg(F.sum("x").alias("weight"))


def score(host: Column, path: Column, weights: DataFrame) -> Column:
    """Probability of block.  The weights go into the plan as one constant array of 2 * BUCKETS numbers."""
    w = {r.bucket: r.weight for r in weights.collect()}  # at most 2 * BUCKETS + 1 rows
    table = F.split(F.lit(",".join(f"{w.get(i, 0):.9g}" for i in range(2 * BUCKETS))), ",").cast("array<double>")
    f = features(host, path)
    part = lambda x: F.aggregate(x, F.lit(0.0), lambda s, i: s + F.get(table, i)) / F.sqrt(F.size(x).cast("double"))
    return 1 / (1 + F.exp(-(part(f["h"]) + PATH_WEIGHT * part(f["p"]) + F.lit(BIAS * w.get(-1, 0.0)))))


def judge(pages: DataFrame, rules: list[tuple[str, str]], weights: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, score.  Row-wise, no shuffle.

    The rule's verdict holds where a rule fits; elsewhere ``block`` where the model's probability is BLOCK_FROM or more.  A null
    url, or one without ``://``, has empty host and path and is judged by the model like any other.  Repeated rows come
    out as often as they went in; an empty table gives none; other columns are not read.
    """
    host, path = parts(F.col(url_col))
    df = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select(id_col, "host", "path", rule.alias("rule"), said.alias("said"), score(F.col("host"), F.col("path"), weights).alias("score"))
    return df.select(id_col, "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
