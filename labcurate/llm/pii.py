"""Personal data in texts, with SQL functions only: fixed patterns, and identifiers that bootstrapped contexts discover.

Matches of the fixed patterns are the seeds.  The words around them are lexical patterns; a graph joins each pattern to the identifiers
that stand in it anywhere.  Pattern and identifier scores are passed to and fro along its edges, and where a pattern of high
confidence holds an identifier that no fixed pattern knows, that is personal data of the pattern's kind too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labcurate.llm.common import cut, discard, join_unique

#: Kinds in their order in results.  Each expression finds the same matches as the plain one beside it, in time linear in the text: runs
#: are taken whole, and a match begins where a run does or where the last match ended.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
EXPRESSIONS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "card": r"[0-9](?:[\x20-]?[0-9])++",  # [0-9]([\x20-]?[0-9])+
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
_IP = rf"\A{_PART}(?:\.{_PART}){{3}}\z"
#: What may be an identifier: digits in groups, or a run of letters, digits and marks with a digit or an @ in it.
IDENTIFIER = r"(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[\x20().-]{0,3}[0-9])++(?![A-Za-z@])|(?<![A-Za-z0-9._%+@/-])[A-Za-z._%+/-]*+[0-9@][A-Za-z0-9._%+@/-]*+"
MARKS = "._%+@/-"
LEAST_DIGITS = 5  # in an identifier without an @
CONTEXT = 48  # characters beside an identifier that are read for words
#: Rounds of scoring; distinct supporting identifiers and confidence from which a pattern counts; its identifiers beside the supporting
#: ones that are assumed unseen.
ROUNDS, LEAST_SUPPORT, CONFIDENT, UNSEEN = 3, 4, 0.6, 0.5
_BLOCK = 128


def running(lengths: Column) -> Column:
    """Sums of an array up to each element, the element included.  Blocks keep the time near linear."""
    zero = F.lit(0).cast("long")
    add = lambda block, first: F.aggregate(block, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def sums(blocks: Column) -> Column:
        before = add(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero)
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, first: F.slice(add(b, first), 2, F.size(b))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda k: F.slice(lengths, k * _BLOCK + 1, _BLOCK))
    return F.when(F.size(lengths) > 0, sums(blocks)).otherwise(F.array().cast("array<bigint>"))


def _split(text: Column, pattern: str, when: Column) -> Column:
    """struct<gaps, hits>: what stands between the matches, one more than these, and the matches."""
    none = F.struct(F.array(F.lit("")).alias("gaps"), F.array().cast("array<string>").alias("hits"))
    return F.when(when, F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))).otherwise(none)


def _ends(found: Column) -> Column:
    """Code points up to the end of each match."""
    both = F.zip_with(found["hits"], F.slice(found["gaps"], 1, F.size(found["hits"])), lambda h, g: (F.length(h) + F.length(g)).cast("long"))
    return F.flatten(F.transform(F.array(both), running))  # bound once


def _digits(hit: Column) -> Column:
    return F.translate(hit, "+-(). ", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    digits = _digits(hit)
    if kind == "ip":
        return hit.rlike(_IP)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def kind_of(text: Column) -> Column:
    """Number of the first kind that ``text`` as a whole is of, else null."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        out = F.when(text.rlike(rf"\A(?:{EXPRESSIONS[KINDS[k]]})\z") & valid(KINDS[k], text), F.lit(k)).otherwise(out)
    return out


def contexts(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: the two words before it, and the words on both sides.  Lower case, digits alike; none where no
    letter stands before."""
    words = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), r"[0-9]+", "0"), r"[\s\p{Z}]+"), lambda w: w != "")
    left, right = words(F.right(before, F.lit(CONTEXT))), words(F.left(after, F.lit(CONTEXT)))
    last = F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit(""))
    both = F.array(F.concat(F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit("")), F.lit(" "), last, F.lit(" _")), F.concat(last, F.lit(" _ "), F.coalesce(F.try_element_at(right, F.lit(1)), F.lit(""))))
    return F.when(last.rlike(r"\p{L}"), both).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, base array<struct<kind,start,end>>, others array<struct<start,end,name,kind,contexts>>) for each document, written.

    base: matches of the fixed patterns; others: identifiers with their contexts, kind null where none fits.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.withColumn("digits", text.rlike("[0-9]"))
    gates = {"email": text.contains("@"), "ip": F.col("digits"), "card": F.col("digits"), "phone": F.col("digits") & text.contains("+")}
    rows = rows.select("row", "id", *[_split(text, EXPRESSIONS[k], gates[k]).alias(k) for k in KINDS], _split(text, IDENTIFIER, F.col("digits") | gates["email"]).alias("other"))
    rows = rows.select("*", *[_ends(F.col(k)).alias(f"{k}_ends") for k in (*KINDS, "other")])

    def matches(number: int, kind: str) -> Column:
        spans = F.zip_with(F.col(kind)["hits"], F.col(f"{kind}_ends"), lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))
        return F.transform(F.filter(spans, lambda s: valid(kind, s.hit)), lambda s: F.struct(F.lit(number).alias("kind"), s.start.alias("start"), s.end.alias("end")))

    base = [matches(i, k) for i, k in enumerate(KINDS)]
    o = F.col("other")

    def identifier(hit: Column, i: Column) -> Column:
        left = F.length(hit) - F.length(F.ltrim(hit, F.lit(MARKS.replace("+", ""))))
        name = F.rtrim(F.ltrim(hit, F.lit(MARKS.replace("+", ""))), F.lit(MARKS))
        start = F.get(F.col("other_ends"), i) - F.length(hit) + left
        return F.struct(start.alias("start"), (start + F.length(name)).alias("end"), name.alias("name"), F.get(o["gaps"], i).alias("before"), F.get(o["gaps"], i + 1).alias("after"))

    digits = lambda n: F.length(F.regexp_replace(n, "[^0-9]+", ""))
    some = F.filter(F.transform(o["hits"], identifier), lambda x: (digits(x["name"]) >= LEAST_DIGITS) | x["name"].rlike("[A-Za-z0-9]@[A-Za-z0-9]"))
    some = F.transform(some, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), F.lower(x["name"]).alias("name"), kind_of(x["name"]).alias("kind"), contexts(x.before, x.after).alias("contexts")))
    return cut(rows.select("row", "id", F.concat(*base).alias("base"), some.alias("others")))


def learn(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Confident patterns, written: (pattern, kind, confidence), one kind for each.

    edges: distinct (pattern, name, kind), kind null for identifiers of no fixed kind; a name has one kind.  A pattern's confidence in
    a kind is the sum of its identifiers' scores over their number and UNSEEN; an unknown identifier's score is the chance
    that not all of its confident patterns err.
    """
    edges = cut(edges)
    names = edges.groupBy("name").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
    names = cut(names)
    sizes = cut(edges.groupBy("pattern").agg(F.count("*").alias("size")))
    scores = cut(names.where(F.col("kind").isNotNull()).select("name", "kind", F.lit(1.0).alias("score"), "n"))
    unknown = cut(edges.where(F.col("kind").isNull()).select("pattern", "name"))
    held = cut(unknown.groupBy("pattern").agg(F.count("*").alias("n")))
    counts = names.where(F.col("kind").isNull()).select("name", "n")
    for k in range(rounds + 1):
        sums = join_unique(edges.select("pattern", "name"), scores, "name", "n").groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.count("*").alias("support"))
        good = sums.where(F.col("support") >= LEAST_SUPPORT).join(sizes, "pattern").select("pattern", "kind", (F.col("total") / (F.col("size") + UNSEEN)).alias("confidence"))
        best = good.where(F.col("confidence") >= CONFIDENT).groupBy("pattern").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
        found = cut(best.select("pattern", (-F.col("b.k")).alias("kind"), F.col("b.confidence").alias("confidence")))
        if k == rounds:
            discard(edges, sizes, unknown, held, names, scores)
            return found
        # A pattern that seeds alone have is of no use to others: it meets no unknown identifier.
        met = join_unique(unknown, found.join(held, "pattern"), "pattern", "n").select("name", "kind", "confidence")
        miss = met.groupBy("name", "kind").agg(F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))).alias("miss"))
        new = miss.groupBy("name").agg(F.min(F.struct("miss", "kind")).alias("m")).select("name", F.col("m.kind").alias("kind"), (1 - F.col("m.miss")).alias("score"))
        old, scores = scores, cut(names.where(F.col("kind").isNotNull()).select("name", "kind", F.lit(1.0).alias("score"), "n").unionByName(new.join(counts, "name").select("name", "kind", "score", "n")))
        discard(old, found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, base and spans, both array<struct<kind int,start,end>> by kind and start.

    kind is a number in KINDS; offsets are code points, the end exclusive.  ``spans`` holds ``base`` and what the method adds: identifiers
    that overlap no base span, in a confident pattern's place.  Texts are scanned once and do not move.  A null text counts as
    empty; repeated rows come out as often as they went in, and count once as evidence; a null id is kept; an empty table gives
    none; other columns are not read.
    """
    rows = scan(docs, id_col, text_col)
    places = rows.select("row", "base", F.explode("others").alias("o")).select("row", "base", "o.*")
    edges = places.select(F.explode("contexts").alias("pattern"), "name", "kind").distinct()
    patterns = learn(edges)
    free = places.where(F.col("kind").isNull() & ~F.exists("base", lambda b: (b.start < F.col("end")) & (F.col("start") < b.end)))
    free = cut(free.select("row", "start", "end", F.explode("contexts").alias("pattern")))
    wanted = free.groupBy("pattern").agg(F.count("*").alias("n")).join(patterns, "pattern")
    hits = join_unique(free, cut(wanted), "pattern", "n")
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    span = F.struct((-F.col("b.k")).alias("kind"), "start", "end")
    added = best.groupBy("row").agg(F.collect_list(span).alias("added"))  # of one document
    out = rows.select("row", "id", "base").join(added, "row", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return out.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s.start.cast("string"), s.end.cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, their digest and the list of all spans."""

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == number)).cast("long")

    return found.select(id_col, *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
