"""Trie of conversation prefixes by preorder-interval encoding.

Every distinct prefix is a node.  Nodes are ranked lexicographically: blocks of turns are named in the order of what they hold, and
pairs of names give the names of blocks twice as long, until one block spans the longest conversation.  A name is then a node's place
in preorder, and the largest name below it closes its interval; leaves and savings of a subtree are differences of prefix sums.
No step holds a whole conversation, or all members of a node, in one row or one task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labcurate.llm.common import cut, discard, join_unique

#: Turns in the blocks that are named first.
BLOCK = 8
#: Nodes between two entries of the table of sums.
CHUNK = 1 << 16
#: Ids that are joined to one text before a node's digest reads them in turn.
IDS = 512
# A conversation takes its first turns, at most LEAD - 1, from the one at the last multiple of FAMILY.
FAMILY, LEAD = 100, 6
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(df: DataFrame, keys: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` with column ``place``: 1 for the first row in the order of ``keys``, and so on without gaps; and the table written for it.

    Rows are dealt by ranges of the keys and counted where they are; the driver sees none.  Equal rows fall into one range, so
    ``keys`` should tell rows apart.
    """
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row for each range
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + within + 1).drop("__at", "__part", "__n", "__before"), rows


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns with the lead they share, as (conv, depth, item, chars, length), and all conversations as (conv, length).

    Conversation c has the first h turns of c - c % FAMILY (remainder with the sign of c), then its own after its first h, with
    h = crc32 of its decimal modulo LEAD.  ``item`` is a 128-bit digest of role and text, null as empty; turns come by number, null first,
    equal numbers by item.  Rows without a conversation id are in no conversation.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    item = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    own = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), item.alias("item"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    own = cut(own)
    placed, written = numbered(own, ["conv", F.col("turn").asc_nulls_first(), "item", "row"])
    c = F.col("conv")
    convs = placed.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("n")).withColumn("h", F.crc32(c.cast("string").cast("binary")) % LEAD).withColumn("base", c - c % FAMILY)
    convs = cut(convs)
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    lead = F.least("h", F.coalesce("there", F.lit(0)))
    whole = cut(convs.join(bases, "base", "left").select("conv", "first", "n", "h", "base", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    mine = join_unique(placed, whole, "conv", "n").withColumn("p", F.col("place") - F.col("first") + 1)
    rest = mine.where(F.col("p") > F.col("h")).select("conv", (F.col("p") - F.col("h") + F.col("lead")).alias("depth"), "item", "chars", "length")
    given = mine.where((F.col("conv") % FAMILY == 0) & (F.col("p") < LEAD)).select(F.col("conv").alias("base"), "p", "item", "chars")
    start = whole.where("lead > 0").select("conv", "base", "lead", "length").join(given, "base").where(F.col("p") <= F.col("lead")).select("conv", F.col("p").alias("depth"), "item", "chars", "length")
    rows = cut(rest.unionByName(start))
    discard(own, written, convs)
    return rows, whole.select("conv", "length")


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, written, with ``name`` instead of ``keys``: the place of their keys among all that occur."""
    names, written = numbered(rows.groupBy(*keys).agg(F.count("*").alias("__rows")), keys)
    out = cut(join_unique(rows, names.withColumnRenamed("place", "name"), keys, "__rows").drop("__rows", *keys))
    discard(written)
    return out


def _doubled(found: DataFrame, longest: int) -> DataFrame:
    """(conv, depth, length, name) of (conv, depth, length, name of the turn's stretch of its block): names of whole stretches from depth 1.

    Every round doubles the blocks: a turn in the second half of one is named by the first half's last name and its own.
    """
    size = BLOCK
    while size < longest:
        place = (F.col("depth") - 1) % (2 * size)
        ends = found.where((F.col("depth") % (2 * size) == size) & (F.col("length") > F.col("depth")))
        ends = ends.select("conv", F.col("depth").alias("at"), F.col("name").alias("a"), F.least(F.col("length") - F.col("depth"), F.lit(size)).alias("__n"))
        second = found.where(place >= size).withColumn("at", F.col("depth") - 1 - place + size)
        second = join_unique(second, ends, ["conv", "at"], "__n").select("conv", "depth", "length", "a", F.col("name").alias("b"))
        first = found.where(place < size).select("conv", "depth", "length", F.col("name").alias("a"), F.lit(0).cast("long").alias("b"))
        old, found = found, _named(first.unionByName(second), ["a", "b"])
        discard(old)
        size *= 2
    return found


def ranked(rows: DataFrame) -> DataFrame:
    """(conv, depth, chars, length, name): ``name`` is the same for equal prefixes and follows their lexicographic order, from 1.

    A prefix within the first block is named by what it holds.  What follows that block is named apart, so that only long conversations
    take the rounds that double, and is then put behind the name of the block.
    """
    block = F.floor((F.col("depth") - 1) / BLOCK)
    parts = rows.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("depth", "item", "chars", "length"))).alias("r"))  # at most BLOCK
    joined = lambda i: F.aggregate(F.slice("r", 1, i + 1), F.lit(b""), lambda a, x: F.concat(a, x["item"]))
    each = F.transform("r", lambda x, i: F.struct(x.depth.alias("depth"), x.chars.alias("chars"), x.length.alias("length"), joined(i).alias("key")))
    keyed = parts.select("conv", "block", F.inline(each))
    longest = rows.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    head = _named(keyed.where(F.col("block") == 0).select("conv", "depth", "chars", "length", "key"), ["key"])
    if longest <= BLOCK:
        return head
    rest = keyed.where(F.col("block") > 0).select("conv", (F.col("depth") - BLOCK).alias("depth"), (F.col("length") - BLOCK).alias("length"), "key")
    tail = _doubled(_named(rest, ["key"]), longest - BLOCK).select("conv", (F.col("depth") + BLOCK).alias("depth"), F.col("name").alias("b"))
    whole = head.where((F.col("depth") == BLOCK) & (F.col("length") > BLOCK)).select("conv", F.col("name").alias("a"), (F.col("length") - BLOCK).alias("__n"))
    tail = join_unique(tail, whole, "conv", "__n").drop("__n").join(rows.select("conv", "depth", "chars", "length"), ["conv", "depth"])
    pairs = head.select("conv", "depth", "chars", "length", F.col("name").alias("a"), F.lit(0).cast("long").alias("b"))
    return _named(pairs.unionByName(tail), ["a", "b"])


def _digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv): the digest of a node's ids, ascending and comma-joined.

    A digest reads its input in order, so a node is read by one task, but from texts of IDS ids that many tasks have sorted and
    joined, one batch at a time.
    """

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": pa.array([name], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))], pa.string())})

        for batch in batches:
            for n, c in zip(batch.column("name").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if n != name or len(ids) == IDS:
                    if ids:
                        yield piece()
                    name, ids = n, []
                ids.append(c)
        if ids:
            yield piece()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": pa.array([name], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

        for batch in batches:
            for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n == name:
                    state.update(b",")
                else:
                    if state:
                        yield row()
                    name, state = n, hashlib.sha256()
                state.update(ids.encode())
        if state:
            yield row()

    pieces = ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(join, "name long, first long, ids string")
    return pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digest, "name long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations, the empty one included.

    rows: conv, depth (from 1, gapless), item (equal for equal turns), chars, length (turns of the conversation); convs: every
    conversation once, with its length, 0 too.  Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; no conversations give no rows.
    """
    found = ranked(rows)
    last = found.where(F.col("depth") == F.col("length")).select("conv", F.col("name").alias("last"), F.col("length").alias("__n"))
    reach = join_unique(found, last, "conv", "__n")  # the largest name below a node is the last of some member
    nodes = reach.groupBy("name").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.max("chars").alias("chars"), F.count("*").alias("n_convs"), F.max("last").alias("end"))
    above = found.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = cut(nodes).join(above, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(0)))
    zero = F.lit(0).cast("long")
    every = convs.select("conv", zero.alias("last")).unionByName(last.select(F.lit(None).cast("long").alias("conv"), "last"))
    root = every.agg(F.min("conv").alias("conv_id"), F.count("conv").alias("n_convs"), F.max("last").alias("end")).where(F.col("conv_id").isNotNull())
    root = root.select("conv_id", zero.alias("depth"), zero.alias("name"), zero.alias("chars"), "n_convs", "end", F.lit(None).cast("long").alias("parent"))
    nodes = nodes.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).withColumn("leaf", (F.col("end") == F.col("name")).cast("long"))
    nodes = cut(nodes)
    children = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("n_children"))
    parents = cut(children.join(nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent"))
    below = join_unique(nodes.where(F.col("parent").isNotNull()), parents, "parent", "n_children").select("name", "parent_conv_id")
    sums = _sums(nodes)
    shared = cut(nodes.groupBy("end").agg(F.count("*").alias("__n")).join(sums.select(F.col("name").alias("end"), F.col("leaves").alias("leaves_to"), F.col("saved_sum").alias("saved_to")), "end"))
    spans = join_unique(nodes.select("name", "end", "leaf", "saved"), shared, "end", "__n").join(sums, "name")
    spans = spans.select("name", (F.col("leaves_to") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_to") - F.col("saved_sum") + F.col("saved")).alias("saved_tokens"))
    body = nodes.select("name", "conv_id", "depth", "n_convs").join(below, "name", "left").join(parents.select(F.col("parent").alias("name"), "n_children"), "name", "left").join(spans, "name")
    none = convs.where(F.col("length") == 0).select(zero.alias("name"), "conv")
    ends = _digests(last.select(F.col("last").alias("name"), "conv").unionByName(none))
    out = body.join(ends, "name", "left")
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs"]
    return out.select(*numbers, F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))


def _sums(nodes: DataFrame) -> DataFrame:
    """(name, leaves, saved_sum): sums over all nodes up to this one.  Names have no gaps, so chunks of them are equally large."""
    chunk = F.floor(F.col("name") / CHUNK)
    rows = nodes.select("name", "leaf", "saved", chunk.alias("chunk"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row for each CHUNK nodes
    totals = rows.groupBy("chunk").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    totals = totals.select("chunk", F.coalesce(F.sum("l").over(earlier), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s"))
    here = Window.partitionBy("chunk").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    return cut(rows.select("name", "chunk", F.sum("leaf").over(here).alias("a"), F.sum("saved").over(here).alias("b")).join(totals, "chunk").select("name", (F.col("a") + F.col("l")).alias("leaves"), (F.col("b") + F.col("s")).alias("saved_sum")))
