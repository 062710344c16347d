"""Chat formatting of reply trees with SQL functions only.

Turns form trees by parent links.  Iterative self-joins that double the distance in each round enumerate the turns on every
root-to-leaf path; the paths of a tree are ranked by score and the chosen ones are each rendered as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labcurate.llm.common import cut

# The template's control strings.  A turn is  <s>[INST] role [/INST]text</s>.
TURN, HEADER, END = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"([<\[]/?)(\\*)(s>|INST\])"
_ESCAPED = r"([<\[]/?)\\(\\*)(s>|INST\])"


def escape(text: Column) -> Column:
    """Each control string gets one more backslash after its opening, so that none is left and each step can be undone."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def turns_to_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows by turn as trees that are chains: (tree, node, parent, role, text, score).

    A turn replies to the one before it in (turn, role, text) order, so ties and repeated rows stand one after the other; a null
    turn comes first.  A null conversation id is one conversation of its own.
    """
    w = Window.partitionBy(conv_col).orderBy(F.col(turn_col).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = F.row_number().over(w).cast("long")
    return turns.select(F.col(conv_col).alias("tree"), n.alias("node"), "role", "text").select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the turns on each path from a root to a leaf, up = steps from the leaf.

    A node without a parent, or whose parent does not exist, is a root.  Rounds double the reach, so a path of length n takes
    log2(n) self-joins.  Nodes on a cycle have no leaf below a root and are left out.
    """
    same = lambda a, b: a.eqNullSafe(b)
    ids = nodes.select("tree", "node").distinct()
    links = nodes.select("tree", "node", "parent").where(F.col("parent").isNotNull()).distinct()
    p = ids.select(F.col("tree").alias("pt"), F.col("node").alias("pn"))
    links = links.join(p, same(links.tree, p.pt) & (links.parent == p.pn), "left_semi")
    is_parent = links.select(F.col("tree").alias("pt"), F.col("parent").alias("pn")).distinct()
    leaves = ids.join(is_parent, same(ids.tree, is_parent.pt) & (ids.node == is_parent.pn), "left_anti")
    found = cut(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    jump = cut(links.select("tree", "node", F.col("parent").alias("far")))  # far: the node ``reach`` steps up
    reach = 1
    while not jump.isEmpty():
        j = jump.select(F.col("tree").alias("jt"), F.col("node").alias("jn"), "far")
        more = found.join(j, same(found.tree, j.jt) & (found.node == j.jn)).select("tree", "leaf", F.col("far").alias("node"), (F.col("up") + reach).alias("up"))
        grown = cut(more)
        if grown.isEmpty():
            break
        found = found.unionByName(grown)
        k = jump.select(F.col("tree").alias("jt"), F.col("node").alias("jn"), F.col("far").alias("further"))
        jump = cut(jump.join(k, same(jump.tree, k.jt) & (jump.far == k.jn)).select("tree", "node", F.col("further").alias("far")))
        reach *= 2
    return found


def format_trees(nodes: DataFrame, best: int = 1) -> DataFrame:
    """Render the ``best`` branches of each tree, highest mean score first, ties to the smaller leaf.

    nodes: tree, node (unique in its tree), parent, role, text, score; other columns are not read.  Returns tree, leaf, branch
    (rank from 1), formatted, n_turns and loss_spans array<struct<start,length>>: the code points of ``formatted`` under the loss
    mask, one span for each assistant text, in order (length counts the escaped text).  Null role, text and score count as empty
    and 0; an empty table gives no rows.
    """
    nodes = cut(nodes.select("tree", "node", "parent", "role", "text", "score"))
    on_path = paths(nodes)
    body = nodes.select(F.col("tree").alias("bt"), F.col("node").alias("bn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = on_path.join(body, on_path.tree.eqNullSafe(body.bt) & (on_path.node == body.bn))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(HEADER))
    rows = rows.select("tree", "leaf", "up", "role", "score", head.alias("head"), escape(F.col("text")).alias("body"))
    down = Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc())
    rows = rows.withColumn("whole", F.length("head") + F.length("body") + len(END))
    rows = rows.withColumn("start", F.sum("whole").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    span = F.when(F.col("role") == "assistant", F.struct((F.coalesce("start", F.lit(0)) + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    turn = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span"))
    whole = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("t"), F.avg("score").alias("mean"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("mean").desc(), "leaf"))
    whole = whole.withColumn("branch", rank).where(F.col("branch") <= best)
    return whole.select("tree", "leaf", "branch", F.concat_ws("", F.transform("t", lambda x: x.turn)).alias("formatted"), F.size("t").cast("long").alias("n_turns"), F.filter(F.transform("t", lambda x: x.span), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role,text>>, unescaped."""
    pieces = F.filter(F.split(formatted, END), lambda x: x != "")

    def turn(x: Column) -> Column:
        rest = x.substr(F.lit(len(TURN) + 1), F.length(x))
        at = F.instr(rest, HEADER)
        return F.struct(unescape(rest.substr(F.lit(1), at - 1)).alias("role"), unescape(rest.substr(at + len(HEADER), F.length(rest))).alias("text"))

    return F.transform(pieces, turn)


def digests(chats: DataFrame) -> DataFrame:
    """Read every conversation back from its formatted text and loss mask: conv_id, n_turns, digests and lengths."""
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s.start + 1).cast("int"), s.length.cast("int")))))
    df = chats.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss)
    return df.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
