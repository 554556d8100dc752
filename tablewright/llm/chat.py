"""Chat formatting: reply trees to conversations in one template, and back.

A table of messages (tree, node, parent, role, text, score) is turned into root-to-leaf paths by
iterative self-joins, the branches of each tree are ranked by score, and each chosen path is written
as one conversation::

    <|turn|>role<|text|>text<|end|>...

Control strings that occur inside a role or a text get one backslash after their first character; one
that has backslashes there already gets one more, so that reading back removes exactly one.

Defined cases: null role, text and score count as empty, empty and 0; messages without a tree or node
are left out. A message whose parent is null
or unknown is a root. Repeated node ids within a tree are merged to the row that sorts first by
(parent, role, text). Messages on a cycle have no root and are in no path. Ties between branches go to
the smaller leaf. Extra columns are ignored. A conversation is one string, so one path must fit into
a row; everything before that is spread by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import drop_stage, stage

#: Markers of the template, and the control strings of other common templates that texts may not hold.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|/?s>|</?SYS>>|/?INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"
_ESCAPED = CONTROL.replace(r"(\\*)", r"(\\*)\\")
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """One more backslash after the first character of every control string, overlaps included."""
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def linear_replies(turns: DataFrame, conv: str, order: list[str], role: str, text: str) -> DataFrame:
    """Messages of plain conversations as reply trees: each row answers the row before it."""
    rows = turns.withColumn("node", F.row_number().over(Window.partitionBy(conv).orderBy(*order)).cast("long"))
    return rows.select(
        F.col(conv).alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
        F.lit(0.0).alias("score"),
    )


def _links(messages: DataFrame) -> DataFrame:
    """One row per node with a parent that exists, else null."""
    nodes = messages.groupBy("tree", "node").agg(
        F.min(F.struct(F.col("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")
    ).select("tree", "node", "m.*")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "role", "text", "score"
    )


def paths(messages: DataFrame) -> DataFrame:
    """Rows (tree, leaf, node, back, total): every message of every root-to-leaf path.

    ``back`` counts the steps from the leaf and ``total`` sums the scores of the path. Self-joins
    double the reach: after k joins the table of jumps leads 2^k replies back. Each leaf then takes
    the jumps from the longest to the shortest, which reaches each of its ancestors exactly once, so
    the rows made are those returned and the number of joins is logarithmic in the depth.
    """
    spark = messages.sparkSession
    nodes = messages.select("tree", "node", "parent", "score")
    jumps = [stage(nodes.filter("parent is not null").select("tree", "node", F.col("parent").alias("up")), "chat-jump")]
    while not jumps[-1].isEmpty():
        step = jumps[-1]
        further = step.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        jumps.append(stage(step.join(further, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "chat-jump"))
        if len(jumps) > 40:
            raise ValueError("a reply cycle: split off nodes without a root first")
    answered = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = nodes.join(answered, ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")
    )
    reached = stage(leaves, "chat-path")
    for k in range(len(jumps) - 2, -1, -1):
        more = reached.join(jumps[k], ["tree", "node"]).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back")
        )
        reached = stage(reached.unionByName(more), "chat-path")
    for jump in jumps:
        drop_stage(spark, jump)
    scored = reached.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    total = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
    return reached.join(total, ["tree", "leaf"])


def rooted(messages: DataFrame) -> DataFrame:
    """Messages that have a root: those on or below a reply cycle never reach one and are left out.

    Halving by pointer jumping: every node points at itself or its parent, then at what that points
    at. Depth n needs log2(n) joins; a node whose pointer is no root after the longest possible
    path is on a cycle.
    """
    roots = messages.filter("parent is null").select("tree", F.col("node").alias("up"), F.lit(True).alias("root"))
    point = messages.select("tree", "node", F.coalesce("parent", "node").alias("up"))
    size = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(size).bit_length()):
        above = point.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        point = stage(point.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "chat-root")
    good = point.join(roots, ["tree", "up"]).select("tree", "node")
    return messages.join(good, ["tree", "node"], "left_semi")


def format_paths(messages: DataFrame, branches: int | None = 1, acyclic: bool = False) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, formatted, mask.

    ``branches`` is the number of best-scored paths per tree (None: all). ``mask`` lists the (start,
    length) spans of assistant texts in characters of ``formatted``, counted from 1. Set ``acyclic``
    where the input is known to have no reply cycles; that saves their search.
    """
    nodes = stage(_links(messages), "chat-nodes")
    if not acyclic:
        nodes = stage(rooted(nodes), "chat-rooted")
    steps = paths(nodes)
    leaves = steps.filter("back = 0").select("tree", "leaf", "total")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    chosen = leaves.withColumn("rank", rank)
    if branches is not None:
        chosen = chosen.filter(F.col("rank") <= branches)
    rows = steps.drop("total").join(chosen.drop("total"), ["tree", "leaf"]).join(
        nodes.select("tree", "node", "role", "text"), ["tree", "node"]
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    turn = F.struct(
        (-F.col("back")).alias("place"), head.alias("head"), body.alias("body"), (F.col("role") == ASSISTANT).alias("learn")
    )
    turns = F.sort_array(F.collect_list(turn))
    grouped = rows.groupBy("tree", "leaf", "rank").agg(turns.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc.at + F.length(t.head) + F.length(t.body) + F.length(F.lit(END))).alias("at"),
            F.when(t.learn, F.concat(acc.spans, F.array(F.struct((acc.at + F.length(t.head)).alias("start"), F.length(t.body).alias("length")))))
            .otherwise(acc.spans)
            .alias("spans"),
        ),
        lambda acc: acc.spans,
    )
    return grouped.select("tree", "leaf", "rank", text.alias("formatted"), spans.alias("mask"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)\A(.*?)<\|text\|>", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)\A.*?<\|text\|>(.*)<\|end\|>\z", 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s.start, s.length))), "")
