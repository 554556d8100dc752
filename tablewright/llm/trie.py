"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns; it is named by its depth and two 64-bit sums (xor) of
hashes that each cover a turn and its place, so that texts are hashed once and never travel again.

1. every conversation gives one row per turn: its node, and through the turn's own hash the parent;
2. the weight of a node is the number of turns from it on, over all members. Its level is the logarithm
   of the weight, so levels never rise from parent to child. A shard is a node with the descendants that
   share its level; it holds at most ``SHARD_ROWS`` nodes of each depth, however frequent a first turn is;
3. equal nodes become one row (summed before the shuffle), with the root of their shard;
4. levels are handled from the lowest on. Spark sorts the nodes of each shard by depth, deepest first;
   a task reads them once and passes the totals of each subtree forward to its parent through a priority
   queue that spills. The roots of shards pass their totals on to the next level, until the trie's root;
5. the ids that end at a node are hashed in one sorted stream over ranges that cut through nodes.

Time follows the longest conversation only where one conversation is longer than a shard; memory never.

Defined cases: null roles and texts count as empty; turns are ordered as given, ties by role and text,
and repeated rows are turns of their own; rows without a conversation are in none. A conversation
without turns is a member of the root, which alone has depth 0. Extra columns are ignored. An empty table
has no nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.columns import column
from tablewright.llm.common import drop_stage, stage

#: Nodes of one depth in a shard, and messages that a queue holds in memory.
SHARD_ROWS = 1_000
QUEUE_ENTRIES = 50_000
#: Ids in a piece of a node at which many conversations end.
PIECE_IDS = 10_000

Message = tuple[int, int, int, int, int]


class SpillingQueue:
    """Priority queue of messages (minus depth, two node numbers, leaves, saved) that spills sorted runs.

    Runs are files of the task without a name, in the folder that Spark spills to.
    """

    _entry = struct.Struct("<5q")

    def __init__(self, entries: int | None = None) -> None:
        self.limit = entries or QUEUE_ENTRIES
        self.memory: list[Message] = []
        self.heads: list[tuple[Message, int]] = []
        self.runs: list[Iterator[Message]] = []

    def __len__(self) -> int:
        return len(self.memory) + len(self.heads)

    def _read(self, file) -> Iterator[Message]:
        with file:
            while data := file.read(self._entry.size * 1024):
                yield from self._entry.iter_unpack(data)

    def push(self, message: Message) -> None:
        heapq.heappush(self.memory, message)
        if len(self.memory) > self.limit:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            file = tempfile.TemporaryFile(dir=folder)
            for entry in sorted(self.memory):
                file.write(self._entry.pack(*entry))
            file.seek(0)
            self.memory = []
            self.runs.append(self._read(file))
            heapq.heappush(self.heads, (next(self.runs[-1]), len(self.runs) - 1))

    def peek(self) -> Message | None:
        if self.heads and (not self.memory or self.heads[0][0] < self.memory[0]):
            return self.heads[0][0]
        return self.memory[0] if self.memory else None

    def pop(self) -> Message:
        if not self.heads or self.memory and self.memory[0] <= self.heads[0][0]:
            return heapq.heappop(self.memory)
        message, run = self.heads[0]
        following = next(self.runs[run], None)
        if following is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (following, run))
        return message


def turn_rows(turns: DataFrame, conv: str, order: Sequence[Column], role: str, text: str) -> DataFrame:
    """Rows (conv, pos, h1, h2, bytes): the turns of each conversation, numbered from 1."""
    named = turns.select(
        column(conv).cast("long").alias("conv"), F.struct(*order).alias("order"),
        F.coalesce(column(role), F.lit("")).alias("role"), F.coalesce(column(text), F.lit("")).alias("text"),
    ).filter("conv is not null")
    place = F.row_number().over(Window.partitionBy("conv").orderBy("order", "role", "text"))
    return named.select("conv", place.alias("pos"), "role", "text").select(
        "conv", "pos", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


def _paths(turns: DataFrame) -> DataFrame:
    """Rows (conv, d, n, k1, k2, p1, p2, bytes): the node of every turn and its parent."""
    order = Window.partitionBy("conv").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select(
        "*", F.row_number().over(order).cast("long").alias("d"), F.count("*").over(whole).alias("n")
    ).select("conv", "pos", "d", "n", "bytes", F.xxhash64("d", "h1").alias("t1"), F.xxhash64("d", "h2").alias("t2"))
    nodes = placed.select("*", F.bit_xor("t1").over(so_far).alias("k1"), F.bit_xor("t2").over(so_far).alias("k2"))
    parent = [F.col(k).bitwiseXOR(F.col(t)).alias(p) for k, t, p in (("k1", "t1", "p1"), ("k2", "t2", "p2"))]
    return nodes.select("conv", "d", "n", "k1", "k2", *parent, "bytes")


def _nodes(paths: DataFrame, shard_rows: int) -> DataFrame:
    """One row per node below the root, with its level and the root of its shard."""
    node = ["k1", "k2", "d"]
    heavy = paths.groupBy(*node).agg(F.sum(F.col("n") - F.col("d") + 1).alias("weight")).filter(F.col("weight") >= shard_rows)
    level = F.floor(F.log("weight") / F.log(F.lit(float(shard_rows)))).cast("int")
    # A few in a thousand rows, written so that Spark sees their size.
    heavy = stage(heavy.select(*node, F.greatest(level, F.lit(1)).alias("level")), "trie-heavy")
    levels = paths.join(heavy, node, "left").withColumn("level", F.coalesce("level", F.lit(0)))
    down = Window.partitionBy("conv", "level").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = levels.select("*", *(F.first(k).over(down).alias(s) for k, s in (("k1", "s1"), ("k2", "s2"))))
    same = [F.first(c).alias(c) for c in ("p1", "p2", "bytes", "s1", "s2", "level")]
    return placed.groupBy(*node).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *same)


_TOTALS = ("k1", "k2", "d", "p1", "p2", "conv", "n_convs", "n_children", "n_leaves", "saved", "top")


def _forward(nodes: DataFrame) -> DataFrame:
    """Totals of the nodes of one level; ``top`` marks the roots of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue()
        for batch in batches:
            children, leaves, saved = [], [], []
            top = []
            for k1, k2, d, p1, p2, n_convs, size, s1, s2, n, more, cost in zip(*(batch.column(i).to_pylist() for i in range(12))):
                while (first := queue.peek()) is not None and first[:3] == (-d, k1, k2):
                    message = queue.pop()
                    n, more, cost = n + 1, more + message[3], cost + message[4]
                more, cost = more or 1, cost + (n_convs - 1) * size
                shard_root = (k1, k2) == (s1, s2)
                if not shard_root:
                    queue.push((1 - d, p1, p2, more, cost))
                children.append(n)
                leaves.append(more)
                saved.append(cost)
                top.append(shard_root)
            made = [pa.array(x, pa.int64()) for x in (children, leaves, saved)] + [pa.array(top, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), batch.column(12), batch.column(5), *made], names=list(_TOTALS))

    order = ["s1", "s2", F.desc("d"), "k1", "k2"]
    dealt = nodes.repartition("s1", "s2").sortWithinPartitions(*order)
    dealt = dealt.select("k1", "k2", "d", "p1", "p2", "n_convs", "bytes", "s1", "s2", "children", "leaves", "saved", "conv")
    return dealt.mapInArrow(run, ", ".join(f"{c} {'boolean' if c == 'top' else 'long'}" for c in _TOTALS))


def _totals(nodes: DataFrame) -> DataFrame:
    """Rows of ``_TOTALS`` of all nodes, level by level (the logarithm of the rows to ``SHARD_ROWS``)."""
    highest = nodes.agg(F.max("level")).first()[0]
    done: DataFrame | None = None
    for level in range((highest or 0) + 1):
        own = nodes.filter(F.col("level") == level).drop("level")
        if done is None:
            own = own.select("*", *(F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")))
        else:
            sent = done.filter("top").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("d") - 1).alias("d")).agg(
                F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved")
            )
            own = own.join(sent, ["k1", "k2", "d"], "left").fillna(0, ["children", "leaves", "saved"])
        totals = stage(_forward(own), "trie-totals")
        done = totals if done is None else done.unionByName(totals)
    return done


_ENDS = "k1 long, k2 long, d long, first long, ids string, ends_sha256 string"
_JOINED = "k1 long, k2 long, d long, ends_sha256 string"


def _digest(ids: str) -> str:
    return hashlib.sha256(ids.encode()).hexdigest()


def _table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], names=names)


def _end_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the nodes inside a sorted range; pieces of the ids of nodes that may go on in another."""
    node: tuple | None = None
    held: list[int] = []
    starts_here = cut = False

    def row(whole: bool) -> tuple:
        ids = ",".join(map(str, held))
        return (*node, held[0], None, _digest(ids)) if whole else (*node, held[0], ids, None)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(4)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
        rows: list[tuple] = []
        for start, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            found = tuple(int(c[start]) for c in columns[:3])
            if found != node:
                if held:
                    rows.append(row(starts_here and not cut))
                starts_here, node, held, cut = node is not None, found, [], False
            held += columns[3][start:end].tolist()
            if len(held) >= PIECE_IDS:  # of a node with many ids; its pieces are joined later
                rows.append(row(False))
                held, cut = [], True
        if rows:
            yield _table_of(rows, _ENDS)
    if held:
        yield _table_of([row(False)], _ENDS)


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests from pieces sorted by node and first id; one piece is held at a time."""
    node: tuple | None = None
    state = hashlib.sha256()
    for batch in batches:
        rows: list[tuple] = []
        for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if tuple(key) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                rows.append((*node, state.hexdigest()))
            node, state = tuple(key), hashlib.sha256(ids.encode())
        if rows:
            yield _table_of(rows, _JOINED)
    if node is not None:
        yield _table_of([(*node, state.hexdigest())], _JOINED)


def _end_digests(ends: DataFrame) -> DataFrame:
    """Rows (k1, k2, d, ends_sha256) of the nodes (k1, k2, d) at which the conversations ``conv`` end."""
    order = ["k1", "k2", "d", "conv"]
    sorted_ends = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stage(sorted_ends.mapInArrow(_end_parts, _ENDS), "trie-ends")
    pieces = parts.filter("ids is not null").repartition("k1", "k2", "d").sortWithinPartitions("k1", "k2", "d", "first")
    joined = pieces.mapInArrow(_joined_ends, _JOINED)
    return parts.filter("ids is null").select("k1", "k2", "d", "ends_sha256").unionByName(joined)


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, shard_rows: int | None = None) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of last texts that sharing saves in the subtree) and ends_sha256.

    ``turns`` are rows as ``turn_rows`` gives them; ``members`` (conv) adds conversations without turns.
    """
    spark = turns.sparkSession
    node = ["k1", "k2", "d"]
    members = (turns if members is None else members).select("conv").filter("conv is not null").distinct()
    members = stage(members, "trie-members")
    paths = stage(_paths(turns), "trie-paths")
    nodes = stage(_nodes(paths, shard_rows or SHARD_ROWS), "trie-nodes")
    totals = _totals(nodes)
    ends = paths.filter("d = n").select(*node, "conv")
    empty = members.join(ends.select("conv"), "conv", "left_anti").select(*(F.lit(0).cast("long").alias(c) for c in node), "conv")
    digests = stage(_end_digests(ends.unionByName(empty)), "trie-digests")
    drop_stage(spark, nodes)
    drop_stage(spark, paths)
    # The root from its members (rows without children) and from the nodes below it.
    own = members.select("conv", F.lit(1).alias("member"), F.lit(0).alias("child"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("cost"))
    below = totals.filter("d = 1").select(
        F.lit(None).cast("long").alias("conv"), F.lit(0).alias("member"), F.lit(1).alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved").alias("cost")
    )
    root = own.unionByName(below).agg(
        F.min("conv").alias("conv"), F.sum("member").alias("n_convs"), F.sum("child").alias("n_children"),
        F.greatest(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.sum("cost").alias("saved"),
    ).filter("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(c) for c in node), "conv", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved"
    )
    root = stage(root, "trie-root")
    parents = totals.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("d") + 1).alias("d"), F.col("conv").alias("above"))
    first = root.select(F.lit(1).cast("long").alias("d"), F.col("conv").alias("top_conv"))
    inner = totals.join(parents, ["p1", "p2", "d"], "left").join(F.broadcast(first), "d", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("above", "top_conv")).select(*root.columns)
    every = inner.unionByName(root).join(digests, node, "left")
    return every.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_digest(""))).alias("ends_sha256"),
    )
