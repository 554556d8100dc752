import random
import zlib
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from tablewright.llm import trie
from tablewright.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def nodes_of(talks):
    """All nodes of {conv: [(role, text), ...]} by walking every prefix."""
    members = defaultdict(list)
    for conv, turns in sorted(talks.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in convs if len(talks[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks_of(rng, n):
    words = ["", "a", "é", "b" * 9]
    return {c: [(rng.choice("ux"), rng.choice(words)) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))] for c in rng.sample(range(-500, 500), n)}


def frames(spark, talks):
    rows = [(c, i, r or None, t or None, "z", 4) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, TURNS + ", conv string, bytes int")
    return trie.turn_rows(df, "conv_id", [F.col("turn")], "role", "text"), spark.createDataFrame([(c,) for c in talks], "conv long")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force_with_many_levels(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    monkeypatch.setattr(trie, "QUEUE_ENTRIES", 2)
    rng = random.Random(6)
    for shard_rows in (2, 7, 1000):
        talks = talks_of(rng, 90)
        talks |= {1000 + i: [("u", "hi")] for i in range(40)} | {2000: [("u", "x")] * 300, 3000: [("u", "hi"), ("u", "hi")]}
        talks = {c: [(r, t) for r, t in turns] for c, turns in talks.items()}
        turns, members = frames(spark, talks)
        got = collected(trie.prefix_trie(turns, members, shard_rows=shard_rows))
        assert got == nodes_of({c: v for c, v in talks.items()})


def test_edges(spark):
    turns, members = frames(spark, {5: [], 7: []})
    assert collected(trie.prefix_trie(turns, members)) == nodes_of({5: [], 7: []})
    turns, members = frames(spark, {})
    assert collected(trie.prefix_trie(turns)) == []
    rows = [(1, 2, "u", "b"), (1, None, None, None), (1, 2, "u", "a"), (1, 2, "u", "a"), (None, 1, "u", "lost")]
    df = spark.createDataFrame(rows, TURNS)
    turns = trie.turn_rows(df, "conv_id", [F.col("turn")], "role", "text")
    assert collected(trie.prefix_trie(turns)) == nodes_of({1: [("", ""), ("u", "a"), ("u", "a"), ("u", "b")]})


def test_ids_of_a_hot_node_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 50)
    ends = [(1, 1, 1, c) for c in range(5000)] + [(k, k, 2, -k) for k in range(2, 40)]
    df = spark.createDataFrame(ends, "k1 long, k2 long, d long, conv long").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.k1, r.d): r.ends_sha256 for r in trie._end_digests(df).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {(1, 1): sha256(",".join(map(str, range(5000))).encode()).hexdigest()}
    want |= {(k, 2): sha256(str(-k).encode()).hexdigest() for k in range(2, 40)}
    assert got == want


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    queue, held, out = trie.SpillingQueue(4), [], []
    for _ in range(500):
        if rng.random() < 0.6 or not held:
            message = (-rng.randint(0, 9), rng.randint(-3, 3), 0, rng.randint(0, 99), 1)
            queue.push(message)
            held.append(message)
        else:
            assert queue.peek() == min(held)
            out.append(queue.pop())
            held.remove(out[-1])
    assert len(queue.runs) > 3
    assert [queue.pop() for _ in held] == sorted(held) and queue.peek() is None


def test_query(spark, write_tables):
    rng = random.Random(4)
    rows = []
    for c in [*range(60), -3, -7, 101]:
        rows += [(c, i, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", None, "x" * 50])) for i in range(rng.choice([1, 2, 4, 9, 12]))]
    folder = write_tables(conversations=(rows, TURNS))
    own = defaultdict(list)
    for c, i, r, t in rows:
        own[c].append((r or "", t or ""))
    talks = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        talks[c] = own.get(base, [])[:h] + own[c][h:]
    assert collected(QUERIES["op13_prefix_trie"](spark, folder)) == nodes_of(talks)
