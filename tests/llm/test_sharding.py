import hashlib
from collections import Counter

import pytest

from tablewright.llm import sharding


def filled(names, slots):
    """The same table, written down turn by turn."""
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    orders = [[(number(n + "#start") % slots + j * (number(n + "#step") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    owner, t = {}, 0
    while len(owner) < slots:
        slot = next(s for s in orders[t % len(names)] if s not in owner)
        owner[slot] = names[t % len(names)]
        t += 1
    return owner


def test_table_is_fair_and_stable(spark):
    names = [f"n'{i}" for i in range(7)]
    table = {r.slot: r.shard for r in sharding.lookup_table(spark, names, 211).collect()}
    assert table == filled(names, 211)
    assert set(Counter(table.values()).values()) <= {30, 31}
    fewer = {r.slot: r.shard for r in sharding.lookup_table(spark, names[:-1], 211).collect()}
    moved = sum(table[s] != fewer[s] for s in table if table[s] != names[-1])
    assert moved < 211 / 4


def test_placement(spark):
    lookup = sharding.lookup_table(spark, ["a", "b"], 11)
    df = spark.createDataFrame([(None, "x"), ("", "y"), ("k", "z"), ("k", "z"), ("long" * 10000, "q")], "key string, shard string")
    rows = sharding.place(df, lookup, "key", 11).collect()
    assert len(rows) == 5 and len({r.slot for r in rows if r.key == "k"}) == 1
    assert len({r.slot for r in rows if not r.key}) == 1 and {r.shard for r in rows} <= {"a", "b"}
    assert sharding.place(df.limit(0), lookup, "key", 11).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    lookup = sharding.lookup_table(spark, ["a", "b", "c"], 11)
    placed = sharding.place(spark.range(100), lookup, "id", 11)
    sharding.write_shards(placed, str(tmp_path / "out"), "id", 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("id", "shard").collect())) == sorted(map(tuple, placed.select("id", "shard").collect()))


def test_refusals(spark):
    for shards, slots in ((["a", "a"], 11), ([], 11), (["a", "b"], 12), (["a", "b"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(spark, shards, slots)
