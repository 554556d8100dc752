"""Consistent placement with a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: it starts at a
hashed slot and goes on by a hashed step. The shards take turns, each claiming the first slot of its
order that is still free, until the table is full. A key is hashed to a slot, whose owner is its shard.
Shards get equal shares within one slot, and when a shard is added or removed few other keys move.

Defined cases: a null key is placed like the empty text; equal keys always share a shard; repeated
shard names and a size that is no prime above the number of shards are refused. Extra columns are
kept; clashing ``slot`` and ``shard`` are replaced. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the lookup table: a prime over a hundred times the number of shards.
SLOTS = 4099
#: The table is broadcast, so its size has a bound: 16 bytes a row.
MOST_SLOTS = 1 << 20


def hashed(key: Column) -> Column:
    """60-bit number of a key: the first fifteen hexadecimal digits of its md5 digest."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _check(shards: list[str], slots: int) -> None:
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("name every shard once")
    if not len(shards) < slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime above the number of shards, and bounded")


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Rows (slot, shard), one per slot; filled turn by turn in one expression over one row.

    The state holds four bytes per slot (0: free, else one plus the place of the shard) and the next
    preference of each shard. The first free slot is looked for among the next 32 preferences, then
    among all that are left; a turn therefore costs little until the table is nearly full.
    """
    _check(shards, slots)
    names = F.array(*map(F.lit, shards))
    base = spark.range(1).select(
        names.alias("names"),
        F.transform(names, lambda n: hashed(F.concat(n, F.lit("#start"))) % slots).alias("starts"),
        F.transform(names, lambda n: hashed(F.concat(n, F.lit("#step"))) % (slots - 1) + 1).alias("steps"),
    )

    def place(q: Column, j: Column) -> Column:
        return (4 * ((q.start + j * q.step) % slots) + 1).cast("int")

    def first_free(state: Column, q: Column, last: Column) -> Column:
        free = F.filter(
            F.sequence(q.at, last), lambda j: F.substr(state.owner, place(q, j), F.lit(4)) == F.unhex(F.lit("00000000"))
        )
        return F.get(free, 0)

    def claim(state: Column, shard: Column, q: Column, j: Column) -> Column:
        mark = F.unhex(F.lpad(F.hex(shard + 1), 8, "0"))
        return F.struct(
            F.overlay(state.owner, mark, place(q, j)).alias("owner"),
            F.transform(state.next, lambda n, i: F.when(i == shard, j + 1).otherwise(n)).alias("next"),
        )

    def turn(state: Column, t: Column) -> Column:
        end = F.lit(slots - 1).cast("long")
        return _bind(
            t % len(shards),
            lambda shard: _bind(
                F.struct(
                    F.get(state.next, shard).alias("at"), F.get("starts", shard).alias("start"), F.get("steps", shard).alias("step")
                ),
                lambda q: _bind(
                    F.coalesce(first_free(state, q, F.least(q.at + 31, end)), first_free(state, q, end)),
                    lambda j: claim(state, shard, q, j),
                ),
            ),
        )

    zero = F.struct(
        F.unhex(F.repeat(F.lit("00000000"), slots)).alias("owner"),
        F.array_repeat(F.lit(0).cast("long"), len(shards)).alias("next"),
    )
    filled = base.select("names", F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), zero, turn, lambda s: s.owner).alias("owner"))
    return filled.select("names", "owner", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).selectExpr(
        "slot", "get(names, int(conv(hex(substring(owner, 4 * slot + 1, 4)), 16, 10)) - 1) as shard"
    )


def place(df: DataFrame, lookup: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row; no row is shuffled, the bounded table is broadcast."""
    keyed = df.drop("slot", "shard").withColumn("slot", (hashed(F.col(key)) % slots).cast("int"))
    return keyed.join(F.broadcast(lookup), "slot")


def write_shards(placed: DataFrame, path: str, key: str, files_per_shard: int = 1) -> None:
    """Writes one folder per shard; a large shard is spread over ``files_per_shard`` tasks and files."""
    spread = F.pmod(F.xxhash64(key), F.lit(files_per_shard))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
