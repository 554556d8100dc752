"""Delimited text with line breaks inside quotes, read by many tasks per file.

Where a line begins inside or outside of quotes depends on everything before it. Each line is a map
from the state at its start to the state at its end (two states), and such maps compose:

1. every file block is read once; its lines compose to one map, two bits a block;
2. the maps of a file's blocks are composed in order (one row per block), which gives each block the
   state that it starts in, and the block in which the record began that it continues;
3. every block is read again from its known state: lines that start outside of quotes start records.
   Pieces of records that cross a block's end are joined by block; all other records stay where they are.

Line ends inside quotes stay as they are written. Files with a carriage return inside a line are left to Spark's own reader, one task per file, since
that reader then takes carriage returns for line ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.sources.inventory import metadata_path

OUTSIDE, INSIDE = 0, 1
#: Records of a block that row ids leave room for.
_BLOCK_RECORDS = 1 << 33


class LineStates:
    """State after a line: inside or outside of quotes, for either state before it.

    A quote opens a field only at the field's start; a doubled quote stands for one; what follows a
    closing quote up to the separator belongs to the field.
    """

    def __init__(self, separator: str) -> None:
        sep = re.escape(separator).encode("latin-1")
        quoted = rb'"(?:[^"]|"")*+"[^%b]*+' % sep
        self.fields = re.compile(rb'(?:(?:%b|[^"%b][^%b]*+)?+%b)*+' % (quoted, sep, sep, sep), re.S)
        self.closed = re.compile(rb'"(?:[^"]|"")*+"', re.S)
        self.rest = re.compile(rb'(?:[^"]|"")*+"[^%b]*+(%b)?' % (sep, sep), re.S)

    def from_outside(self, line: bytes, start: int = 0) -> int:
        last = self.fields.match(line, start).end()
        return INSIDE if line[last : last + 1] == b'"' and not self.closed.match(line, last) else OUTSIDE

    def from_inside(self, line: bytes) -> int:
        found = self.rest.match(line)
        if found is None:
            return INSIDE
        return self.from_outside(line, found.end()) if found.group(1) else OUTSIDE


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        metadata_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Consecutive lines of one block; a block may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, path = batch.column(1).to_numpy(), batch.column(0)
        codes = path.dictionary_encode().indices.to_numpy()
        changes = np.flatnonzero((block[1:] != block[:-1]) | (codes[1:] != codes[:-1])) + 1
        cuts = [0, *changes.tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield (path[start].as_py(), int(block[start])), batch.column(2).slice(start, end - start)


def _with_quotes(lines: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.greater(pc.find_substring(lines, b'"'), -1)).to_pylist()


_MAPS = "path string, block long, from_outside int, from_inside int, opens boolean, returns boolean"


def _record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], names=names)


def block_maps(spark: SparkSession, paths: Sequence[str], separator: str) -> DataFrame:
    """One row per file block: the states after it, and whether a record starts in it if it begins inside.

    ``returns`` tells of a carriage return that no line break follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = LineStates(separator)
        found: dict[tuple[str, int], tuple] = {}
        for name, lines in by_block(batches):
            outside, inside, opens, returns = found.get(name, (OUTSIDE, INSIDE, False, False))
            returns = returns or bool(pc.any(pc.match_substring_regex(lines, rb"\r[^\n]")).as_py())
            last = -1
            for i in _with_quotes(lines):
                opens = opens or inside == OUTSIDE
                line, last = lines[i].as_py(), i
                after = {state: states.from_inside(line) if state else states.from_outside(line) for state in {outside, inside}}
                outside, inside = after[outside], after[inside]
            opens = opens or inside == OUTSIDE and last < len(lines) - 1
            found[name] = (outside, inside, opens, returns)
        if found:
            yield _record_batch([(*name, *values) for name, values in found.items()], _MAPS)

    return _lines(spark, paths).mapInArrow(run, _MAPS)


def block_states(maps: DataFrame) -> DataFrame:
    """Rows (path, block, number, first, state, chain): the state that each block starts in.

    A map either gives one state whatever came before, or keeps the state, or swaps it. So the state
    follows from the last block of the first kind and the number of swaps since. ``chain`` is the
    number of the block in which the record began that this block continues. One row per block.
    """
    file = Window.partitionBy("path").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    so_far = file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swap = (F.col("from_outside") > F.col("from_inside")).cast("int")
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").alias("value"), F.col("swaps").alias("at")))
    numbered = maps.withColumn("number", F.row_number().over(Window.orderBy("path", "block")).cast("long"))
    swaps = numbered.withColumn("swaps", F.sum(swap).over(so_far)).withColumn("fixed", fixed)
    known = swaps.select(
        "*", F.last("fixed", ignorenulls=True).over(before).alias("last"), F.coalesce(F.lag("swaps").over(file), F.lit(0)).alias("count"),
        (F.row_number().over(file) == 1).alias("first"),
    )
    since = F.col("count") - F.coalesce("last.at", F.lit(0))
    state = ((F.coalesce("last.value", F.lit(OUTSIDE)) + since) % 2).cast("int")
    started = known.withColumn("state", state).withColumn("starts", F.when((F.col("state") == OUTSIDE) | F.col("opens"), F.col("number")))
    return started.select("path", "block", "number", "first", "state", F.last("starts", ignorenulls=True).over(before).alias("chain"))


_PIECES = "number long, place long, chain long, head boolean, record binary"


def _pieces(batches: Iterator[pa.RecordBatch], separator: str) -> Iterator[pa.RecordBatch]:
    """Records of blocks; pieces of records that cross a block's end have a chain."""
    states = LineStates(separator)
    number, state, chain, place, open_lines, header = None, OUTSIDE, None, 0, None, False

    def closed(whole: bool) -> list[tuple]:
        """The piece that is open when its block ends or a record starts."""
        if open_lines is None:
            return []
        own = place - 1 if chain is None else None
        return [(number, own, None if whole and chain is None else (number if chain is None else chain), header and own == 0, b"\n".join(open_lines))]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows: list[tuple] = []
        numbers = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for start, end in zip(cuts, cuts[1:]):
            if numbers[start] != number:
                rows += closed(state == OUTSIDE)
                number, state, header = int(numbers[start]), batch.column(2)[start].as_py(), batch.column(4)[start].as_py()
                chain = batch.column(3)[start].as_py() if state == INSIDE else None
                place, open_lines = 0, [] if state == INSIDE else None
            lines = batch.column(0).slice(start, end - start).cast(pa.binary())
            # Only lines with quotes change the state; lines that start outside of quotes start records.
            outside, after = np.empty(len(lines), bool), 0
            for i in _with_quotes(lines):
                outside[after : i + 1] = state == OUTSIDE
                line, after = lines[i].as_py(), i + 1
                state = states.from_inside(line) if state == INSIDE else states.from_outside(line)
            outside[after:] = state == OUTSIDE
            first = np.flatnonzero(outside)
            before = int(first[0]) if len(first) else len(lines)
            if before:
                open_lines += lines.slice(0, before).to_pylist()
            if not len(first):
                continue
            rows += closed(True)
            chain, open_lines = None, None
            if header and place == 0:  # blank lines before the header are no records
                blank = 0
                while blank < len(first) and not lines[int(first[blank])].as_py().rstrip(b"\r"):
                    blank += 1
                first = first[blank:]
                if not len(first):
                    continue
            # All but the last record are whole; those of one line are taken as they are.
            own = place + np.arange(len(first) - 1)
            one = first[1:] - first[:-1] == 1
            if len(own):
                several = [b"\n".join(lines.slice(i, j - i).to_pylist()) for i, j in zip(first[:-1][~one].tolist(), first[1:][~one].tolist())]
                found = pa.concat_arrays([lines.take(pa.array(first[:-1][one])), pa.array(several, pa.binary())])
                own = np.concatenate([own[one], own[~one]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), number, np.int64)), pa.array(own), pa.nulls(len(own), pa.int64()), pa.array((own == 0) & header), found],
                    names=["number", "place", "chain", "head", "record"],
                )
            place += len(first)
            open_lines = lines.slice(int(first[-1])).to_pylist()
        if rows:
            yield _record_batch(rows, _PIECES)
    if rows := closed(state == OUTSIDE):
        yield _record_batch(rows, _PIECES)


def records(spark: SparkSession, paths: Sequence[str], separator: str, encoding: str, states: DataFrame) -> DataFrame:
    """Rows (path, id, record): the records of the files in the order of ``id``, without header and empty ones."""
    from tablewright.runner import stage

    # One row for each block of a file.
    known = F.broadcast(states)
    lines = _lines(spark, paths).join(known, ["path", "block"]).select("line", "number", "state", "chain", "first")
    pieces = stage(lines.mapInArrow(lambda batches: _pieces(batches, separator), _PIECES), "quoted")
    text = F.col("record").cast("string") if encoding == "UTF-8" else F.decode("record", "ISO-8859-1")
    pieces = pieces.withColumn("record", text)
    whole = pieces.filter("chain is null").select("number", "place", "head", "record")
    crossing = pieces.filter("chain is not null").groupBy(F.col("chain").alias("number")).agg(
        F.max("place").alias("place"), F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("number", "record"))).alias("parts")
    )
    joined = crossing.select("number", "place", "head", F.array_join("parts.record", "\n").alias("record"))
    every = whole.unionByName(joined).filter("not head").withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    files = F.broadcast(states.select("number", "path"))
    return every.filter("record <> ''").join(files, "number").select("path", (F.col("number") * _BLOCK_RECORDS + F.col("place")).alias("id"), "record")
