"""Delimited text: separator, encoding and header per file, then one scan per kind of file."""

from __future__ import annotations

import csv
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import CORRUPT, IDENTITY, ROW_ID, SOURCE_FILE, column, text_columns
from tablewright.functions import constants as K
from tablewright.sources import quoted
from tablewright.sources.headers import IngestError, header_names
from tablewright.sources.inventory import file_path, metadata_path

SNIFF_SHARE = 0.9


@dataclass(frozen=True)
class TextFormat:
    """How to read a file; files of equal format form one scan."""

    separator: str
    encoding: str
    columns: tuple[str, ...]
    multiline: bool


_SUMMARY = (
    "path string, block long, utf8 boolean, latin boolean, multiline boolean, lines long, header binary, "
    "first array<int>, counts array<struct<candidate:int,times:int,lines:bigint>>"
)


class _BlockSummary:
    """What the lines of one file block say about the format of their file."""

    def __init__(self, path: str, block: int) -> None:
        self.found = {"path": path, "block": block, "utf8": True, "latin": False, "multiline": False, "lines": 0, "header": None, "first": None}
        self.counts: list[Counter] = [Counter() for _ in K.DELIMITERS]

    def add(self, lines: pa.Array) -> None:
        found = self.found
        try:
            lines.cast(pa.string())
        except pa.ArrowInvalid:
            found["utf8"] = False
            found["latin"] = found["latin"] or any(_unassigned(line) for line in lines.to_pylist())
        quotes = pc.count_substring(lines, b'"')
        if pc.any(pc.greater(quotes, 0)).as_py():
            found["multiline"] = found["multiline"] or bool((quotes.to_numpy() % 2 == 1).any())
        filled = lines.filter(pc.match_substring_regex(lines, rb"[^ ]"))
        if not len(filled):
            return
        bare = pc.replace_substring_regex(filled, rb'"[^"]*"', b"") if pc.max(quotes).as_py() > 1 else filled
        times = [pc.count_substring(bare, sep.encode()).to_numpy() for sep in K.DELIMITERS]
        if found["header"] is None:
            found["header"], found["first"] = filled[0].as_py(), [int(t[0]) for t in times]
        found["lines"] += len(filled)
        for counter, t in zip(self.counts, times):
            counter.update(dict(zip(*(part.tolist() for part in np.unique(t, return_counts=True)))))

    def row(self) -> dict:
        counts = [{"candidate": i, "times": t, "lines": n} for i, counter in enumerate(self.counts) for t, n in counter.items()]
        return {**self.found, "counts": counts}


def _unassigned(line: bytes) -> bool:
    """Whether a line that is no UTF-8 has bytes that Windows-1252 leaves unassigned."""
    try:
        line.decode()
    except UnicodeDecodeError:
        return any(byte in line for byte in K.CP1252_UNASSIGNED)
    return False


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted = pa.struct({"candidate": pa.int32(), "times": pa.int32(), "lines": pa.int64()})
    schema = pa.schema({
        "path": pa.string(), "block": pa.int64(), "utf8": pa.bool_(), "latin": pa.bool_(), "multiline": pa.bool_(),
        "lines": pa.int64(), "header": pa.binary(), "first": pa.list_(pa.int32()), "counts": pa.list_(counted),
    })
    name, summary = None, None
    for following, lines in quoted.by_block(batches):
        if following != name:
            if summary:
                yield pa.RecordBatch.from_pylist([summary.row()], schema)
            name, summary = following, _BlockSummary(*following)
        summary.add(lines)
    if summary:
        yield pa.RecordBatch.from_pylist([summary.row()], schema)


def formats(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, encoding, multiline, separator, header) from one pass over all bytes, aggregated per file.

    A byte sequence that is no UTF-8 anywhere in the file means a one-byte encoding; bytes that
    Windows-1252 leaves unassigned then mean Latin-1. A line with an odd number of quotes means
    that a field holds a line break. The separator is the candidate that occurs equally often, outside
    quotes, in most lines. Each task adds its lines up to one row per file block; the bytes of a line are
    taken as they are, which keeps the separators and never fails.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )
    # One row per file block.
    blocks = _staged(lines.mapInArrow(_summaries, _SUMMARY).withColumn("path", file_path(F.col("path"))), "formats")
    files = blocks.groupBy("path").agg(
        F.bool_and("utf8").alias("utf8"), F.bool_or("latin").alias("latin"), F.bool_or("multiline").alias("multiline"), F.sum("lines").alias("lines"),
        F.min_by("header", F.when(F.col("header").isNotNull(), F.col("block"))).alias("header"),
        F.min_by("first", F.when(F.col("header").isNotNull(), F.col("block"))).alias("first"),
    )
    encoding = F.when(F.col("utf8"), "UTF-8").when(F.col("latin"), "ISO-8859-1").otherwise("CP1252")
    same = (
        blocks.select("path", F.inline("counts"))
        .groupBy("path", "candidate", "times")
        .agg(F.sum("lines").alias("lines"))
        .groupBy("path", "candidate")
        .agg(F.max(F.struct("lines", (-F.col("times")).alias("times"))).alias("mode"))
        .groupBy("path")
        .agg(*[F.max(F.when(F.col("candidate") == i, F.col("mode"))).alias(f"m{i}") for i in range(len(K.DELIMITERS))])
    )
    found = files.join(same, "path", "left")

    def share(i: int) -> Column:
        return F.when(F.col(f"m{i}.times") < 0, F.col(f"m{i}.lines") / F.col("lines")).otherwise(0.0)

    shares = [share(i) for i in range(len(K.DELIMITERS))]
    best = F.greatest(*shares)
    # Without such a candidate the header decides, and a header of one name means a comma.
    most = F.array_max("first")
    by_header = F.when(most == 0, K.DELIMITERS[0])
    for i, sep in enumerate(K.DELIMITERS):
        by_header = by_header.when(F.get("first", F.lit(i)) == most, sep)
    choice = F.when(best < SNIFF_SHARE, by_header)
    for i, sep in enumerate(K.DELIMITERS):
        choice = choice.when(shares[i] == best, sep)
    return found.select("path", encoding.alias("encoding"), "multiline", choice.alias("separator"), "header")


def describe(
    spark: SparkSession, paths: Sequence[str]
) -> tuple[dict[TextFormat, list[str]], list[tuple[str, str]]]:
    """Files grouped by format, and the files that cannot be read with the reason.

    The result holds one small record per file, like the file listing itself.
    """
    groups: dict[TextFormat, list[str]] = defaultdict(list)
    failures: list[tuple[str, str]] = []
    for row in sorted(formats(spark, paths).collect(), key=lambda r: r.path):
        try:
            if row.header is None:
                raise IngestError("the file has no content")
            codec = {"UTF-8": "utf-8-sig", "ISO-8859-1": "latin-1", "CP1252": "cp1252"}[row.encoding]
            line = bytes(row.header).decode(codec)
            names = header_names(next(csv.reader([line], delimiter=row.separator)))
        except (IngestError, UnicodeDecodeError, csv.Error, StopIteration) as error:
            failures.append((row.path, str(error) or type(error).__name__))
            continue
        groups[TextFormat(row.separator, row.encoding, tuple(names), row.multiline)].append(row.path)
    return dict(groups), failures


def _from_cp1252(cell: Column) -> Column:
    """Windows-1252 text that was read as Latin-1."""
    codes = [c for c in range(0x80, 0xA0) if c not in K.CP1252_UNASSIGNED]
    return F.translate(cell, "".join(chr(c) for c in codes), K.CP1252_CHARS)


def scan(spark: SparkSession, fmt: TextFormat, paths: Sequence[str]) -> DataFrame:
    """All cells as text, with source file, row id and the raw text of malformed rows.

    Only the empty field is null; 'NA' and 'null' stay text. Row ids follow the order of the rows in
    a file. Without line breaks in quotes the scan is meant to be staged whole, since the row ids then
    follow its physical order.
    """
    if not fmt.multiline:
        return _scan_whole(spark, fmt, paths)
    small, large = _by_size(spark, paths)
    by_one_task, states = list(small), None
    if large:
        maps = _staged(quoted.block_maps(spark, large, fmt.separator), "blocks")
        # One small record per file, as in the listing.
        odd = [row.path for row in maps.filter("returns").select("path").distinct().collect()]
        by_one_task += odd
        large = [path for path in large if path not in set(odd)]
        states = _staged(quoted.block_states(maps.filter(~F.col("path").isin(odd)) if odd else maps), "blocks")
    parts = [_scan_blocks(spark, fmt, large, states)] if large else []
    parts += [_scan_whole(spark, fmt, by_one_task)] if by_one_task else []
    return _with_row_ids(parts)


def _by_size(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """Files that Spark never splits, and those that it may; only the listing is read."""
    sizes = spark.read.format("binaryFile").load(list(paths)).select(metadata_path().alias("path"), "length")
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    least = min(jvm.byteStringAsBytes(spark.conf.get(f"spark.sql.files.{name}")) for name in ("maxPartitionBytes", "openCostInBytes"))
    rows = sizes.select("path", (F.col("length") > least).alias("split")).collect()
    return sorted(r.path for r in rows if not r.split), sorted(r.path for r in rows if r.split)


def _staged(df: DataFrame, label: str) -> DataFrame:
    from tablewright.runner import stage

    return stage(df, label)


def _with_row_ids(parts: list[DataFrame]) -> DataFrame:
    """Scans as one table; the number of the scan goes before the row ids of each."""
    room = 62 - (len(parts) - 1).bit_length()
    numbered = [part.withColumn(ROW_ID, F.col(ROW_ID) + F.lit(i << room)) for i, part in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered)


def _options(fmt: TextFormat) -> dict[str, str]:
    return {
        "sep": fmt.separator, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": str(fmt.multiline).lower(),
    }


def _cells(fmt: TextFormat, cell: Callable[[str], Column]) -> list[Column]:
    values = {name: F.nullif(cell(name), F.lit("")) for name in fmt.columns}
    return [(_from_cp1252(v) if fmt.encoding == "CP1252" else v).alias(name) for name, v in values.items()]


def _scan_whole(spark: SparkSession, fmt: TextFormat, paths: Sequence[str]) -> DataFrame:
    """By Spark's own reader: one task per file if quotes hold line breaks."""
    fields = [T.StructField(name, T.StringType()) for name in (*fmt.columns, CORRUPT)]
    reader = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("encoding", "UTF-8" if fmt.encoding == "UTF-8" else "ISO-8859-1")
        .options(**_options(fmt))
    )
    df = reader.csv(list(paths))
    return df.select(
        metadata_path().alias(SOURCE_FILE), F.monotonically_increasing_id().alias(ROW_ID), *_cells(fmt, column), CORRUPT
    )


def _scan_blocks(spark: SparkSession, fmt: TextFormat, paths: Sequence[str], states: DataFrame) -> DataFrame:
    """By records that are found block by block, so that many tasks read one file."""
    found = quoted.records(spark, paths, fmt.separator, fmt.encoding, states)
    names = {name: f"c{i}" for i, name in enumerate(fmt.columns)}
    schema = ", ".join([*(f"{alias} string" for alias in names.values()), f"{CORRUPT} string"])
    parsed = found.select("path", "id", F.from_csv("record", schema, _options(fmt)).alias("row"))
    cells = _cells(fmt, lambda name: F.col(f"row.{names[name]}"))
    return parsed.select(F.col("path").alias(SOURCE_FILE), F.col("id").alias(ROW_ID), *cells, F.col(f"row.{CORRUPT}").alias(CORRUPT))


def _too_long(fmt: TextFormat) -> Column:
    """Whether a malformed record has more fields than the header; quotes count only around a field."""
    sep = re.escape(fmt.separator)
    field = rf'(?s)(?:\A|{sep})(?:"(?:[^"]|"")*+"(?={sep}|\z)|[^{sep}]*)'
    return F.coalesce(F.regexp_count(F.col(CORRUPT), F.lit(field)) > len(fmt.columns), F.lit(False))


def split_rejects(scanned: DataFrame, fmt: TextFormat) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows with more fields than the header. Shorter rows are padded with nulls."""
    good = scanned.filter(~_too_long(fmt)).drop(CORRUPT)
    bad = scanned.filter(_too_long(fmt)).select(
        column(SOURCE_FILE), column(ROW_ID), F.col(CORRUPT).alias("record"), F.lit("too many fields").alias("reason")
    )
    return good, bad


def read_text(
    spark: SparkSession, paths: str | Sequence[str], any_order: bool = False, groups: dict[TextFormat, list[str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """One table from files with equal columns: (staged rows, rejected rows).

    Files of one table may differ in separator, encoding or line breaks. Row ids hold the number of
    the kind of file, so they are unique in the table. With ``any_order`` files
    may name their columns in different orders. ``groups`` are the files by format, as found by
    ``describe``; with them no file is read again to find its format.
    """
    from tablewright.runner import stage

    if groups is None:
        groups, failures = describe(spark, [paths] if isinstance(paths, str) else list(paths))
        if failures:
            raise IngestError("; ".join(f"{path}: {reason}" for path, reason in failures))
    if len({tuple(sorted(fmt.columns)) if any_order else fmt.columns for fmt in groups}) != 1:
        raise IngestError(f"expected files with equal columns, found {len(groups)} kinds of file")
    surplus = "_surplus"
    parts = [scan(spark, fmt, files).withColumn(surplus, _too_long(fmt)) for fmt, files in groups.items()]
    every = _with_row_ids(parts)
    rows = stage(every, "scan")
    rejected = rows.filter(surplus).select(
        column(SOURCE_FILE), column(ROW_ID), F.col(CORRUPT).alias("record"), F.lit("too many fields").alias("reason")
    )
    return rows.filter(~F.col(surplus)).drop(CORRUPT, surplus), rejected


# How each type is written; a text like 'yes' or '1.5f' is none of them.
_INTEGER = r"^[+-]?[0-9]+$"
# Integers up to this size are exact as doubles.
_EXACT = 2**53
_DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"
_BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"
# Longest spelling with the line end that a pattern leaves out of account.
_BOOLEAN_BYTES = 8
_AS_BIGINT, _AS_DOUBLE, _AS_BOOLEAN = 1, 2, 4


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast text columns whose every value is an integer, a double or a boolean; dates stay text.

    One aggregate over all cells decides. Codes with leading zeros become numbers, so this is
    a choice of the caller and never the default. Integers that do not fit 64 bits keep their
    column text, as do whole numbers that a double would round.
    """
    names = [n for n in (columns or text_columns(df)) if n not in IDENTITY]
    if not names:
        return df
    # One row per cell, so that the generated code is that of one column, however many there are. Values
    # that repeat are not worth a grouping of their own here.
    cells = df.select(*[column(n).alias(str(i)) for i, n in enumerate(names)]).unpivot(
        [], [F.col(f"`{i}`") for i in range(len(names))], "pos", "value"
    )
    cells = cells.filter("value is not null").select("pos", F.trim("value").alias("cell"))
    cell = F.col("cell")
    # A cast that fails costs an exception a cell, so the size of an integer is read from its digits.
    size = F.regexp_extract(cell, "^[+-]?0*([0-9]*)", 1)

    def up_to(most: Column) -> Column:
        return (F.length(size) < F.length(most)) | ((F.length(size) == F.length(most)) & (size <= most))

    largest = F.when(cell.startswith("-"), str(2**63)).otherwise(str(2**63 - 1))
    # What a cell can be; a column is what all of its cells can be.
    can_be = (
        F.when(
            cell.rlike(_INTEGER),
            F.when((F.octet_length(cell) < len(str(_EXACT))) | up_to(F.lit(str(_EXACT))), _AS_BIGINT + _AS_DOUBLE)
            .when(up_to(largest), _AS_BIGINT)
            .otherwise(0),
        )
        .when(cell.rlike(_DOUBLE), _AS_DOUBLE)
        .when((F.octet_length(cell) <= _BOOLEAN_BYTES) & cell.rlike(_BOOLEAN), _AS_BOOLEAN)
        .otherwise(0)
    )
    # One row per column.
    found = cells.groupBy("pos").agg(F.bit_and(can_be).alias("kinds")).collect()
    types = {}
    for row in found:
        kinds = ((_AS_BIGINT, "bigint"), (_AS_DOUBLE, "double"), (_AS_BOOLEAN, "boolean"))
        types[names[int(row.pos)]] = next((name for bit, name in kinds if row.kinds & bit), None)
    return df.select(
        *[
            F.trim(column(n)).try_cast(types[n]).alias(n) if types.get(n) else column(n)
            for n in df.columns
        ]
    )
