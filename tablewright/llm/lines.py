"""Repeated lines by a range-partitioned, sorted stream of line hashes.

1. every line that counts becomes (two 64-bit hashes of its key, document, row, position): no text;
2. the hashes are range-partitioned and sorted by key, document (largest first), row and position. The
   ranges cut through keys, so a line that a third of all rows hold is spread over many tasks;
3. each task streams its rows once. The first document of a key keeps its lines; those of the second
   wait until a third one is seen; those of later ones go at once. Only one document's lines ever wait;
4. only the first and the last key of a task can go on in another one. These leave one row of counts
   per task, which are added up and sent to all tasks (at most two rows a task), and settle what waits;
5. the positions that go become one compressed bitmap per document. ``apply_bitmaps`` cuts texts by them.

Defined cases: a null or empty text is one empty line. Rows of one key count as one document, and each
gets a bitmap of its own; they are told apart by a hash of their text (column ``row``). A null key is a
document below all others. Extra columns are ignored by ``keep_bitmaps`` and kept by ``apply_bitmaps``.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import column
from tablewright.llm.common import drop_stage, slices, stage

#: Code points that a key needs, and documents that must hold it.
LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
_BLANKS = " \t\n\v\f\r"
_NO_KEY = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends, A-Z lowered."""
    bare = F.btrim(line, F.lit(_BLANKS))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # lower() treats pure ASCII as bytes and is many times faster than translate().
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, upper, lower))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (doc, row, text) with nulls replaced."""
    whole = F.coalesce(column(text), F.lit(""))
    return docs.select(F.coalesce(column(key).cast("long"), F.lit(_NO_KEY)).alias("doc"), F.xxhash64(whole).alias("row"), whole.alias("text"))


def _line_hashes(rows: DataFrame, least_chars: int) -> DataFrame:
    lines = rows.select("doc", "row", F.posexplode(F.transform(F.split("text", "\n"), line_key)).alias("pos", "line"))
    long = lines.filter(F.char_length("line") >= least_chars)
    return long.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "row", "pos")


_MARKS = "h1 long, h2 long, doc long, row long, pos int, part int, docs long, last long"
_NAMES = [c.split()[0] for c in _MARKS.split(", ")]
_KINDS = {n: pa.int32() if n in ("pos", "part") else pa.int64() for n in _NAMES}


def _batch(n: int, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], _KINDS[c]) if c in columns else pa.nulls(n, _KINDS[c]) for c in _NAMES], names=_NAMES
    )


class LineStream:
    """Decides the lines of one sorted range; see the module's text for the kinds of rows it gives out."""

    def __init__(self, part: int, least_documents: int) -> None:
        self.part, self.decided = part, least_documents - 1
        self.key: tuple[int, int] | None = None
        #: Of the open key: its largest document here, the one seen last, and how many came before that.
        self.first_doc = self.doc = self.rank = 0
        self.in_first = True
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def summary(self) -> pa.RecordBatch:
        """The counts of the open key: documents here, the largest and the smallest of them."""
        values = {"h1": self.key[0], "h2": self.key[1], "doc": self.first_doc, "part": self.part, "docs": self.rank + 1, "last": self.doc}
        return _batch(1, **{name: np.array([value]) for name, value in values.items()})

    def _open_later(self, rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        n = len(rows[0])
        return _batch(n, h1=np.full(n, self.key[0]), h2=np.full(n, self.key[1]), doc=rows[0], row=rows[1], pos=rows[2])

    def add(self, h1: np.ndarray, h2: np.ndarray, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Takes the next rows of the range; ``rows`` are document, row and position."""
        n, doc = len(h1), rows[0]
        if self.key is None:
            self.key, self.first_doc, self.doc = (int(h1[0]), int(h2[0])), int(doc[0]), int(doc[0])
        new_key, new_doc = np.empty(n, bool), np.empty(n, bool)
        new_key[0] = self.key != (int(h1[0]), int(h2[0]))
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc[0] = new_key[0] or int(doc[0]) != self.doc
        new_doc[1:] = new_key[1:] | (doc[1:] != doc[:-1])
        # Group 0 is the key that was open; rank counts the documents of the key before the row's own.
        group, seen, start = np.cumsum(new_key), np.cumsum(new_doc), np.flatnonzero(new_key)
        rank = seen - np.append(-self.rank, seen[start])[group]
        of = lambda mask: tuple(c[mask] for c in rows)
        old = int(start[0]) if len(start) else n
        if old:
            self.doc, self.rank = int(doc[old - 1]), int(rank[old - 1])
            if self.in_first:
                yield self._open_later(tuple(c[:old] for c in rows))
            else:
                self.waiting.append(of((group == 0) & (rank >= 1)))
        if self.waiting and self.rank >= self.decided:
            doc_, row, pos = (np.concatenate(c) for c in zip(*self.waiting))
            yield _batch(len(pos), doc=doc_, row=row, pos=pos)
            self.waiting = []
        if not len(start):
            return
        if self.in_first:
            yield self.summary()
            self.in_first = False
        most = np.append(self.rank, rank[np.append(start[1:], n) - 1])
        goes = (group > 0) & (rank >= 1) & (most[group] >= self.decided)
        if goes.any():
            doc_, row, pos = of(goes)
            yield _batch(len(pos), doc=doc_, row=row, pos=pos)
        at = start[-1]
        self.key, self.first_doc = (int(h1[at]), int(h2[at])), int(doc[at])
        self.doc, self.rank = int(doc[-1]), int(rank[-1])
        self.waiting = [of((group == len(start)) & (rank >= 1))] if self.rank < self.decided else []

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.key is None:
            return
        if self.waiting:
            yield self._open_later(tuple(np.concatenate(c) for c in zip(*self.waiting)))
        yield self.summary()


def _marks(hashes: DataFrame, least_documents: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = LineStream(TaskContext.get().partitionId(), least_documents)
        for batch in batches:
            if batch.num_rows:
                yield from stream.add(*(batch.column(i).to_numpy() for i in range(5)))
        yield from stream.end()

    order = ["h1", "h2", F.desc("doc"), "row", "pos"]
    return hashes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _MARKS)


def _settled(marks: DataFrame) -> DataFrame:
    """Rows (doc, row, pos) of what waits, of the keys that the tasks together find often enough."""
    parts = marks.filter("part is not null").select("h1", "h2", "part", "docs", F.col("doc").alias("first"), "last")
    here = Window.partitionBy("h1", "h2").orderBy("part")
    again = F.coalesce((F.lag("last").over(here) == F.col("first")).cast("long"), F.lit(0))
    keys = parts.withColumn("again", again).groupBy("h1", "h2").agg(F.sum(F.col("docs") - F.col("again")).alias("docs"), F.max("first").alias("largest"))
    waits = marks.filter("part is null and h1 is not null").select("h1", "h2", "doc", "row", "pos")
    # At most two rows for each task of the stream.
    return waits.join(F.broadcast(keys), ["h1", "h2"]).filter("doc < largest").select("doc", "row", "pos", "docs")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, dropped, keep = [], [], []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3)):
            bits = np.ones(n, bool)
            if gone.is_valid:
                bits[gone.values.to_numpy()] = False
            counts.append(n)
            dropped.append(n - int(bits.sum()))
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())],
            names=["doc", "row", "n_lines", "n_dropped", "keep"],
        )


def keep_bitmaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """Rows (key, row, n_lines, n_dropped, keep): one per row of ``docs``.

    ``keep`` is the zlib-compressed bitmap of the lines that stay, first line in the highest bit.
    ``least_documents`` is 2 at least.
    """
    if least_documents < 2:
        raise ValueError("a line that is in one document only is no repeat")
    spark = docs.sparkSession
    rows = _rows(docs, key, text)
    hashes = stage(_line_hashes(rows, least_chars), "line-hashes")
    marks = stage(_marks(hashes, least_documents), "line-marks")
    drop_stage(spark, hashes)
    gone = marks.filter("h1 is null").select("doc", "row", "pos")
    settled = _settled(marks).filter(F.col("docs") >= least_documents).drop("docs")
    gone = stage(gone.unionByName(settled), "line-drops")
    drop_stage(spark, marks)
    by_row = gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")
    joined = rows.select("doc", "row", lines).join(by_row, ["doc", "row"], "left").select("doc", "row", "n", "gone")
    done = joined.mapInArrow(_bitmaps, "doc long, row long, n_lines long, n_dropped long, keep binary")
    named = F.when(F.col("doc") != _NO_KEY, F.col("doc")).alias(key)
    return done.select(named, "row", "n_lines", "n_dropped", "keep")


def kept_text(text: str, keep: bytes, n: int) -> str:
    """The lines of a text that a bitmap keeps, joined by line breaks."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
    return "\n".join([line for line, bit in zip(text.split("\n"), bits.tolist()) if bit])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (all columns) with ``n_lines``, ``n_dropped`` and ``kept_text``, replacing columns of these names."""
    new = ("n_lines", "n_dropped", "kept_text")
    whole = F.struct(*(column(c) for c in docs.columns if c not in new))
    held = docs.select(whole.alias("all"), F.coalesce(column(key).cast("long"), F.lit(_NO_KEY)).alias("doc"), F.coalesce(column(text), F.lit("")).alias("text"))
    held = held.withColumn("row", F.xxhash64("text"))
    ids = bitmaps.select(F.coalesce(column(key), F.lit(_NO_KEY)).alias("doc"), "row", "n_lines", "n_dropped", "keep").dropDuplicates(["doc", "row"])
    joined = held.join(ids, ["doc", "row"]).select("text", "keep", "n_lines", "n_dropped", "all")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns = (part.column(i).to_pylist() for i in range(4))
                kept = [kept_text(t, bits, n) if gone else t for t, bits, n, gone in zip(*columns)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(4), part.column(2), part.column(3), pa.array(kept, pa.string())], names=["all", *new]
                )

    schema = T.StructType([joined.schema["all"], *(T.StructField(n, T.LongType()) for n in new[:2]), T.StructField(new[2], T.StringType())])
    return joined.mapInArrow(cut, schema).select("all.*", *new)
