"""Repeated passages by a distributed merge sort of sparse suffixes.

Bytes are removed that lie in a string of ``length`` bytes which starts anywhere else too. Every such
string holds an anchor: the leftmost of its grams with the smallest hash. Equal strings have the same
anchor, so only the suffixes that start at anchors are sorted, each with the bytes before it:

1. anchors of all texts, with the range of strings that each one stands for (about one in 150 bytes);
2. anchors whose gram occurs once are left: none of their strings can repeat;
3. each task sorts the suffixes of its anchors, writes them front-coded (length of the prefix shared
   with the one before, then the rest) and cut into ranges; equal suffixes are one entry with a count;
4. each range is merged with a loser tree that compares two suffixes only beyond the prefix they are
   known to share; neighbours in the sorted order and the bytes before them show which strings repeat;
5. the strings go back to the texts through the places of their anchors.

A gram with more than ``HOT_CONTEXTS`` different surroundings would make one range grow without bound.
Its strings are counted by 128-bit digests instead, which spread over all tasks.

Defined cases: null counts as empty; texts shorter than ``length`` keep all their bytes; matches never
cross texts; overlapping occurrences in one text count; all repeats are judged on the input. ``key`` must
be unique, but a repeated row counts as a copy of the other; a row without a key is known by a hash of
its text (a number below -2^62, where no keys may lie), so it is searched and cut like any other. All
other columns are kept, whatever their names; those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import column, quoted
from tablewright.llm.bytetext import DOWN, UP, VALUES, mix, rows_of
from tablewright.llm.common import drop_stage, flat_bytes, groups_in_order, slices, stage

LENGTH = 400
#: Different surroundings of one gram up to which its suffixes are merged in one range.
HOT_CONTEXTS = 2_000
#: Anchors per range, most ranges, and bytes that a task holds before it writes a run.
RANGE_ANCHORS = 20_000
MOST_RANGES = 4_096
RUN_BYTES = 24 << 20
_CHUNK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)


def gram_of(length: int) -> int:
    """Length of the grams that anchors are chosen by."""
    return max(1, length // 4)


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Anchors of texts in one buffer: text, place, first and last string start, gram, context, head.

    Places are counted within the text. A very long text is handled in chunks; an anchor may then
    come twice with adjacent ranges of strings.
    """
    gram = gram_of(length)
    width = length - gram + 1
    found: list[dict[str, np.ndarray]] = []
    for first in range(0, max(0, len(data) - length + 1), _CHUNK):
        part = data[first : first + _CHUNK + length - 1]
        n = len(part) - length + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUES[part] * UP[: len(part)], out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * DOWN[: len(part) - gram + 1])
        ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        padded = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(ranked)] = ranked
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        starts = np.arange(n)
        owner = rows_of(starts + first, offsets)
        whole = starts + first + length <= offsets[owner + 1]
        starts, owner, at = starts[whole], owner[whole], (least[whole] & _PLACE).astype(np.int64)
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
        low = np.flatnonzero(new)
        high = np.append(low[1:], len(starts)) - 1
        p, lo, hi, text = at[low], starts[low], starts[high], owner[low]
        context = mix((sums[hi + length] - sums[lo]) * DOWN[lo] + (p - lo).astype(np.uint64) * np.uint64(1_000_003) + (hi - lo).astype(np.uint64))
        head = np.zeros(len(p), np.uint64)
        for i in range(7):  # 56 bits, so that heads order like the bytes and stay positive
            byte = part[p + i].astype(np.uint64) if gram > i else np.uint64(0)
            head = (head << np.uint64(8)) | byte
        back = first - offsets[text]
        found.append(
            {"text": text, "p": p + back, "lo": lo + back, "hi": hi + back, "gram": grams[p].view(np.int64),
             "context": context.view(np.int64), "head": head.astype(np.int64)}
        )
    names = ("text", "p", "lo", "hi", "gram", "context", "head")
    return {k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in names}


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Rows (key, p, lo, hi, gram, context, head) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = anchors_of(*flat_bytes(part.column(1)), length)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                columns = [pa.array(keys[found["text"]], pa.int64())]
                columns += [pa.array(found[c], pa.int32()) for c in ("p", "lo", "hi")]
                columns += [pa.array(found[c], pa.int64()) for c in ("gram", "context", "head")]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "p", "lo", "hi", "gram", "context", "head"])

    return docs.mapInArrow(run, "key long, p int, lo int, hi int, gram long, context long, head long")


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that are known to agree up to ``start``."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    different = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (different.bit_length() + 7) // 8


Entry = tuple[bytes, bytes, int, bytes]
_ENTRY = struct.Struct("<HHHI16s")


def front_code(entries: list[Entry]) -> bytes:
    """Sorted entries (suffix, bytes before it reversed, count, context id) as one block."""
    out, last = [], b""
    for suffix, before, count, name in entries:
        shared = common_prefix(last, suffix)
        out += (_ENTRY.pack(shared, len(suffix) - shared, len(before), min(count, 2), name), suffix[shared:], before)
        last = suffix
    return b"".join(out)


def read_run(block: bytes) -> Iterator[tuple[int, Entry]]:
    """Entries of a block, each with the length of the prefix that it shares with the one before."""
    at, last = 0, b""
    while at < len(block):
        shared, rest, before, count, name = _ENTRY.unpack_from(block, at)
        at += _ENTRY.size
        last = last[:shared] + block[at : at + rest]
        at += rest
        yield shared, (last, block[at : at + before], count, name)
        at += before


class LoserTree:
    """Merges sorted runs; each waiting entry knows the prefix it shares with the last one given out.

    Of two entries the one that shares more with the last is smaller and needs no look at its bytes;
    only equal lengths are compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, Entry]]]) -> None:
        self.runs, self.count = runs, len(runs)
        self.entry: list[Entry | None] = [None] * self.count
        self.shared = [0] * self.count
        for i in range(self.count):
            self._advance(i)
        self.losers = [-1] * self.count
        self.winner = -1
        for i in range(self.count):
            self._play(i)

    def _advance(self, i: int) -> None:
        shared, entry = next(self.runs[i], (0, None))
        self.shared[i], self.entry[i] = shared, entry

    def _first(self, i: int, j: int) -> bool:
        a, b = self.entry[i], self.entry[j]
        if a is None or b is None:
            return b is None
        x, y = self.shared[i], self.shared[j]
        if x != y:
            return x > y
        shared = common_prefix(a[0], b[0], x)
        ahead = a[:2] <= b[:2] if shared == len(a[0]) == len(b[0]) else a[0][shared:] < b[0][shared:]
        self.shared[j if ahead else i] = shared
        return ahead

    def _play(self, i: int) -> None:
        node = (i + self.count) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # still building: wait for the other side
                self.losers[node] = i
                return
            if self._first(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple[int, Entry]]:
        """Entries in order, each with the prefix length shared with the one before."""
        while self.entry[self.winner] is not None:
            i = self.winner
            yield self.shared[i], self.entry[i]
            self._advance(i)
            self._play(i)


def repeated(group: list[tuple[int, Entry]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """Repeats in a group of entries with one gram: (context id, smallest and largest distance).

    A string is named by its distance: how far before the anchor it starts. Two entries share it if
    their suffixes agree on ``length - distance`` bytes and the bytes before on ``distance``.
    """
    merged: list[tuple[int, Entry]] = []
    for shared, entry in group:
        if merged and merged[-1][1][:2] == entry[:2]:
            low, (suffix, before, count, name) = merged[-1]
            merged[-1] = low, (suffix, before, count + entry[2], name)
        else:
            merged.append((shared, entry))
    alone = []
    for _, (suffix, before, count, name) in merged:
        if count > 1:
            yield name, length - len(suffix), len(before)
        alone.append(count < 2)
    if len(merged) < 2 or not any(alone):
        return
    if len(merged) == 2:
        (_, a), (shared, b) = merged
        low = length - min(shared, len(a[0]), len(b[0]))
        high = min(common_prefix(a[1], b[1]), len(a[1]), len(b[1]))
        if low <= high:
            for (_, entry), single in zip(merged, alone):
                if single:
                    yield entry[3], low, high
        return
    n, most = len(merged), max(len(e[1]) for _, e in merged)
    before = np.zeros((n, most), np.uint8)
    for i, (_, e) in enumerate(merged):
        before[i, : len(e[1])] = np.frombuffer(e[1], np.uint8)
    keys = np.zeros((n, most + 1), np.uint64)
    np.cumsum(VALUES[before] * UP[:most], axis=1, out=keys[:, 1:])
    distance = np.arange(most + 1)
    shared = np.array([0] + [s for s, _ in merged[1:]])
    block = (shared[:, None] < length - distance).cumsum(axis=0).astype(np.uint64)
    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + block)
    sizes = np.array([(len(e[0]), len(e[1])) for _, e in merged])
    valid = (distance >= length - sizes[:, :1]) & (distance <= sizes[:, 1:])
    # What is no string of its anchor gets a key of its own.
    keys = np.where(valid, keys, mix(np.arange(keys.size, dtype=np.uint64).reshape(keys.shape) + np.uint64(1 << 60)))
    order = np.argsort(keys, axis=0, kind="stable")
    ranked = np.take_along_axis(keys, order, axis=0)
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros_like(valid)
    twice[1:] |= equal
    twice[:-1] |= equal
    again = np.zeros_like(valid)
    np.put_along_axis(again, order, twice, axis=0)
    again &= valid
    for i in np.flatnonzero(np.array(alone) & again.any(axis=1)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], again[i].view(np.int8), [0]])))
        for low, high in edges.reshape(-1, 2):
            yield merged[i][1][3], int(low), int(high) - 1


def merge_range(blocks: list[bytes], length: int) -> Iterator[tuple[bytes, int, int]]:
    """All repeats of one range, from its front-coded runs."""
    gram, group = gram_of(length), []
    for shared, entry in LoserTree([read_run(b) for b in blocks]):
        if group and shared < gram:
            yield from repeated(group, length)
            group = []
        group.append((shared, entry))
    if group:
        yield from repeated(group, length)


_RUNS = "range int, run binary, name binary, keys array<long>, places array<int>, digest binary, distance int, times int"


class _RunWriter:
    """Collects the contexts of a task; gives out runs per range, places, and digests of hot grams."""

    def __init__(self, length: int, cuts: np.ndarray) -> None:
        self.length, self.cuts = length, cuts
        self.clear()

    def clear(self) -> None:
        self.held: dict[tuple[bytes, bytes], tuple[list[int], list[int]]] = {}
        self.range_of: dict[tuple[bytes, bytes], int] = {}
        self.bytes = 0

    def add(self, key: int, data: bytes, marks: dict[str, np.ndarray]) -> None:
        ranges = np.where(marks["hot"], -1, np.searchsorted(self.cuts, marks["head"], side="right")).tolist()
        for p, lo, hi, place in zip(marks["p"].tolist(), marks["lo"].tolist(), marks["hi"].tolist(), ranges):
            context = data[p : hi + self.length], data[lo:p][::-1]
            known = self.held.get(context)
            if known is None:
                known = self.held[context] = ([], [])
                self.range_of[context] = place
                self.bytes += len(context[0]) + len(context[1]) + 400
            known[0].append(key)
            known[1].append(p)
            self.bytes += 16

    def rows(self) -> Iterator[dict]:
        by_range: dict[int, list[Entry]] = {}
        for context, (keys, places) in self.held.items():
            suffix, before = context
            name = hashlib.blake2b(struct.pack("<I", len(before)) + before + suffix, digest_size=16).digest()
            yield {"name": name, "keys": keys, "places": places}
            if self.range_of[context] >= 0:
                by_range.setdefault(self.range_of[context], []).append((suffix, before, len(keys), name))
                continue
            whole = before[::-1] + suffix
            for start in range(len(whole) - self.length + 1):
                digest = hashlib.blake2b(whole[start : start + self.length], digest_size=16).digest()
                yield {"name": name, "digest": digest, "distance": len(before) - start, "times": min(len(keys), 2)}
        for place, entries in by_range.items():
            entries.sort()
            yield {"range": place, "run": front_code(entries)}
        self.clear()


def _runs(marked: DataFrame, length: int, cuts: np.ndarray) -> DataFrame:
    names = [c.split()[0] for c in _RUNS.split(", ")]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.int32()]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    def flush(writer: _RunWriter) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for row in writer.rows():
            rows.append(row)
            if len(rows) >= 5_000 or "run" in row:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _RunWriter(length, cuts)
        for batch in batches:
            for key, text, marks in zip(*(batch.column(i) for i in range(3))):
                marks = marks.values.flatten()
                part = {n: marks[i].to_numpy(zero_copy_only=False) for i, n in enumerate(("p", "lo", "hi", "hot", "head"))}
                writer.add(key.as_py(), text.as_py().encode(), part)
                if writer.bytes > RUN_BYTES:
                    yield from flush(writer)
        yield from flush(writer)

    return marked.mapInArrow(run, _RUNS)


def _merged(runs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, "range"):
            found = list(merge_range(group.column("run").to_pylist(), length))
            if found:
                names, low, high = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["name", "low", "high"]
                )

    dealt = runs.filter("range is not null").select("range", "run").repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "name binary, low int, high int")


def removed_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that intervals cover; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans, kept and kept_text.

    ``spans`` lists the maximal removed runs as (start, end) bytes, ``kept`` holds the other bytes, and
    ``kept_text`` their text, without what a cut leaves of a character.
    """
    spark = docs.sparkSession
    new = ("n_bytes", "n_removed", "spans", "kept", "kept_text")
    others = [c for c in docs.columns if c not in (text, *new)]
    nameless = F.pmod(F.xxhash64(column(text)), F.lit(1 << 62)) - F.lit(1 << 62) - F.lit(1 << 62)
    known = F.coalesce(column(key).cast("long"), nameless).alias("key")
    texts = docs.select(known, column(text).alias("text"))
    marks = stage(anchors(texts, length), "suffix-anchors")
    grams = marks.groupBy("gram", "context").agg(F.count("*").alias("times")).groupBy("gram").agg(
        F.sum("times").alias("times"), (F.count("*") > HOT_CONTEXTS).alias("hot")
    )
    # Written first, so that the join has a shuffle on both sides and a frequent gram can be split.
    grams = stage(grams.filter("times > 1").select("gram", "hot"), "suffix-grams")
    shared = marks.join(grams, "gram").select("key", "p", "lo", "hi", "hot", "head")
    shared = stage(shared, "suffix-shared")
    total = shared.filter("not hot").count()
    ranges = max(1, min(MOST_RANGES, -(-total // RANGE_ANCHORS)))
    cuts: list[int] = []
    if ranges > 1:
        places = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(shared.filter("not hot").agg(F.percentile_approx("head", places, 20 * ranges)).first()[0]))
    by_text = shared.groupBy("key").agg(F.collect_list(F.struct("p", "lo", "hi", "hot", "head")).alias("marks"))
    marked = texts.join(by_text, "key").select("key", "text", "marks")
    runs = stage(_runs(marked, length, np.array(cuts, np.int64)), "suffix-runs")
    digests = runs.filter("digest is not null").select("digest", "name", "distance", "times")
    twice = digests.groupBy("digest").agg(F.sum("times").alias("seen")).filter("seen > 1")
    hot = digests.join(twice, "digest").select("name", F.col("distance").alias("low"), F.col("distance").alias("high"))
    repeats = _merged(runs, length).unionByName(hot).groupBy("name").agg(F.collect_set(F.struct("low", "high")).alias("strings"))
    places = runs.filter("keys is not null").select("name", F.arrays_zip("keys", "places").alias("at"))
    spans = (
        places.join(repeats, "name")
        .select(F.explode("at").alias("at"), "strings")
        .select(F.col("at.keys").alias("key"), F.transform("strings", lambda s: F.struct(
            (F.col("at.places") - s.high).alias("start"), (F.col("at.places") - s.low + length).alias("end"))).alias("part"))
        .groupBy("key")
        .agg(F.flatten(F.collect_list("part")).alias("found"))
    )
    spans = stage(spans, "suffix-spans")
    for old in (marks, grams, shared, runs):
        drop_stage(spark, old)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for value, found in zip(part.column(1).to_pylist(), part.column(2)):
                    data = (value or "").encode()
                    if not found.is_valid:
                        rows.append((len(data), 0, [], data, value or ""))
                        continue
                    start, end = (c.to_numpy().astype(np.int64) for c in found.values.flatten())
                    start, end = removed_runs(start, end)
                    edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    spans = [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())]
                    rows.append((len(data), len(data) - len(kept), spans, kept, kept.decode(errors="ignore")))
                n, removed, spans, kept, kept_text = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(3), part.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
                     pa.array(kept_text, pa.string())],
                    names=["all", "text", *new],
                )

    whole = docs.select(known, column(text).alias("text"), F.struct(*map(column, others)).alias("all") if others else F.struct(F.lit(0)).alias("all"))
    joined = whole.join(spans, "key", "left").select("key", "text", "found", "all")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = (T.LongType(), T.LongType(), span, T.BinaryType(), T.StringType())
    schema = T.StructType([joined.schema["all"], joined.schema["text"], *map(T.StructField, new, kinds)])
    done = joined.mapInArrow(cut, schema)
    kept_columns = [F.col("text").alias(c) if c == text else F.col(f"all.{quoted(c)}") for c in docs.columns if c not in new]
    return done.select(*kept_columns, *new)
