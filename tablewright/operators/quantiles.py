"""Exact quantiles of large columns without holding a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.columns import count_if, present

ACCURACY = 10_000
# Values between brackets that one aggregate may gather, for all open ranks together.
BRACKET_LIMIT = 200_000


@dataclass
class _Search:
    """The value at one rank (from 0), known to lie between ``low`` and ``high``."""

    place: int
    rank: int
    low: float
    high: float
    margin: float

    @property
    def cell(self) -> Column:
        return F.col(f"`{self.place}`")

    @property
    def between(self) -> Column:
        return F.when((self.cell > self.low) & (self.cell < self.high), self.cell)

    def sketch(self, share: float) -> list[float]:
        return [max(share - self.margin, 0.0), min(share + self.margin, 1.0)]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], limit: int = BRACKET_LIMIT
) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles per column, or None for a column without values.

    ``percentile`` would gather every distinct value of a column in one task. Instead a sketch
    brackets each wanted rank, one aggregate counts the values below, at and between the ends,
    and only at most ``limit`` values between the ends, of all ranks together, are gathered and
    sorted. A larger rest is bracketed again; each round leaves the ends out, so it always shrinks. All columns share
    each round, and the sketch leaves about one value in five thousand.
    """
    names = list(columns)
    if not names:
        return {}
    values = df.select(*[present(df, n).cast("double").alias(str(i)) for i, n in enumerate(names)])
    margin = 2.0 / ACCURACY
    sums = []
    for i in range(len(names)):
        cell = F.col(f"`{i}`")
        points = [q for p in probabilities for q in (max(p - margin, 0.0), min(p + margin, 1.0))]
        sums += [
            F.count(cell).alias(f"n{i}"),
            F.min(cell).alias(f"lo{i}"),
            F.max(cell).alias(f"hi{i}"),
            F.percentile_approx(cell, points, ACCURACY).alias(f"q{i}"),
        ]
    first = values.agg(*sums).first()
    ends = {i: (first[f"lo{i}"], first[f"hi{i}"]) for i in range(len(names))}
    found: dict[tuple[int, int], float] = {}
    searches = []
    for i in range(len(names)):
        n = first[f"n{i}"]
        for k, p in enumerate(probabilities):
            for rank in _ranks(n, p):
                low, high = first[f"q{i}"][2 * k], first[f"q{i}"][2 * k + 1]
                searches.append(_Search(i, rank, low, high, margin))
    while searches:
        searches = _narrow(values, searches, ends, found, limit)

    def value(i: int, p: float) -> float:
        at = p * (first[f"n{i}"] - 1)
        low, high = (found[(i, rank)] for rank in (math.floor(at), math.ceil(at)))
        return low + (high - low) * (at - math.floor(at))

    return {
        name: [value(i, p) for p in probabilities] if first[f"n{i}"] else None
        for i, name in enumerate(names)
    }


def _ranks(n: int, p: float) -> set[int]:
    return {math.floor(p * (n - 1)), math.ceil(p * (n - 1))} if n else set()


def _narrow(
    values: DataFrame,
    searches: list[_Search],
    ends: dict[int, tuple[float, float]],
    found: dict[tuple[int, int], float],
    limit: int,
) -> list[_Search]:
    """One counting pass for all open searches, then one pass over what is left between the ends."""
    counts = []
    for s, one in enumerate(searches):
        counts += [
            count_if(one.cell < one.low).alias(f"b{s}"),
            count_if(one.cell == one.low).alias(f"l{s}"),
            F.count(one.between).alias(f"i{s}"),
            count_if((one.cell == one.high) & F.lit(one.low != one.high)).alias(f"h{s}"),
        ]
    row = values.agg(*counts).first()
    still: list[_Search] = []
    inner: list[tuple[_Search, int, int]] = []
    for s, one in enumerate(searches):
        at = one.rank - row[f"b{s}"]
        inside = row[f"i{s}"]
        if not 0 <= at < row[f"l{s}"] + inside + row[f"h{s}"]:
            # The sketch missed the rank: start again from the whole range with a wider margin.
            one.low, one.high = ends[one.place]
            one.margin *= 2
            still.append(one)
        elif at < row[f"l{s}"]:
            found[(one.place, one.rank)] = one.low
        elif at >= row[f"l{s}"] + inside:
            found[(one.place, one.rank)] = one.high
        else:
            inner.append((one, at - row[f"l{s}"], inside))
    if not inner:
        return still
    room, gathered = limit, set()
    for s in sorted(range(len(inner)), key=lambda s: inner[s][2]):
        if inner[s][2] <= room:
            gathered.add(s)
            room -= inner[s][2]
    reads = []
    for s, (one, at, inside) in enumerate(inner):
        if s in gathered:
            reads.append(F.get(F.sort_array(F.collect_list(one.between)), F.lit(at)).alias(f"v{s}"))
        else:
            reads.append(F.percentile_approx(one.between, one.sketch((at + 1) / inside), ACCURACY).alias(f"v{s}"))
    row = values.agg(*reads).first()
    for s, (one, _, _) in enumerate(inner):
        if s in gathered:
            found[(one.place, one.rank)] = row[f"v{s}"]
        else:
            one.low, one.high = row[f"v{s}"]
            still.append(one)
    return still
