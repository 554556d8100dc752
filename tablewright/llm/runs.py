"""Periodic runs of words by a difference-cover index and a harmonic grid.

A run is a stretch of words with smallest period q, of ``max(least, 2 * q)`` words or more, that no
neighbouring word extends. Texts are independent, so each task works on slices of its own texts, with
all texts of a slice in one array of word numbers, each followed by a separator that occurs once:

1. harmonic grid: for every period q the places 0, q, 2q, ... of a text. A run of period q holds two
   neighbouring grid places i and i + q, and around i the words q apart agree on a stretch of q words
   at least; as ``least`` words are needed too, three of them in a row lie right after i or right before.
   Grid pairs without such three words are left at once (n log n pairs, two comparisons each);
2. the others ask for the longest common extension to the right, and to the left in the reversed array.
   For that only suffixes at places of a difference cover modulo 16 are sorted: by blocks of 16 words,
   then by doubling, for a suffix 16 words on is sampled as well. Any two places reach two sampled ones
   in the same few steps; these words are compared, and from there the least common prefix between the
   two ranks, from a sparse table of minima, and the words of the last block give the rest;
3. extensions of q words or more give the run; of one stretch the smallest period counts.

Memory follows the longest text, not the number of texts: about 250 bytes a word while it is indexed.

Defined cases: a null or empty text, or one of blanks, has no words and no runs. Rows are independent,
so repeated rows and ties of keys do not matter; a null key is kept. Words are compared by a 64-bit hash.
All other columns are kept; columns named ``n_words``, ``runs`` or ``collapsed`` are replaced. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import column
from tablewright.llm.bytetext import flat_words
from tablewright.llm.common import flat_bytes, slices

LEAST = 12
#: The differences of the cover's members, modulo BLOCK, are all of 0 to BLOCK - 1.
BLOCK = 16
COVER = (0, 1, 2, 5, 8)
#: Grid pairs that are looked at in one go.
GRID_PAIRS = 1 << 20
_WORD = np.ones(256, np.int8)
_WORD[[32, *range(9, 14)]] = 0


def _steps_to_cover() -> np.ndarray:
    """How far to go from places with remainders a and b until both are sampled."""
    return np.array(
        [[next(d for d in range(BLOCK) if (a + d) % BLOCK in COVER and (b + d) % BLOCK in COVER) for b in range(BLOCK)] for a in range(BLOCK)],
        np.int64,
    )


_STEPS = _steps_to_cover()


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers 0, 1, ... in the order of the values, and how many there are."""
    found, number = np.unique(values, return_inverse=True)
    return number.astype(np.int64), len(found)


class CoverIndex:
    """Longest common extensions in an array of dense numbers, by the sorted suffixes of a cover.

    Every stretch that is compared must end at a number that occurs once, as texts do here.
    """

    def __init__(self, words: np.ndarray, longest: int) -> None:
        n = len(words)
        self.padded = np.concatenate([words, words.max(initial=0) + 1 + np.arange(2 * BLOCK)])
        size = int(self.padded.max()) + 1
        places = np.flatnonzero(np.isin(np.arange(n) % BLOCK, COVER))
        self.slot = np.full(n + BLOCK, -1, np.int64)
        self.slot[places] = np.arange(len(places))
        # First order by blocks, as many words at a time as fit into a number.
        rank, kinds = self.padded[places], size
        for i in range(1, BLOCK):
            if kinds * size >= 1 << 62:
                rank, kinds = _dense(rank)
            rank = rank * size + self.padded[places + i]
            kinds *= size
        rank, kinds = _dense(rank)
        levels, width = [], BLOCK
        while True:
            levels.append((width, rank))
            if kinds == len(places) or width > longest + BLOCK:
                break
            after = np.full(len(places), -1, np.int64)
            inside = places + width < n
            after[inside] = rank[self.slot[places[inside] + width]]
            rank, kinds = _dense(rank * (len(places) + 1) + after + 1)
            width *= 2
        self.rank = rank
        order = np.argsort(rank, kind="stable")
        # Common blocks of neighbours in that order, from the widest equal level down.
        a, b = places[order[:-1]], places[order[1:]]
        shared = np.zeros(len(a), np.int64)
        for width, ranks in reversed(levels):
            x, y = a + shared, b + shared
            inside = (x < n) & (y < n)
            equal = np.zeros(len(a), bool)
            equal[inside] = ranks[self.slot[x[inside]]] == ranks[self.slot[y[inside]]]
            shared[equal] += width
        self.minima = [shared.astype(np.int32)]
        while 2 << (len(self.minima) - 1) <= len(shared):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words after two places, up to ``most``, which is at most a block."""
        length, going = np.zeros(len(a), np.int64), np.arange(len(a))
        for step in range(BLOCK):
            going = going[most[going] > step]
            going = going[self.padded[a[going] + step] == self.padded[b[going] + step]]
            if not len(going):
                break
            length[going] += 1
        return length

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``, places that differ."""
        step = _STEPS[a % BLOCK, b % BLOCK]
        length = self._agree(a, b, step)
        go = np.flatnonzero(length == step)
        x, y = a[go] + step[go], b[go] + step[go]
        inside = np.maximum(x, y) < len(self.slot) - BLOCK
        go, x, y = go[inside], x[inside], y[inside]
        p, q = self.rank[self.slot[x]], self.rank[self.slot[y]]
        low, high = np.minimum(p, q), np.maximum(p, q)
        level = np.zeros(len(low), np.int64)
        span = high - low
        level[span > 0] = np.log2(span[span > 0]).astype(np.int64)
        shared = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.minima[k]
            shared[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        rest = self._agree(x + shared, y + shared, np.full(len(x), BLOCK))
        length[go] += shared + rest
        return length


def _grid(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs (text, period, place) of all texts, in blocks of about ``GRID_PAIRS`` pairs."""
    periods = sizes // 2
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = (sizes[text] - 1) // period
    total = np.cumsum(pairs)
    cuts = np.searchsorted(total, np.arange(GRID_PAIRS, int(total[-1]) + GRID_PAIRS, GRID_PAIRS)) if len(total) else []
    first = 0
    for stop in [*(np.asarray(cuts) + 1).tolist()]:
        stop = min(stop, len(text))
        if stop <= first:
            continue
        n = pairs[first:stop]
        which = np.repeat(np.arange(first, stop), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        yield text[which], period[which], starts[text[which]] + step * period[which]
        first = stop


def _triples(words: np.ndarray, kinds: int) -> np.ndarray:
    """Number of the three words that start at each place; ``words`` must have two more at the end."""
    if kinds < 1 << 20:
        return (words[:-2] * kinds + words[1:-1]) * kinds + words[2:]
    two, n = _dense(words[:-1] * kinds + words[1:])
    return two[:-1] * kinds + words[2:]


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (text, start, length, period), ordered by text, start and period.

    ``words`` holds the word hashes of all texts one after another, ``sizes`` the number of each.
    """
    if least < 6:
        raise ValueError("runs need six words at least")
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.asarray(sizes, np.int64)
    number, kinds = _dense(words)
    count = len(sizes)
    # Three separators around every text, each of its own.
    text = np.repeat(np.arange(count), sizes)
    starts = 3 + np.cumsum(sizes + 3) - (sizes + 3)
    flat = kinds + np.arange(3 + int(sizes.sum()) + 3 * count)
    inner = np.cumsum(sizes) - sizes
    flat[starts[text] + np.arange(len(number)) - inner[text]] = number
    flat = _dense(flat)[0]
    kinds = int(flat.max()) + 1
    triple = _triples(np.concatenate([flat, [kinds, kinds + 1]]), kinds + 2)
    long = np.where(sizes >= least, sizes, 0)
    texts, periods, places = [], [], []
    for t, q, i in _grid(long, starts):
        equal = flat[i] == flat[i + q]
        right = equal & (triple[i] == triple[i + q])
        left = triple[i - 3] == triple[i + q - 3]
        found = right | left
        texts.append(t[found])
        periods.append(q[found])
        places.append(i[found])
    if not texts or not sum(map(len, texts)):
        return none
    t, q, i = (np.concatenate(c) for c in (texts, periods, places))
    # Only texts with such pairs are indexed.
    alive = np.unique(t)
    spot = np.zeros(count, np.int64)
    room = sizes[alive] + 1
    spot[alive] = np.cumsum(room) - room
    which = np.repeat(alive, room)
    step = np.arange(int(room.sum())) - spot[which]
    part = _dense(flat[starts[which] + step])[0]
    i += spot[t] - starts[t]
    longest, n = int(sizes[alive].max()), len(part)
    ahead = CoverIndex(part, longest).extension(i, i + q)
    # Reversed and without the last separator, whose place the start of the next text takes.
    turned = np.concatenate([part[:-1][::-1], [int(part.max()) + 1]])
    back = np.zeros(len(i), np.int64)
    some = np.flatnonzero(i > 0)
    back[some] = CoverIndex(turned, longest).extension(n - 1 - i[some], n - 1 - i[some] - q[some])
    good = (ahead + back >= q) & (ahead + back + q >= least)
    t, q, start, length = t[good], q[good], (i - back - spot[t])[good], (ahead + back + q)[good]
    order = np.lexsort((q, length, start, t))
    t, q, start, length = t[order], q[order], start[order], length[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    t, q, start, length = t[new], q[new], start[new], length[new]
    order = np.lexsort((q, start, t))
    return t[order], start[order], length[order], q[order]


Rewrite = Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]]


def find_runs(
    docs: DataFrame, text: str = "text", least: int = LEAST, key: str | None = None, rewrite: Rewrite | None = None
) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period) and ``collapsed``.

    ``collapsed`` joins by one space the words that no run contains after its first period. With
    ``rewrite``, words are changed first: it gets the keys and the word counts of a batch and returns
    for each text where its periodic tail begins (its word count for none) and the tail's period.
    """
    new = ("n_words", "runs", "collapsed")
    whole = F.struct(*(column(c) for c in docs.columns if c not in new))
    named = column(key) if key else F.lit(None)
    held = docs.select(column(text).cast("string").alias("text"), named.alias("key"), whole.alias("all"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def of_slice(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat_bytes(part.column(0))
        raw = [(x or "").encode().split() for x in part.column(0).to_pylist()]
        sizes = np.array([len(x) for x in raw], np.int64)
        words = flat_words(data, offsets, _WORD)[0]
        first = np.cumsum(sizes) - sizes
        if rewrite:
            tail, period = rewrite(part.column(1), sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(words)) - first[owner]
            over = place - tail[owner]
            source = np.where(over >= 0, tail[owner] + over % period[owner], place)
            words = words[first[owner] + source]
        t, start, length, q = runs_of(words, sizes, least)
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, first[t] + start + q, 1)
        np.add.at(gone, first[t] + start + length, -1)
        kept = np.cumsum(gone)[:-1] == 0
        changed = np.zeros(len(sizes), bool)
        changed[t] = True
        if rewrite:
            changed |= tail < sizes
        texts = []
        for row, own in enumerate(raw):
            if changed[row]:
                at = slice(int(first[row]), int(first[row] + sizes[row]))
                index = source[at][kept[at]] if rewrite else np.flatnonzero(kept[at])
                own = [own[x] for x in index.tolist()]
            texts.append(b" ".join(own))
        bounds = np.searchsorted(t, np.arange(len(sizes) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(q, pa.int64())], names=["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, type=kind)
        collapsed = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([part.column(2), pa.array(sizes, pa.int64()), listed, collapsed], names=["all", *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield of_slice(part)

    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    schema = T.StructType(
        [held.schema["all"], T.StructField(new[0], T.LongType()), T.StructField(new[1], run_type), T.StructField(new[2], T.StringType())]
    )
    return held.mapInArrow(run, schema).select("all.*", *new)
