"""Vectorised words and hashes over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 20
_LONG_WORD = 1 << 16

#: One random 64-bit number for each byte value.
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Byte values with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP = _powers(_BASE, _BLOCK + _LONG_WORD + 1)
DOWN = _powers(_INVERSE, _BLOCK + _LONG_WORD + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole number."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one kind (0: no word) that stay within one text."""
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(kinds) + 1, bool)
    change[1:-1] = kinds[1:] != kinds[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    word = kinds[edges[:-1]] > 0
    return edges[:-1][word], edges[1:][word]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span; ``fold`` maps byte values first. Spans must be sorted and disjoint."""
    out = np.empty(len(starts), np.uint64)
    values = VALUES if fold is None else VALUES[fold]
    long = np.flatnonzero(ends - starts > _LONG_WORD)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
        if len(long) and (i := np.searchsorted(long, at)) < len(long) and long[i] < stop:
            stop = max(int(long[i]), at)
        if stop == at:  # one very long word: hashed piece by piece
            h = np.uint64(0)
            for s in range(int(starts[at]), int(ends[at]), _BLOCK):
                piece = values[data[s : min(s + _BLOCK, int(ends[at]))]]
                h = mix(np.array([h + (piece * UP[: len(piece)]).sum(dtype=np.uint64)]))[0]
            out[at] = h
            at += 1
            continue
        first, last = int(starts[at]), int(ends[stop - 1])
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(values[data[first:last]] * UP[: last - first], out=sums[1:])
        s, e = starts[at:stop] - first, ends[at:stop] - first
        out[at:stop] = (sums[e] - sums[s]) * DOWN[s]
        at = stop
    return mix(out + (ends - starts).astype(np.uint64))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence from the hashes of its members."""
    h = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        h = mix(h * _BASE + part)
    return h


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that holds each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def flat_words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the text of each; ``kinds`` gives the word kind of every byte value."""
    starts, ends = spans(kinds[data], offsets)
    return span_hashes(data, starts, ends, fold), rows_of(starts, offsets)
