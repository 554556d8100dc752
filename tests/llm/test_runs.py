import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tablewright.llm import runs
from tablewright.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_force(words, least=12):
    """All runs (start, length, period) by extending every equal pair q apart."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, 2 * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(rng):
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 200, ["a", "b"] * 40, ["a", "b", "c"] * 7 + ["x"] + ["a", "b", "c"] * 9]
    for _ in range(120):
        words, letters = [], rng.choice(["ab", "abc", "abcdefghij", "ab" * 3 + "cdefg"])
        while len(words) < rng.randint(0, 150):
            piece = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
            words += piece * rng.choice([1, 1, 1, 2, 3, 5])
        out.append(words)
    return out


def test_runs_of_against_brute_force(monkeypatch):
    rng = random.Random(5)
    for pairs in (1 << 20, 50):
        monkeypatch.setattr(runs, "GRID_PAIRS", pairs)
        docs = texts(rng)
        flat = np.array([hash(w) for d in docs for w in d], np.int64)
        t, s, n, q = runs.runs_of(flat, np.array([len(d) for d in docs]))
        got = list(zip(t.tolist(), s.tolist(), n.tolist(), q.tolist()))
        want = [(i, *r) for i, d in enumerate(docs) for r in brute_force(d)]
        assert got == sorted(want, key=lambda r: (r[0], r[1], r[3]))
    assert all(len(x) == 0 for x in runs.runs_of(np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_extensions_by_the_cover():
    rng = np.random.default_rng(3)
    assert {(a - b) % runs.BLOCK for a in runs.COVER for b in runs.COVER} == set(range(runs.BLOCK))
    for kinds, n in ((1, 400), (2, 400), (3, 90), (2, 1), (2, 17)):
        words = np.append(rng.integers(0, kinds, n), kinds)
        words[n // 3 : n // 3 + 40] = words[:40][: len(words[n // 3 : n // 3 + 40])]
        words[n] = kinds
        index = runs.CoverIndex(words, n)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        a, b = a[a != b], b[a != b]
        if not len(a):
            continue
        got = index.extension(a, b)
        for x, y, length in list(zip(a.tolist(), b.tolist(), got.tolist()))[:: max(1, len(a) // 5000)]:
            want = 0
            while max(x, y) + want < len(words) and words[x + want] == words[y + want]:
                want += 1
            assert length == want


def test_long_periods_and_long_texts():
    rng = random.Random(8)
    half = [rng.randint(0, 5000) for _ in range(30_000)]
    words = half + half + half[:7] + [-1] + [1, 2] * 20_000
    t, s, n, q = runs.runs_of(np.array(words, np.int64), np.array([len(words)]))
    assert (0, 60_007, 30_000) in list(zip(s.tolist(), n.tolist(), q.tolist()))
    assert (40_000, 2) == (int(n[-1]), int(q[-1]))


def rebuilt(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(text):
    return sha256(text.encode()).hexdigest()


def test_query_against_brute_force(spark, write_tables):
    rng = random.Random(2)
    docs = [(k, " \t\n".join(["", *w]) if k % 3 else " ".join(w)) for k, w in enumerate(texts(rng))]
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, "é ü " * 30), (1003, "é ü " * 30), (1004, "w " * 5000)]
    folder = write_tables(documents=([(k, t, None, "s", 0) for k, t in docs], DOCS))
    rows = QUERIES["op12_periodic_runs"](spark, folder).collect()
    want = []
    for k, text in docs:
        words = rebuilt(k, [w.decode() for w in (text or "").encode().split()])
        found = brute_force(words)
        found.sort(key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = best[1] * 1000 // best[2] if found else None
        text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((k, len(found), *best, milli, digest(text), digest(collapsed(words, found))))
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows]
    assert sorted(got) == sorted(want) or sorted(got, key=str) == sorted(want, key=str)


def test_columns_are_kept(spark):
    df = spark.createDataFrame([(None, "a b " * 9, "r", 1.5, "t")], "doc_id long, text string, runs string, `all` double, `key` string")
    row = runs.find_runs(df).first()
    assert row.asDict(True) == {
        "doc_id": None, "text": "a b " * 9, "all": 1.5, "key": "t", "n_words": 18, "collapsed": "a b",
        "runs": [{"start": 0, "length": 18, "period": 2}],
    }
    assert runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(3, np.int64), np.array([3]), least=2)
