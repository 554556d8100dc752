import random
import re

import numpy as np
import pytest

from tablewright.llm import minhash
from tablewright.llm.components import components
from tablewright.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, size=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(FOLD))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_force(docs, percent=85):
    sets = {k: shingles(t) for k, t in docs}
    label = {k: k for k in sets}
    keys = sorted(sets)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {k: (len(sets[k]), label[k], label[k] == k) for k in keys}


def documents():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = [None, "", " \n\t", "one", "ONE", "one two", "One  two", "Éa b c", "éa b c", " ", "x " * 5000, "X " * 400]
    for _ in range(8):
        base = say(rng.randint(20, 200))
        docs.append(" ".join(base))
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [docs[20]] * 15 + [" ".join(say(60)) for _ in range(20)]
    return list(enumerate(docs))


@pytest.mark.parametrize("node", [minhash.NODE_DOCS, 4])
def test_query_against_brute_force(spark, write_tables, monkeypatch, node):
    monkeypatch.setattr(minhash, "NODE_DOCS", node)
    docs = documents()
    folder = write_tables(documents=([(k, t, None, "s", 0) for k, t in docs], DOCS))
    rows = QUERIES["op8_minhash_near_dedup"](spark, folder).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_force(docs)


def test_blocks_compare_every_pair(spark, write_tables, monkeypatch):
    monkeypatch.setattr(minhash, "NODE_DOCS", 3)
    monkeypatch.setattr(minhash, "LEVELS", 1)
    docs = documents()[:60]
    folder = write_tables(documents=([(k, t, None, "s", 0) for k, t in docs], DOCS))
    rows = QUERIES["op8_minhash_near_dedup"](spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_force(docs)


def test_empty_table(spark, write_tables):
    folder = write_tables(documents=([], DOCS))
    assert QUERIES["op8_minhash_near_dedup"](spark, folder).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (100, 90), (60, 61), (500, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90, 60: 60, 61: 60, 500: 60}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_at_the_bound_and_minwise_estimates():
    a, b = np.arange(1, 101, dtype=np.uint64), np.arange(9, 101, dtype=np.uint64)
    assert minhash.confirmed_links(np.array([4, 9]), [a, b], 92) == [(9, 4)]
    assert minhash.confirmed_links(np.array([4, 9]), [a, b], 93) == []


def near_pair(rng, n, changed, name):
    """Two texts of ``n`` words that differ in the last ``changed`` ones."""
    base = [f"{name}{rng.randrange(10**9)}" for _ in range(n)]
    return " ".join(base), " ".join(base[: n - changed] + [f"{name}x{i}" for i in range(changed)])


@pytest.mark.parametrize("node", [minhash.NODE_DOCS, 32])
def test_links_that_every_tree_misses(spark, monkeypatch, node):
    monkeypatch.setattr(minhash, "NODE_DOCS", node)
    monkeypatch.setattr(minhash, "_likely", lambda tokens, least: np.zeros(len(tokens), bool))
    docs = documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = minhash.near_duplicates(frame, size=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_force(docs)


def test_links_among_unlinked_documents_that_share_much(spark, monkeypatch):
    """A passage makes up most of each text; only planted pairs are near copies."""
    monkeypatch.setattr(minhash, "NODE_DOCS", 16)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(70))
    docs = [(i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(32))) for i in range(1200)]
    for i in range(1200, 1400, 2):
        one, other = near_pair(rng, 40, 9, f"n{i}")
        docs += [(i, f"{passage} {one}"), (i + 1, f"{passage} {other}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = minhash.near_duplicates(frame, size=3, percent=80).collect()
    found = {r.doc_id: r.component_id for r in rows}
    assert found == {k: k - 1 if k > 1200 and k % 2 else k for k, _ in docs}


def test_prefixes_and_parities_lose_no_link():
    rng = np.random.default_rng(4)
    classes = rng.integers(0, 4, 1 << minhash.SLOT_BITS).astype(np.uint8)
    for percent in (50, 80, 85):
        for _ in range(200):
            n = int(rng.integers(1, 120)) if rng.random() < 0.8 else int(rng.integers(900, 1_200))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: len(a) - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < percent * (len(a) + len(b) - common) or np.array_equal(a, b):
                continue
            first, ends, _ = minhash.prefixes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), classes, percent)
            left, right = first[: ends[1]].tolist(), first[ends[1] :].tolist()
            shared = next(h for h in left if h in right)
            places = np.array([left.index(shared), right.index(shared)])
            for whole in (False, True):
                maps = minhash.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), whole)
                assert minhash.possible(np.array([len(a), len(b)]), places, np.array([1, 2]), maps, percent).all()
