import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import suffixes
from tablewright.llm.common import flat_bytes
from tablewright.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_force(docs, length):
    data = {k: (t or "").encode() for k, t in docs}
    seen = Counter(d[i : i + length] for d in data.values() for i in range(len(d) - length + 1))
    out = {}
    for k, d in data.items():
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out[k] = (len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def documents(rng, say, n=30):
    passages = [say(rng.randint(10, 90)) for _ in range(5)]
    docs = [None, "", "é" * 9, say(200), say(3), "ab" * 150, "abc" * 40, "z" * 500]
    for _ in range(n):
        parts = [say(rng.randint(0, 40)) if rng.random() < 0.6 else rng.choice(passages)[rng.randint(0, 9) :] for _ in range(5)]
        docs.append("".join(parts))
    docs += [docs[10]] * 4 + [docs[11][1:-1], docs[12][5:] + "é"]
    return list(enumerate(docs))


@pytest.mark.parametrize("length, hot, seed", [(16, 2000, 1), (16, 0, 2), (5, 3, 3), (40, 2, 4)])
def test_against_brute_force(spark, monkeypatch, length, hot, seed):
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffixes, "RANGE_ANCHORS", 40)
    rng = random.Random(seed)
    docs = documents(rng, lambda n: "".join(rng.choice("abcdé ") for _ in range(n)))
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, kept string")
    rows = suffixes.remove_repeats(df, length=length).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert got == brute_force(docs, length) and len(rows) == len(docs)


def test_query_against_brute_force(spark, write_tables):
    rng = random.Random(9)
    words = ["river", "straße", "and", "the", "x", "mill"]
    docs = documents(rng, lambda n: " ".join(rng.choice(words) for _ in range(4 * n)), 12)
    folder = write_tables(documents=([(k, t, None, "s", 0) for k, t in docs], DOCS))
    rows = QUERIES["op4_suffix_dedup"](spark, folder).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_force(docs, 400)


def test_empty_table(spark, write_tables):
    folder = write_tables(documents=([], DOCS))
    assert QUERIES["op4_suffix_dedup"](spark, folder).count() == 0


def test_anchors_stand_for_every_string(monkeypatch):
    monkeypatch.setattr(suffixes, "_CHUNK", 64)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 300, 39, 40, 41, 177)]
    found = suffixes.anchors_of(*flat_bytes(pa.array(texts)), 40)
    starts = [(t, s) for t, lo, hi in zip(found["text"], found["lo"], found["hi"]) for s in range(lo, hi + 1)]
    assert sorted(starts) == [(t, s) for t, text in enumerate(texts) for s in range(len(text) - 39)]
    inside = (found["lo"] <= found["hi"]) & (found["p"] >= found["hi"]) & (found["p"] + 10 <= found["lo"] + 40)
    assert inside.all()


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(2)
    say = lambda n: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, n)))
    for _ in range(100):
        runs = [sorted((say(6), say(3), 1, bytes(16)) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 6))]
        tree = suffixes.LoserTree([suffixes.read_run(suffixes.front_code(r)) for r in runs])
        got = list(tree)
        assert [e[:2] for _, e in got] == sorted(e[:2] for r in runs for e in r)
        for (_, a), (shared, b) in zip(got, got[1:]):
            assert shared == suffixes.common_prefix(a[0], b[0])


def test_rows_without_a_key_and_columns_of_any_name(spark):
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = say(60)
    texts = [(1, say(30) + passage + say(9)), (None, passage + say(40)), (None, say(50)), (None, say(20) + passage[10:]), (2, say(70))]
    texts += [(None, texts[2][1])]
    rows = [(k, t, i, "f", "k") for i, (k, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int, `all` string, n_removed string")
    done = suffixes.remove_repeats(df, length=40)
    assert done.columns == ["doc_id", "text", "found", "all", "n_bytes", "n_removed", "spans", "kept", "kept_text"]
    want = brute_force([(i, t) for i, (_, t) in enumerate(texts)], 40)
    got = {r.found: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in done.collect()}
    assert got == want and want[1][1] and want[3][1] and want[2][1]
    assert {(r.doc_id, r.text, r.found, r["all"]) for r in done.collect()} == {r[:4] for r in rows}


def test_text_beyond_one_chunk_through_the_whole_operator(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    long = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) - 200))
    docs = [(1, long + passage + long[:3000]), (2, "x" + passage)]
    monkeypatch.setattr(suffixes, "RANGE_ANCHORS", 4)
    rows = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert bytes(rows[2].kept) == b"x" and rows[1].n_removed == 450 + 6000
    assert bytes(rows[1].kept) == long[3000:].encode()
