import zlib

import numpy as np
import pyarrow as pa

from tablewright.llm import bytetext, quality
from tablewright.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_query_on_small_tables(spark, write_tables):
    good = "the quiet river runs by the old mill and on to the sea"
    docs = [(i, good[i % 7 :] if i % 2 else "BUY!! NOW!! $$$ ### " * (1 + i % 3), None, "s", 0) for i in range(80)]
    docs += [(100, None, None, None, None), (101, "", None, None, None), (102, "?" * 200000, None, "s", 0), (102, "word " * 90000, None, "s", 0)]
    labels = [(i, i % 2, 0) for i in range(80)] + [(3, 1, 0), (5, None, 0), (None, 1, 0), (7, 4, 0), (900, 1, 0)]
    rows = QUERIES["op3_quality"](spark, write_tables(documents=(docs, DOCS), labels=(labels, LABELS))).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id < 80:
            assert r.predicted == r.doc_id % 2
    scores = {r.doc_id: r.score for r in rows}
    assert scores[100] == scores[101]


def test_without_labels_and_rows(spark, write_tables):
    folder = write_tables(documents=([(1, "a", None, None, None)], DOCS), labels=([], LABELS))
    assert QUERIES["op3_quality"](spark, folder).first().score == 0.5
    folder = write_tables(documents=([], DOCS), labels=([(1, 1, 1)], LABELS))
    assert QUERIES["op3_quality"](spark, folder).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op3_quality"](spark, folder).filter("held_out").join(labels, "doc_id")
    assert found.selectExpr("avg(int(predicted = quality)) a").first().a > 0.93


def test_margin_is_the_sparse_dot_product():
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.normal(size=1 << quality.BITS), 0.25)
    texts = ["a b b", "", "x, y", "a"]
    got = quality.margins(pa.array(texts), model)
    found, rows = quality.features(pa.array(texts))
    for i in range(len(texts)):
        mine = found[rows == i]
        want = model.weights[mine].mean() * quality.SCALE + 0.25 if len(mine) else 0.25
        assert abs(got[i] - want) < 1e-9
    assert [int((rows == i).sum()) for i in range(4)] == [5, 0, 5, 1]


def test_word_hashes_do_not_depend_on_their_place():
    words = [b"alpha", b"x" * 70000, b"beta", "é".encode(), b"y" * 3]
    one = b" ".join(words * 40)
    kinds = np.ones(256, np.uint8)
    kinds[32] = 0
    hashes, rows = bytetext.flat_words(np.frombuffer(one, np.uint8), np.array([0, len(one)]), kinds)
    assert len(hashes) == 200 and (hashes.reshape(40, 5) == hashes[:5]).all() and len(set(hashes)) == 5
    assert (rows == 0).all()
