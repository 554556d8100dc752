import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tablewright.llm import bpe
from tablewright.llm.queries import RANKS

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the house garden were near river where children played with their friends and old mill of stone".split()
DE = "das haus der garten waren nahe dem fluss wo die kinder mit ihren freunden spielten und alte mühle".split()


def say(rng, words, n):
    return " ".join(rng.choice(words) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "") for _ in range(n))


def test_stages_on_planted_cases(spark, write_tables):
    rng = random.Random(6)
    docs = [(i, say(rng, (EN, DE)[i % 2], 150), ("en", "de")[i % 2], "s", 7) for i in range(40)]
    passage = "é" + say(rng, EN, 90)
    item = say(rng, EN, 30)
    docs += [
        (50, None, "en", "s", 0), (51, "123 !!", "en", "s", 0), (52, "", None, None, None),
        (60, docs[0][1], "en", "s", 7), (61, docs[0][1].replace(docs[0][1].split()[70], "changed", 1), "en", "s", 7),
        (70, say(rng, EN, 60) + " " + passage + " " + say(rng, EN, 60), "en", "s", 7),
        (71, say(rng, EN, 60) + "\n" + passage + "\n" + say(rng, EN, 60), "en", "s", 7),
        (80, say(rng, EN, 60) + " " + item, "en", "s", 7), (81, item + " " + say(rng, EN, 900), "en", "s", 7),
    ]
    folder = write_tables(documents=(docs, DOCS), benchmark=([(1, item)], "item_id long, text string"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(rows) == {*range(40), 70, 71, 81}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = {}
    for key, row in rows.items():
        texts[key] = codec.decode(np.frombuffer(row.ids, "<u4").tolist())
        assert row.decoded_sha256 == hashlib.sha256(texts[key].encode()).hexdigest()
    by_id = {d[0]: d[1] for d in docs}
    assert all(texts[i] == by_id[i] for i in range(40)) and texts[81] == by_id[81]
    for i in (70, 71):
        assert texts[i] == by_id[i].replace(passage, "")


def test_stages_keep_the_columns(spark, write_tables):
    empty = write_tables(documents=([], DOCS), benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.createDataFrame([(1, "plain words", "en", "s", 11), (2, "plain words", "en", "s", 11)], DOCS)
    more = docs.selectExpr("*", "'f' found", "'k' `all`", "1 n_removed").unionByName(docs.selectExpr("*", "'f' found", "'k' `all`", "1 n_removed"))
    for name, step in corpus_pipeline.STAGES[2:4]:
        assert {c for c in step(spark, more, empty).columns} >= {"found", "all"} and step(spark, more, empty).count() == 4
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, empty)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert [tuple(r) for r in out.collect() if r.doc_id == 1] == [(1, "plain words", "en", "s", 11)], name
