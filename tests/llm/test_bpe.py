import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tablewright.llm import bpe
from tablewright.llm.queries import QUERIES, RANKS

TEXTS = [
    None, "", " ", "Héllo  wörld's 12 34\n\n", "emoji 👨‍👩‍👧 split", "中文 x \u0085y", "<|endoftext|>", "a" * 5000,
    "word " * 50000, "\x00\x1c\x1f ​　",
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


def test_query_matches_the_other_library(spark, write_tables, reference):
    rng = random.Random(3)
    pool = [chr(c) for c in range(0x180)] + ["́", "中", "\U0001f600", "'s", "  ", "the", "ing"]
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["", "tie", "tie"]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    folder = write_tables(documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.doc_id: r for r in QUERIES["op6_byte_bpe"](spark, folder).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_offsets_cover_the_characters(spark, reference):
    text = "Ein 👨 Straße,  naïve\nx"
    df = spark.createDataFrame([(1, text, b"old")], "id long, text string, ids binary")
    row = bpe.encode(df, RANKS, public_tokenizers.PATTERN).first()
    ids = np.frombuffer(row.ids, "<u4").tolist()
    spans = np.frombuffer(row.offsets, "<u4").reshape(-1, 2)
    assert ids == reference.encode_ordinary(text)
    for token, (start, end) in zip(ids, spans.tolist()):
        try:
            piece = reference.decode_single_token_bytes(token).decode()
        except UnicodeDecodeError:  # part of a character: the span is the whole character
            assert "👨" in text[start:end]
            continue
        assert text[start:end] == piece
    assert spans[0, 0] == 0 and spans[-1, 1] == len(text)


def test_empty_table_and_unknown_ids(spark):
    df = spark.createDataFrame([], "text string")
    assert bpe.encode(df, RANKS, public_tokenizers.PATTERN).count() == 0
    nothing = spark.createDataFrame([(None,)], "ids binary")
    assert bytes(bpe.decode(nothing, RANKS).first().decoded) == b""


def test_round_trip_equals_two_steps(spark):
    df = spark.createDataFrame([(i, t, b"old") for i, t in enumerate(TEXTS)], "id long, text string, decoded binary")
    one = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN)
    two = bpe.decode(bpe.encode(df.drop("decoded"), RANKS, public_tokenizers.PATTERN, offsets=False), RANKS)
    order = ["id", "text", "ids", "n_tokens", "decoded"]
    assert one.select(order).orderBy("id").collect() == two.select(order).orderBy("id").collect()
