import zlib

import zstandard

from tablewright.llm import langid
from tablewright.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the house and the garden were near the river where children played with their friends "
DE = "das haus und der garten waren nahe dem fluss wo die kinder mit ihren freunden spielten "


def documents():
    rows = []
    for i in range(60):
        base, lang = ((EN, "en"), (DE, "de"))[i % 2]
        words = base.split()
        rows.append((i, " ".join(words[(i + j) % len(words)] for j in range(20)), lang, "s", 0))
    return rows


def test_query(spark, write_tables):
    special = [
        (100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "1234 !!", None, "s", 0),
        (103, (EN + DE[:3]) * 3000, None, "s", 0), (104, EN, None, None, None), (104, EN, None, None, None),
    ]
    folder = write_tables(documents=(documents() + special, SCHEMA))
    rows = QUERIES["op7_language_id"](spark, folder).collect()
    assert len(rows) == 66
    got = {r.doc_id: r for r in rows}
    for i in range(60):
        assert got[i].lang_pred == ("en", "de")[i % 2]
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "en"]
    assert got[100].rejected and got[100].score == 0


def test_ties_and_no_model(spark):
    df = spark.createDataFrame([(1, "words", 5), (2, None, 6)], "doc_id long, text string, score int")
    nothing = langid.learn(df.selectExpr("doc_id", "text", "cast(null as string) lang"))
    rows = langid.identify(df, nothing).collect()
    assert [r.lang_pred for r in rows] == ["und", "und"] and rows[0].rejected
    same = langid.LanguageModel(("a", "b"), (b"xx words yy", b"xx words yy"))
    assert langid.identify(df, same).orderBy("doc_id").first().asDict() == {
        "doc_id": 1, "text": "words", "lang_pred": "a", "score": 0.5, "rejected": True,
    }
    empty = df.limit(0)
    assert langid.identify(empty, same).count() == 0


def test_held_out_accuracy(spark):
    QUERY = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = QUERY.filter("held_out").join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred)) a").first().a
    assert right > 0.97


def test_sizes_against_direct_calls():
    model = langid.LanguageModel(("a", "b"), (EN.encode() * 5, DE.encode() * 5))
    data = langid.fold((EN + DE) * 200)
    got = langid._Sizes(model, langid.LEVEL, langid.BLOCK_BYTES).of(data)
    for content, size in zip(model.dictionaries, got):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        one = zstandard.ZstdCompressor(dict_data=known, level=langid.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        blocks = [data[i : i + langid.BLOCK_BYTES] for i in range(0, len(data), langid.BLOCK_BYTES)]
        assert size == sum(len(one.compress(b)) for b in blocks)


def test_pieces_come_from_whole_texts_and_share_the_dictionary(spark):
    docs = [(i, "header " * 300 + f"tail{i} " * 300, "en") for i in range(40)]
    model = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"), piece_chars=100, dictionary_bytes=3000)
    content = model.dictionaries[0]
    assert b"tail" in content and b"header" in content and 2500 < len(content) <= 3000
    parts = langid._dictionary(["a" * 10, "b" * 5000, "c" * 5000], 2000).split(b"\n")
    assert [len(p) for p in parts] == [10, 993, 994]
