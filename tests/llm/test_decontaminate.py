import hashlib
import random
import re

import corpus_pipeline
from tablewright.llm import decontaminate
from tablewright.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def expected(docs, items):
    out = {}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, other in items:
            v = words(other)
            n = min(13, len(v))
            cuts = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in cuts:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        names = ",".join(sorted(found))
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_query_against_brute_force(spark, write_tables):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "é", "d1", "ΑΣ", "αΣ"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(40)
    items = [(1, base), (2, base), (3, "one"), (4, "Two, words"), (5, None), (6, " ... "), (7, say(13)), (8, "x y z w"), (10, say(60))]
    docs = [
        (1, say(50) + " " + base[10:70] + " " + say(20)), (2, base.lower()), (3, base.replace(" ", "--")), (4, None), (5, ""),
        (6, "..."), (7, "ONE"), (8, "two words two WORDS one"), (9, "x y z"), (10, "a x-y z:w b"), (11, say(3000) + base + say(3000)),
        (12, base.upper()), (13, "fine " * 139 + "one"), (14, "fine " * 19 + "one"), (15, "fine " * 20 + "one"),
    ] + [(100 + i, say(200)) for i in range(20)] + [(200 + i, base) for i in range(3)]
    folder = write_tables(
        documents=([(k, t, None, "s", 0) for k, t in docs], DOCS), benchmark=(items, "item_id long, text string")
    )
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op9_decontamination"](spark, folder).collect()}
    assert got == expected(docs, items)


def test_empty_tables(spark, write_tables):
    folder = write_tables(documents=([(1, "a b", None, None, None)], DOCS), benchmark=([], "item_id long, text string"))
    row = QUERIES["op9_decontamination"](spark, folder).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    folder = write_tables(documents=([], DOCS), benchmark=([(1, "a b")], "item_id long, text string"))
    assert QUERIES["op9_decontamination"](spark, folder).count() == 0


def test_letters_that_are_lowered_by_their_neighbours(spark, write_tables):
    items = [(1, "e^Σ x"), (2, "Α.Σ. x"), (3, "ΕΣ.Α"), (4, "one ΕΣ:Α two É`Σ three f^Σ four Α.Σ. five g^Σ six")]
    docs = [(k, f"Before {t} after") for k, t in items] + [(9, "e^σ x"), (10, "E^Σ X")]
    folder = write_tables(
        documents=([(k, t, None, "s", 0) for k, t in docs], DOCS), benchmark=(items, "item_id long, text string")
    )
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op9_decontamination"](spark, folder).collect()}
    assert got == expected(docs, items)
    assert all(got[k][1] for k in (1, 2, 3, 4, 10)) and not got[9][1]


def test_columns_of_any_name_and_rows_without_a_key(spark):
    names = ["doc_id", "text", "found", "_key", "_w", "_n", "_true", "key", "w", "all", "n_hit", "body", "contaminated"]
    schema = ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names)
    rows = [(k, text, *(f"{n}{i}" for n in names[2:])) for i, (k, text) in enumerate([(1, "fine words"), (None, "say ONE two"), (None, "none"), (3, "one two"), (3, "x"), (3, "x")])]
    items = spark.createDataFrame([(7, "one two")], "item_id long, text string")
    done = decontaminate.contaminated(spark.createDataFrame(rows, schema), items)
    kept = [n for n in names if n not in ("n_hit", "contaminated")]
    assert done.columns == [*kept, "n_words", "n_hit", "items", "contaminated"]
    got = [(tuple(r[n] for n in kept), r.n_hit, tuple(r["items"])) for r in done.collect()]
    index = [names.index(n) for n in kept]
    want = [(tuple(r[i] for i in index), 2 if "two" in r[1] else 0, ("7",) if "two" in r[1] else ()) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_clean_texts_are_not_shuffled(spark, write_tables):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"plain text number {i} " * 20, "en", "s", 0) for i in range(60)]
    docs += [(70, item, "en", "s", 0), (70, item, "en", "s", 0), (None, item, "en", "s", 0), (None, None, "en", "s", 0), (71, "x " * 999 + item, "en", "s", 0)]
    folder = write_tables(documents=(docs, DOCS), benchmark=([(1, item)], "item_id long, text string"))
    table, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    marked = decontaminate.contaminated(table, bench)
    assert sorted((r.doc_id or 0, r.n_hit) for r in marked.filter("n_hit > 0").collect()) == [(0, 30), (70, 30), (70, 30), (71, 30)]
    kept = corpus_pipeline.benchmark_passages(spark, table, folder)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, *range(60), 71]
    for out in (marked, kept):
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_places_and_verdicts_are_not_sent_through_the_driver(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(40))
    docs = [(k, f"start {k} " + (item if k % 2 else "plain words"), f"more {k}") for k in range(40)] + [(None, item, None), (1, item, "z"), (1, item, "z"), (2, None, "y")]
    table = spark.createDataFrame(docs, "doc_id long, text string, items_before string")
    bench = spark.createDataFrame([(i, item) for i in range(9)], "item_id long, text string")
    plans = {}

    def staged(df, label, write=decontaminate.stage):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(decontaminate, "stage", staged)
    few = decontaminate.contaminated(table, bench)
    # Small files that are large in memory; of the broadcasts only the keys of the texts are left.
    assert "SortMergeJoin [shingle" in plans["decontaminate-candidates"] and "BroadcastHashJoin" not in plans["decontaminate-candidates"].split("SortMergeJoin")[0]
    assert "SortMergeJoin [key" in plans["decontaminate-verdicts"] and plans["decontaminate-verdicts"].count("BroadcastExchange") == 1
    monkeypatch.setattr(decontaminate, "BROADCAST_VERDICTS", 5)
    many = decontaminate.contaminated(table, bench)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "LeftSemi" in plan and "LeftAnti" in plan
    want = [(k, t, m, 40 if t and item in t else 0, len(words(t)), 9 if t and item in t else 0) for k, t, m in docs]
    for done in (few, many):
        got = [(r.doc_id, r.text, r.items_before, r.n_hit, r.n_words, len(r["items"])) for r in done.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
