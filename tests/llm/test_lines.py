import random
import zlib
from collections import defaultdict

import numpy as np

from tablewright.llm import lines
from tablewright.llm.queries import QUERIES

BLANKS = " \t\n\v\f\r"


def key_of(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))


def brute_force(docs, chars=20, least=3):
    """(n_lines, n_dropped, kept) of each row, in order; a null id is below all others."""
    holders = defaultdict(set)
    for k, text in docs:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(-1 if k is None else k)
    out = []
    for k, text in docs:
        own = (text or "").split("\n")
        stays = [
            x for x in own
            if len(key_of(x)) < chars or len(holders[key_of(x)]) < least or max(holders[key_of(x)]) == (-1 if k is None else k)
        ]
        out.append((k, len(own), len(own) - len(stays), "\n".join(stays)))
    return out


def documents(rng):
    common = ["The footer of every page here", "  all rights RESERVED by them \r", "Éa line with Ünicode letters É", "short line", "x" * 19, "y" * 20]
    say = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 40)))
    docs = [(0, None), (1, ""), (2, "\n\n"), (3, "a\n" * 500 + "the footer of every page here"), (None, "The footer of every page here\nq")]
    docs += [(i, "\n".join(rng.choice(common) if rng.random() < 0.6 else say() for _ in range(rng.randint(1, 9)))) for i in range(4, 60)]
    docs += [docs[10], docs[10], (12, "another text of this id\nthe footer of every page here"), (None, docs[20][1])]
    return docs


def test_against_brute_force(spark):
    docs = documents(random.Random(3))
    df = spark.createDataFrame([(k, t, "x", 7, 8) for k, t in docs], "doc_id long, text string, keep string, row int, n_lines int").repartition(7)
    for parts in ("2", "31"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        done = lines.apply_bitmaps(df, lines.keep_bitmaps(df))
        assert done.columns == ["doc_id", "text", "keep", "row", "n_lines", "n_dropped", "kept_text"]
        rows = done.collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        order = lambda r: (r[0] is None, r)
        got = sorted([(-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in rows])
        want = sorted([(-1 if k is None else k, *rest) for k, *rest in brute_force(docs)], key=order)
        assert got == want
        assert all((r.keep, r.row) == ("x", 7) for r in rows)


def test_stream_over_cut_ranges():
    rng = random.Random(1)
    for trial in range(300):
        least = rng.choice([2, 3, 3, 4])
        rows = sorted(
            {(rng.randint(0, 3), rng.randint(0, 1), -rng.randint(0, 6), 0, rng.randint(0, 4)) for _ in range(rng.randint(0, 60))}
        )
        holders = defaultdict(set)
        for a, b, d, _, _ in rows:
            holders[a, b].add(-d)
        want = {(-d, p, a, b) for a, b, d, _, p in rows if len(holders[a, b]) >= least and -d < max(holders[a, b])}
        found, waits, counts = [], [], []
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randint(0, 6)))
        for part, (start, end) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            stream = lines.LineStream(part, least)
            out = []
            while start < end:
                stop = min(end, start + rng.randint(1, 9))
                columns = np.array(rows[start:stop], np.int64).T.copy()
                columns[2] *= -1
                out += stream.add(*columns)
                start = stop
            out += stream.end()
            for row in (r for batch in out for r in batch.to_pylist()):
                (counts if row["part"] is not None else found if row["h1"] is None else waits).append(row)
        merged = defaultdict(list)
        for c in counts:
            merged[c["h1"], c["h2"]].append(c)
        for key, parts in merged.items():
            docs = sum(c["docs"] for c in parts) - sum(a["last"] == b["doc"] for a, b in zip(parts, parts[1:]))
            if docs >= least:
                found += [w for w in waits if (w["h1"], w["h2"]) == key and w["doc"] < max(c["doc"] for c in parts)]
        assert len(found) == len(want) and {(f["doc"], f["pos"]) for f in found} == {w[:2] for w in want}
        assert all(sum(c["part"] == p for c in counts) <= 2 for p in range(len(cuts) + 1))


def test_bitmaps_are_compressed():
    bits = np.ones(100_000, bool)
    bits[::1000] = False
    packed = zlib.compress(np.packbits(bits).tobytes())
    assert len(packed) < 400
    text = "\n".join(map(str, range(100_000)))
    assert lines.kept_text(text, packed, 100_000).split("\n") == [str(i) for i in range(100_000) if i % 1000]


def test_empty_table(spark, write_tables):
    folder = write_tables(documents=([], "doc_id long, text string, lang string, source string, n_chars long"))
    assert QUERIES["op11_line_dedup"](spark, folder).count() == 0
