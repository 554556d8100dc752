import os
import random

from pyspark.sql import functions as F

from tablewright.columns import ROW_ID, SOURCE_FILE
from tablewright.runner import stage
from tablewright.sources import quoted, text


def cells(df, fmt):
    rows = df.orderBy(SOURCE_FILE, ROW_ID).collect()
    return [(os.path.basename(r[SOURCE_FILE]), *(r[c] for c in fmt.columns)) for r in rows], {r[ROW_ID] for r in rows}


def field(rng, sep):
    plain = rng.choice(["", "a", "bc d", "é", 'in"ner', "x" * rng.randint(1, 30)])
    if rng.random() < 0.5:
        return plain.replace(sep, "")
    inner = rng.choice(["", "line\nbreak", f"a{sep}b", 'say ""hi""', "\n\n", '""', "tail\n", f'"",{sep}""\n', "\r\nwindows"])
    return f'"{plain.replace(chr(34), "")}{inner}"'


def test_equal_to_the_read_of_one_task(spark, tmp_path):
    rng = random.Random(11)
    for sep, codec, end in ((",", "utf-8", "\n"), ("|", "latin-1", "\n"), (";", "utf-8", "\r\n")):
        folder = tmp_path / f"{codec}{ord(sep)}"
        folder.mkdir()
        for name in ("one.csv", "two.csv"):
            lines = [sep.join(["h1", "h2", "h3"])] + [sep.join(field(rng, sep) for _ in range(3)) for _ in range(120)]
            lines[50] = ""
            lines[60] = sep.join(["too", "many", "fields", '"here\nwith break"'])
            lines[70] = '"short\nrow"'
            (folder / name).write_bytes(end.join(lines).encode(codec) + (end.encode() if name == "one.csv" else b""))
        encoding = "UTF-8" if codec == "utf-8" else "ISO-8859-1"
        fmt = text.TextFormat(sep, encoding, ("h1", "h2", "h3"), True)
        paths = [f"file:{folder}/{n}" for n in ("one.csv", "two.csv")]
        whole = stage(text._scan_whole(spark, fmt, paths), "whole")
        want, _ = cells(whole, fmt)
        for block in ("64m", "300"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            maps = quoted.block_maps(spark, paths, sep)
            blocks = maps.count()
            sizes = text._by_size(spark, paths)
            got = stage(text.scan(spark, fmt, paths), "got")
            rows, ids = cells(got, fmt)
            good, bad = text.split_rejects(got, fmt)
            counts = good.count(), bad.count()
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
            assert blocks == 2 if block == "64m" else blocks > 12
            assert [len(x) for x in sizes] == ([2, 0] if block == "64m" else [0, 2])
            # Spark's reader makes one character of the line ends inside quotes where those of the file are two.
            plain = [tuple(c and c.replace("\r\n", "\n") for c in row) for row in rows] if end == "\r\n" else rows
            assert plain == want and len(ids) == len(rows)
            assert counts == tuple(x.count() for x in text.split_rejects(whole, fmt)) and counts[1] == 2


def test_carriage_returns_inside_lines_are_read_by_one_task(spark, tmp_path):
    (tmp_path / "mac.csv").write_bytes(b'a,b\r1,"x\ry"\r2,z\r')
    (tmp_path / "unix.csv").write_bytes(b'a,b\n1,"x\ny"\n2,z\n')
    good, bad = text.read_text(spark, [f"file:{tmp_path}/unix.csv"])
    assert [(r.a, r.b) for r in good.orderBy(ROW_ID).collect()] == [("1", "x\ny"), ("2", "z")] and bad.count() == 0
    fmt = text.TextFormat(",", "UTF-8", ("a", "b"), True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9")
    both = stage(text.scan(spark, fmt, [f"file:{tmp_path}/mac.csv", f"file:{tmp_path}/unix.csv"]), "both")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert both.count() == 4 and {("1", "x\ny"), ("2", "z")} <= {(r.a, r.b) for r in both.collect()}
    assert both.select(F.countDistinct(ROW_ID)).first()[0] == both.count()


def test_states_of_lines():
    states = quoted.LineStates(",")
    outside = {b"a,b": 0, b'a,"b': 1, b'"a""': 1, b'"a"",b': 1, b'"a","b"x,"c': 1, b'5" x,3" y': 0, b'"a"x"y,"z"': 0, b',,"': 1, b"": 0, b'""': 0}
    inside = {b"a": 1, b'a"': 0, b'a",b': 0, b'a","b': 1, b'a"",b': 1, b'"': 0, b'""': 1, b'"""': 0, b'x"y,"z': 1}
    assert {x: states.from_outside(x) for x in outside} == outside
    assert {x: states.from_inside(x) for x in inside} == inside


def test_block_states_compose(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for path in "abc":
        state = 0
        for block in range(0, 900, 30):
            after = [rng.randint(0, 1), rng.randint(0, 1)] if rng.random() < 0.3 else rng.choice([[0, 1], [1, 0]])
            rows.append((path, block, *after, rng.random() < 0.5, False))
            want[path, block] = state
            state = after[state]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, quoted._MAPS)
    assert {(r.path, r.block): r.state for r in quoted.block_states(df).collect()} == want
