from tablewright.llm import url_filter
from tablewright.llm.queries import QUERIES

ENTRY = "pattern string, kind string, active boolean, at long"
DAY = 86400


def judged(spark, captures, entries):
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_at long, pattern string")
    rows = url_filter.judge(df, spark.createDataFrame(entries, ENTRY)).collect()
    return [(r.page_id, r.verdict, r.pattern) for r in sorted(rows, key=lambda r: r.page_id)]


def test_intervals_specificity_and_ties(spark):
    entries = [
        ("Bad.example.com", "block", True, 100), ("bad.example.com", "block", False, 200 * DAY),
        ("bad.example.com/ok", "allow", True, 50), ("both.org", "allow", True, 0), ("both.org", "block", True, 0),
        ("tie.org", "block", False, 10), ("tie.org", "block", True, 10), ("off.org", "block", None, 5),
        (None, "block", True, 0), ("x.org", None, True, 0), ("y.org", "block", True, None),
    ]
    captures = [
        (1, "https://www.bad.example.com:443/a?q=1", 99, "old"), (2, "https://www.bad.example.com:443/a?q=1", 100, ""),
        (3, "http://user@bad.example.com/ok/deeper#x", 150, ""), (4, "http://bad.example.com/okay", 150, ""),
        (5, "bad.example.com", 200 * DAY - 1, ""), (6, "bad.example.com", 200 * DAY, ""), (7, "http://both.org/", 5, ""),
        (8, "http://tie.org", 10, ""), (9, None, 10, ""), (10, "http://tie.org", None, ""), (11, "", 10, ""),
        (12, "http://off.org", 10, ""), (13, "http://notbad.example.com", 150, ""), (14, "http://tie.org/" + "a/" * 500, 11, ""),
        (15, "http://tie.org", 10, ""), (15, "http://tie.org", 10, ""), (16, "http://y.org", 10, ""),
    ]
    bad = "bad.example.com"
    assert judged(spark, captures, entries) == [
        (1, "none", None), (2, "block", bad), (3, "allow", bad + "/ok"), (4, "block", bad), (5, "block", bad), (6, "none", None),
        (7, "block", "both.org"), (8, "block", "tie.org"), (9, "none", None), (10, "none", None), (11, "none", None),
        (12, "none", None), (13, "none", None), (14, "block", "tie.org"), (15, "block", "tie.org"), (15, "block", "tie.org"),
        (16, "none", None),
    ]


def test_empty_tables(spark, write_tables):
    assert judged(spark, [(1, "http://a.org", 5, "")], []) == [(1, "none", None)]
    assert judged(spark, [], [("a.org", "block", True, 0)]) == []
    folder = write_tables(pages=([], "page_id long, url string, html string"))
    assert QUERIES["op1_url_filters"](spark, folder).count() == 0


def test_columns_of_any_name(spark):
    names = ["kind", "asked", "moment", "all", "found", "by", "bucket", "verdict"]
    df = spark.createDataFrame([("http://a.org", 5, *names), (None, 5, *names)], ", ".join(["url string", "fetched_at long", *(f"`{n}` string" for n in names)]))
    done = url_filter.judge(df, spark.createDataFrame([("a.org", "block", True, 0)], ENTRY))
    assert done.columns == ["url", "fetched_at", *names[:-1], "verdict", "pattern"]
    rows = {r.url: r for r in done.collect()}
    assert [rows["http://a.org"][n] for n in names] == [*names[:-1], "block"] and rows[None].verdict == "none"
    assert [rows[None][n] for n in names[:-1]] == names[:-1]
