"""Dirty views over the given tables, in SQL that Spark and DuckDB both read.

``{table}`` stands for a table; NBSP and ZWSP stand for U+00A0 and U+200B.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VIEWS = {
    "dirty_customer": """
SELECT c_custkey,
 CASE c_custkey % 7 WHEN 0 THEN '  ' || c_name || ' ' WHEN 1 THEN upper(c_name) WHEN 2 THEN '   ' WHEN 3 THEN NULL
   WHEN 4 THEN 'NBSP' || c_name WHEN 5 THEN replace(c_name, '#', 'ZWSP#') ELSE c_name END AS name,
 CASE c_custkey % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN 'null' WHEN 2 THEN ' None ' WHEN 3 THEN '-' WHEN 4 THEN '00'
   WHEN 5 THEN 'n.d.' WHEN 6 THEN 'Sin Dato' ELSE c_mktsegment END AS status,
 CASE c_custkey % 12 WHEN 0 THEN '$' || us WHEN 1 THEN eu WHEN 2 THEN '(' || eu || ')' WHEN 3 THEN 'US$ ' || eu WHEN 4 THEN grp
   WHEN 5 THEN '0' || CAST(dollars AS STRING) WHEN 6 THEN '1234567890123' WHEN 7 THEN 'abc' WHEN 8 THEN '15%' WHEN 9 THEN ''
   WHEN 10 THEN CAST(dollars AS STRING) ELSE us END AS amount,
 CASE c_custkey % 5 WHEN 0 THEN 'user' || CAST(c_custkey AS STRING) || '@mail' WHEN 1 THEN NULL
   ELSE 'user' || CAST(c_custkey AS STRING) || '@mail.com' END AS email,
 CASE c_custkey % 4 WHEN 0 THEN '+54 (11) 5555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 1 THEN '123'
   WHEN 2 THEN 'call me' ELSE '5550' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS phone,
 c_mktsegment AS segment, c_acctbal
FROM (SELECT *, grp || '.' || c2 AS us, replace(grp, ',', '.') || ',' || c2 AS eu FROM (
 SELECT *, CASE WHEN dollars >= 1000 THEN CAST(CAST(FLOOR(dollars / 1000) AS BIGINT) AS STRING) || ',' ||
   lpad(CAST(dollars % 1000 AS STRING), 3, '0') ELSE CAST(dollars AS STRING) END AS grp FROM (
 SELECT *, CAST(FLOOR(cents / 100) AS BIGINT) AS dollars, lpad(CAST(cents % 100 AS STRING), 2, '0') AS c2 FROM (
 SELECT *, CAST(ROUND(ABS(c_acctbal) * 100) AS BIGINT) AS cents FROM {customer}) q1) q2) q3) q4""",
    "dirty_orders": """
SELECT o_orderkey, o_custkey, o_totalprice,
 CASE o_orderkey % 6 WHEN 0 THEN dd || '/' || mm || '/' || yy WHEN 1 THEN yy || '-' || mm || '-' || dd
   WHEN 2 THEN dd || '-' || mm || '-' || yy WHEN 3 THEN yy || '/' || mm || '/' || dd
   WHEN 4 THEN 'no date' ELSE NULL END AS order_date
FROM (SELECT *, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm,
  CAST(year(o_orderdate) AS STRING) AS yy FROM {orders}) q""",
    "dirty_events": """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS user_id,
 CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS event_type,
 CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value, CAST(NULL AS STRING) AS empty_col FROM {events}""",
    "dirty_lineitem": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' '
  ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS qty_text FROM {lineitem}""",
    "dirty_dup_customer": """
SELECT c_name AS name, c_mktsegment AS segment FROM {customer}
UNION ALL SELECT c_name, c_mktsegment FROM {customer} WHERE c_custkey % 10 = 0
UNION ALL SELECT upper(c_name), c_mktsegment FROM {customer} WHERE c_custkey % 10 = 1
UNION ALL SELECT ' ' || c_name, c_mktsegment FROM {customer} WHERE c_custkey % 10 = 2""",
    "injected_part": """
SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '=' || p_name WHEN 1 THEN '+' || p_name WHEN 2 THEN '-' || p_name
  WHEN 3 THEN '@' || p_name WHEN 4 THEN chr(9) || p_name ELSE p_name END AS p_name FROM {part}""",
    # Amounts, dates and labels as text: what the automatic passes are for.
    "messy_sales": """
SELECT o_orderkey, o_orderstatus AS region,
 CASE o_orderkey % 6 WHEN 0 THEN dd || '/' || mm || '/' || yy WHEN 1 THEN yy || '-' || mm || '-' || dd
   WHEN 2 THEN dd || '-' || mm || '-' || yy WHEN 3 THEN ' ' || yy || '/' || mm || '/' || dd
   WHEN 4 THEN '  ' ELSE NULL END AS sold_on,
 CASE o_orderkey % 5 WHEN 0 THEN '$' || dollars || '.' || c2 WHEN 1 THEN dollars || ',' || c2
   WHEN 2 THEN '(' || dollars || ',' || c2 || ')' WHEN 3 THEN 'USD ' || dollars || '.' || c2
   ELSE dollars || '.' || c2 || ' ' END AS amount,
 CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS label,
 CASE o_orderkey % 7 WHEN 0 THEN 'two' || chr(10) || 'lines' WHEN 1 THEN '' ELSE 'plain' END AS note
FROM (SELECT *, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm,
  CAST(year(o_orderdate) AS STRING) AS yy,
  CAST(CAST(FLOOR(cents / 100) AS BIGINT) AS STRING) AS dollars, lpad(CAST(cents % 100 AS STRING), 2, '0') AS c2
  FROM (SELECT *, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM {orders}) q1) q2""",
    # One JSON response per event with three proposals, some of them unacceptable.
    "responses": """
SELECT event_id, '{"proposals":[{"action":"' ||
  CASE WHEN event_type = 'click' THEN 'trim_text' WHEN event_type = 'error' THEN 'drop_table' ELSE 'normalize_case' END ||
  '","column":"' || event_type || '","reason":"seen","confidence":' ||
  CASE event_id % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '"0.5"' WHEN 2 THEN '1.5' ELSE '1' END ||
  ',"parameters":' || CASE WHEN event_id % 2 = 0 THEN '{"format":"lower"}' ELSE '[1]' END ||
  '},{"action":"blank_to_null","column":null,"confidence":0.25}]}' AS response FROM {events}""",
}


def _text(name: str) -> str:
    return _VIEWS[name].strip().replace("NBSP", "\u00a0").replace("ZWSP", "\u200b")


_TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _text(name)
    frames = {t: table(spark, sf_dir, t) for t in sorted(set(_TABLE.findall(text)))}
    for found in frames:
        frames[found].createOrReplaceTempView(f"src_{found}")
    return spark.sql(_TABLE.sub(lambda m: f"src_{m.group(1)}", text))


def view_sql(name: str) -> str:
    return _TABLE.sub(lambda m: m.group(1), _text(name))
