"""The catalogue's expected results as DuckDB SQL, written from the rules and not from the plans."""

from __future__ import annotations

from checks.views import view_sql
from tablewright.functions.constants import INVISIBLE_CHARS, WHITESPACE

ORACLE: dict[str, str] = {}


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = _quote(WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _with(view: str, body: str, **more: str) -> str:
    parts = [f"{view} AS ({view_sql(view)})", *[f"{k} AS ({v})" for k, v in more.items()]]
    return f"WITH {', '.join(parts)} {body}"


JUNK = "('n/a', 'na', 'null', 'none', 'nan', '-', '--', 'sin dato')"


def junk(x: str, extras: str = "", zeros: bool = False) -> str:
    found = f"lower({strip(x)}) IN {JUNK}"
    if extras:
        found += f" OR {strip(x)} IN ({extras})"
    if zeros:
        found += f" OR regexp_full_match({strip(x)}, '0+')"
    return f"CASE WHEN {found} THEN NULL ELSE {x} END"


def blank(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN NULL ELSE {x} END"


def title(x: str) -> str:
    runs = rf"regexp_extract_all({x}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+')"
    return (
        f"CASE WHEN {x} IS NOT NULL THEN array_to_string(list_transform({runs}, "
        f"lambda r: CASE WHEN starts_with(r, 'ß') THEN 'Ss' ELSE upper(substring(r, 1, 1)) END || lower(substring(r, 2))), '') END"
    )


def invisibles(x: str) -> str:
    return f"translate(regexp_replace({x}, '[\\r\\n\\t]+', ' ', 'g'), {_quote(INVISIBLE_CHARS)}, '')"


def to_float(x: str) -> str:
    shape = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"CASE WHEN regexp_full_match({x}, '{shape}') THEN TRY_CAST({x} AS DOUBLE) END"


def numbers(source: str, cell: str, locale: str = "auto", percent: bool = False) -> str:
    """Rows of ``source`` with one more column ``number``; one step of the decision table each."""
    wrapped = "t LIKE '(%' AND t LIKE '%)'"
    bare = "u"
    for mark in ("USD", "EUR", "GBP", "U$S", "US$", "$", "€", "£"):
        bare = f"replace({bare}, '{mark}', '')"
    last_comma = "length(n) - position(',' IN reverse(n)) + 1"
    last_dot = "length(n) - position('.' IN reverse(n)) + 1"
    tail = "reverse(split_part(reverse(n), ',', 1))"
    head = f"substring(n, 1, {last_comma} - 1)"
    if locale == "auto":
        clean = f"""CASE
          WHEN NOT contains(n, '.') AND NOT contains(n, ',') THEN
            CASE WHEN regexp_full_match(n, '[+-]*[0-9]+') AND
              (length(ltrim(n, '+-')) >= 13 OR (starts_with(ltrim(n, '+-'), '0') AND length(ltrim(n, '+-')) > 1))
              THEN NULL ELSE n END
          WHEN contains(n, '.') AND contains(n, ',') THEN
            CASE WHEN {last_comma} > {last_dot} THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '') END
          WHEN contains(n, ',') THEN
            CASE WHEN regexp_full_match({tail}, '[0-9]{{3}}') THEN replace(n, ',', '')
                 WHEN regexp_full_match({tail}, '[0-9]+') THEN {head} || '.' || {tail}
                 ELSE replace(n, ',', '.') END
          ELSE n END"""
    elif locale == "eu":
        clean = f"""CASE WHEN contains(n, ',') THEN
            CASE WHEN regexp_full_match({tail}, '[0-9]+') THEN replace({head}, '.', '') || '.' || {tail}
                 ELSE replace(n, ',', '.') END
          ELSE n END"""
    else:
        clean = "replace(n, ',', '')"
    cut = "CASE WHEN ends_with(s, '%') THEN left(s, length(s) - 1) ELSE s END" if percent else "s"
    share = "CASE WHEN ends_with(s, '%') THEN 100.0 ELSE 1.0 END" if percent else "1.0"
    return f"""SELECT * EXCLUDE (t, u, s, n, c, neg, share),
      CASE WHEN neg THEN -({to_float('c')}) ELSE {to_float('c')} END / CAST(share AS DOUBLE) AS number
    FROM (SELECT *, {clean} AS c FROM (
      SELECT *, trim({cut}, {WS}) AS n, {share} AS share FROM (
      SELECT *, replace(trim({bare}, {WS}), ' ', '') AS s FROM (
      SELECT *, CASE WHEN {wrapped} THEN trim(substring(t, 2, length(t) - 2), {WS}) ELSE t END AS u,
        coalesce({wrapped}, false) AS neg FROM (
      SELECT *, {strip(cell)} AS t FROM {source})))))"""


def day(x: str, dayfirst: bool) -> str:
    """The written forms of the dirty views; an impossible first order falls to the other."""
    first, second = ("%d", "%m") if dayfirst else ("%m", "%d")
    t = strip(x)
    tries = []
    for a, b in ((first, second), (second, first)):
        tries += [f"try_strptime({t}, '{a}{sep}{b}{sep}%Y')" for sep in "/-."]
    tries.append(f"try_strptime({t}, '%Y/%m/%d')")
    iso = f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]+-[0-9]+') THEN try_strptime({x}, '%Y-%m-%d') END"
    return f"strftime(coalesce({iso}, {', '.join(tries)}), '%Y-%m-%d')"


# Cell rules -------------------------------------------------------------------------------------


def _cells(name: str, source: str, keys: str, cell: str) -> None:
    body = f"SELECT {keys}, {cell} AS value FROM {source}"
    ORACLE[name] = _with(source, body) if source.startswith("dirty") else body


_cells("trim_text", "dirty_customer", "c_custkey", strip("name"))
_cells("blank_to_null", "dirty_customer", "c_custkey", blank("name"))
_cells("junk_to_null", "dirty_customer", "c_custkey", junk("status"))
_cells("junk_to_null_extras_zeros", "dirty_customer", "c_custkey", junk("status", "'n.d.'", True))
_cells("normalize_case_upper", "part", "p_partkey", "upper(p_name)")
_cells("normalize_case_lower", "dirty_customer", "c_custkey", "lower(name)")
_cells("normalize_case_title", "dirty_customer", "c_custkey", title("name"))
_cells("normalize_case_title_documents", "documents", "doc_id", title('"text"'))
for _name, _locale, _percent in (
    ("auto", "auto", False), ("us", "us", False), ("eu", "eu", False), ("pct", "auto", True),
):
    ORACLE[f"normalize_numbers_{_name}"] = _with(
        "dirty_customer",
        f"SELECT c_custkey, number AS value FROM ({numbers('dirty_customer', 'amount', _locale, _percent)})",
    )
_cells("normalize_dates_dayfirst", "dirty_orders", "o_orderkey", day("order_date", True))
_cells("normalize_dates_monthfirst", "dirty_orders", "o_orderkey", day("order_date", False))
_cells("to_numeric_strict", "dirty_lineitem", "l_orderkey, l_linenumber", "CAST(trim(qty_text) AS DOUBLE)")
_cells("strip_invisibles_documents", "documents", "doc_id", invisibles('"text"'))
_cells("strip_invisibles_conversations", "conversations", "conv_id, turn", invisibles('"text"'))
_cells(
    "replace_values_exact", "part", "p_partkey",
    "CASE trim(p_type) WHEN 'ECONOMY' THEN 'BASIC' WHEN 'PROMO' THEN NULL ELSE p_type END",
)
_cells("replace_values_contains", "part", "p_partkey", "replace(p_name, 're', '<RE>')")
_cells(
    "replace_values_regex", "orders", "o_orderkey",
    r"regexp_replace(o_orderpriority, '^(\d)-(\w)', '\2/\1 $', 'g')",
)
_cells(
    "replace_values_first_wins", "dirty_customer", "c_custkey",
    f"""CASE WHEN {strip('status')} = 'None' THEN NULL WHEN {strip('status')} = 'N/A' THEN 'missing'
        WHEN contains(status, 'a') THEN replace(status, 'a', '@')
        WHEN regexp_matches(status, '[0-9]+') THEN regexp_replace(status, '[0-9]+', '#', 'g')
        ELSE status END""",
)
ORACLE["neutralise_formulas"] = _with(
    "injected_part",
    """SELECT p_partkey, CASE WHEN left(p_name, 1) IN ('=', '+', '-', '@', chr(9)) THEN '''' || p_name
       ELSE p_name END AS p_name FROM injected_part""",
)
ORACLE["cell_segment"] = _with(
    "dirty_customer",
    f"""SELECT c_custkey, lower({blank(invisibles(strip('name')))}) AS name, {junk('status', "'n.d.'")} AS status,
        number AS amount, {strip('email')} AS email FROM ({numbers('dirty_customer', 'amount')})""",
)

# Column-shape rules -----------------------------------------------------------------------------


def part(x: str, sep: str, i: int) -> str:
    return f"CASE WHEN len(string_split({x}, '{sep}')) >= {i} THEN {strip(f'''split_part({x}, '{sep}', {i})''')} END"


ORACLE["split_column"] = f"""SELECT p_partkey, {part('p_name', ' ', 1)} AS first_word,
    {part('p_name', ' ', 2)} AS second_word, {part('p_name', ' ', 3)} AS third_word FROM part"""
ORACLE["split_extra_parts"] = """SELECT 'split_column' AS action, 'o_orderpriority' AS column_name,
    count(*) FILTER (WHERE contains(o_orderpriority, '-')) AS lost FROM orders"""
ORACLE["merge_columns"] = _with(
    "dirty_customer",
    """SELECT c_custkey, coalesce(name, '') || '-' || coalesce(email, '') || '-' || coalesce(segment, '') AS joined
       FROM dirty_customer""",
)
ORACLE["split_merge_roundtrip"] = "SELECT s_suppkey, s_name FROM supplier"

# Row and table rules ----------------------------------------------------------------------------

ORACLE["drop_empty_rows"] = _with(
    "dirty_events",
    """SELECT * FROM dirty_events WHERE user_id IS NOT NULL OR event_type IS NOT NULL OR value IS NOT NULL
       OR empty_col IS NOT NULL""",
)
ORACLE["drop_empty_columns"] = _with("dirty_events", "SELECT event_id, user_id, event_type, value FROM dirty_events")
ORACLE["dedupe_exact"] = _with("dirty_dup_customer", "SELECT DISTINCT name, segment FROM dirty_dup_customer")
ORACLE["dedupe_exact_documents"] = """SELECT min(doc_id) AS doc_id, "text", lang, source, n_chars FROM documents
    GROUP BY "text", lang, source, n_chars"""
ORACLE["dedupe_trim_then_exact"] = _with(
    "dirty_dup_customer", f"SELECT DISTINCT {strip('name')} AS name, segment FROM dirty_dup_customer"
)
ORACLE["dedupe_exact_then_trim"] = _with(
    "dirty_dup_customer",
    f"SELECT {strip('name')} AS name, segment FROM (SELECT DISTINCT name, segment FROM dirty_dup_customer)",
)
for _name, _desc in (("first", ""), ("last", "DESC")):
    ORACLE[f"dedupe_by_key_{_name}"] = f"""SELECT * FROM documents
        QUALIFY row_number() OVER (PARTITION BY "text" ORDER BY doc_id {_desc}) = 1"""
ORACLE["dedupe_by_key_composite"] = """SELECT event_id, user_id, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"""
ORACLE["dedupe_by_key_lineitem"] = """SELECT * FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_extendedprice, l_orderkey,
      l_linenumber, l_suppkey, l_quantity, l_discount, l_tax, l_linestatus, l_shipdate) = 1"""

# Profiles ---------------------------------------------------------------------------------------


def _profile(source: str, key: str, columns: list[tuple[str, str]], samples: bool = True) -> str:
    parts = []
    for i, (name, kind) in enumerate(columns):
        shown = ""
        if samples:
            shown = f""", (SELECT coalesce(string_agg(v, ' | ' ORDER BY f), '') FROM (SELECT CAST("{name}" AS VARCHAR) AS v,
              min({key}) AS f FROM {source} WHERE "{name}" IS NOT NULL GROUP BY 1 ORDER BY f LIMIT 3)) AS samples"""
        parts.append(
            f"""SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS dtype, count("{name}") AS non_null,
            count(*) - count("{name}") AS nulls, count(DISTINCT "{name}") AS n_distinct{shown} FROM {source}"""
        )
    return " UNION ALL ".join(parts)


CUSTOMER_COLUMNS = [
    ("c_custkey", "bigint"), ("name", "string"), ("status", "string"), ("amount", "string"),
    ("email", "string"), ("phone", "string"), ("segment", "string"), ("c_acctbal", "double"),
]
ORACLE["profile_columns"] = _with("dirty_customer", _profile("dirty_customer", "c_custkey", CUSTOMER_COLUMNS))
ORACLE["profile_orders"] = _profile(
    "orders", "o_orderkey",
    [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string")],
)
ORACLE["profile_documents"] = _profile(
    "documents", "doc_id", [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")], False
)
ORACLE["table_stats"] = "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem"

# Detectors --------------------------------------------------------------------------------------


def issue(
    category: str, name: str | None, severity: str, affected: str, total: str, source: str, action: str, examples: str = "''"
) -> str:
    column = f"'{name}'" if name else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{category}' AS category, {column} AS column_name, {severity} AS severity,
      CAST(a AS BIGINT) AS affected, CAST(t AS BIGINT) AS total,
      CASE WHEN t = 0 THEN 0.0 ELSE round(a / t, 4) END AS ratio, {examples} AS examples, '{action}' AS suggested_action
      FROM (SELECT {affected} AS a, {total} AS t FROM {source}) WHERE a > 0"""


def first_values(value: str, condition: str, source: str, key: str) -> str:
    return f"""(SELECT coalesce(string_agg(v, ' | ' ORDER BY k), '') FROM (SELECT {value} AS v, {key} AS k FROM {source}
      WHERE {condition} ORDER BY k LIMIT 3))"""


def n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def missing(name: str, source: str) -> str:
    severity = "CASE WHEN a / t > 0.5 THEN 'HIGH' WHEN a / t > 0.1 THEN 'MEDIUM' ELSE 'LOW' END"
    return issue("missing_values", name, severity, n(f"{name} IS NULL"), "count(*)", source, "flag_for_review")


def blanks(name: str, source: str) -> str:
    return issue("blank_strings", name, "'LOW'", n(f"{strip(name)} = ''"), f"count({name})", source, "blank_to_null")


def spaces(name: str, source: str) -> str:
    return issue("extra_whitespace", name, "'LOW'", n(f"{name} <> {strip(name)}"), f"count({name})", source, "trim_text")


def outliers(name: str, source: str, key: str = "") -> str:
    bounds = f"""(SELECT quantile_cont({name}, 0.25) AS q1, quantile_cont({name}, 0.75) AS q3 FROM {source})"""
    beyond = f"({name} < q1 - 1.5 * (q3 - q1) OR {name} > q3 + 1.5 * (q3 - q1))"
    examples = "''"
    if key:
        examples = first_values(f"CAST({name} AS VARCHAR)", f"{beyond} AND q3 <> q1", f"{source}, {bounds}", key)
    return issue(
        "iqr_outliers", name, "'LOW'", n(f"{beyond} AND q3 <> q1"), f"count({name})", f"{source}, {bounds}",
        "flag_for_review", examples,
    ) + " AND t >= 10"


EMAIL_BAD = f"NOT regexp_full_match({strip('email')}, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')"
PHONE_DIGITS = f"length(regexp_replace({strip('phone')}, '[^0-9]', '', 'g'))"
PHONE_BAD = f"(NOT regexp_full_match({strip('phone')}, '[0-9\\s()+-]+') OR {PHONE_DIGITS} < 7 OR {PHONE_DIGITS} > 15)"


def emails(source: str, key: str) -> str:
    return issue(
        "suspicious_emails", "email", "'MEDIUM'", n(EMAIL_BAD), "count(email)", source, "flag_for_review",
        first_values(strip("email"), EMAIL_BAD, source, key),
    )


def phones(source: str, key: str) -> str:
    return issue(
        "suspicious_phones", "phone", "'LOW'", n(PHONE_BAD), "count(phone)", source, "flag_for_review",
        first_values(strip("phone"), PHONE_BAD, source, key),
    )


def case_variants(name: str, source: str) -> str:
    groups = f"""(SELECT lower({strip(name)}) AS k, count(DISTINCT {strip(name)}) AS s, count(*) AS c FROM {source}
      WHERE {strip(name)} <> '' GROUP BY 1)"""
    examples = f"(SELECT coalesce(string_agg(k, ' | ' ORDER BY k), '') FROM (SELECT k FROM {groups} WHERE s > 1 ORDER BY k LIMIT 3))"
    return issue(
        "case_variants", name, "'LOW'", "coalesce(sum(c) FILTER (WHERE s > 1), 0)", "sum(c)", groups, "normalize_case", examples
    )


ORACLE["detect_auto_named"] = _with(
    "dirty_events",
    issue("auto_named_column", "Columna_4", "'MEDIUM'", "count(value)", "count(*)", "dirty_events", "flag_for_review"),
)
ORACLE["detect_empty_rows"] = _with(
    "dirty_events",
    issue(
        "empty_rows", None, "'MEDIUM'", n("coalesce(CAST(user_id AS VARCHAR), event_type, CAST(value AS VARCHAR), empty_col) IS NULL"),
        "count(*)", "dirty_events", "drop_empty_rows",
    ),
)
ORACLE["detect_empty_columns"] = _with(
    "dirty_events",
    issue(
        "empty_columns", None, "'MEDIUM'", "CAST(count(empty_col) = 0 AS INTEGER)", "5", "dirty_events",
        "drop_empty_columns", "'empty_col'",
    ),
)
_DUP = "dirty_dup_customer"
_DISTINCT = f"(SELECT DISTINCT name, segment FROM {_DUP})"
_LOOSE = f"(SELECT DISTINCT lower({strip('name')}) AS name, lower({strip('segment')}) AS segment FROM {_DUP})"
ORACLE["detect_exact_duplicates"] = _with(
    _DUP,
    issue("exact_duplicates", None, "'MEDIUM'", f"count(*) - (SELECT count(*) FROM {_DISTINCT})", "count(*)", _DUP, "dedupe_exact"),
)
ORACLE["detect_possible_duplicates"] = _with(
    _DUP,
    issue(
        "possible_duplicates", None, "'LOW'", f"(SELECT count(*) FROM {_DISTINCT}) - (SELECT count(*) FROM {_LOOSE})",
        "count(*)", _DUP, "flag_for_review",
    ),
)
ORACLE["detect_missing"] = _with(
    "dirty_events",
    " UNION ALL ".join(missing(c, "dirty_events") for c in ("event_id", "user_id", "event_type", "value", "empty_col")),
)
_CUSTOMER_TEXTS = ("name", "status", "amount", "email", "phone", "segment")
ORACLE["detect_blank_strings"] = _with("dirty_customer", " UNION ALL ".join(blanks(c, "dirty_customer") for c in _CUSTOMER_TEXTS))
ORACLE["detect_whitespace"] = _with("dirty_customer", " UNION ALL ".join(spaces(c, "dirty_customer") for c in _CUSTOMER_TEXTS))
ORACLE["detect_case_variants"] = _with("dirty_events", case_variants("event_type", "dirty_events"))
ORACLE["detect_case_variants_documents"] = _with(
    _DUP, case_variants("name", _DUP) + " UNION ALL " + case_variants("segment", _DUP)
)
_NUMERIC = rf"regexp_full_match({strip('qty_text')}, '-?\d+([.,]\d+)?')"
ORACLE["detect_numbers_as_text"] = _with(
    "dirty_lineitem",
    issue(
        "numbers_as_text", "qty_text", "'MEDIUM'", n(_NUMERIC), "count(qty_text)", "dirty_lineitem", "to_numeric_strict",
        first_values(strip("qty_text"), _NUMERIC, "dirty_lineitem", "l_orderkey * 10 + l_linenumber"),
    )
    + " AND a >= 0.9 * t",
)
ORACLE["detect_outliers"] = " UNION ALL ".join(
    outliers(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
ORACLE["detect_outliers_events"] = " UNION ALL ".join(outliers(c, "events", "event_id") for c in ("event_id", "value"))
_NO_DATE = f"{strip('order_date')} <> '' AND {day('order_date', False)} IS NULL"
ORACLE["detect_dates"] = _with(
    "dirty_orders",
    issue(
        "inconsistent_dates", "order_date", "'MEDIUM'", n(_NO_DATE), n(f"{strip('order_date')} <> ''"), "dirty_orders",
        "normalize_dates", first_values(strip("order_date"), _NO_DATE, "dirty_orders", "o_orderkey"),
    ),
)
ORACLE["detect_emails"] = _with("dirty_customer", emails("dirty_customer", "c_custkey"))
ORACLE["detect_phones"] = _with("dirty_customer", phones("dirty_customer", "c_custkey"))
_ALL = " UNION ALL ".join(
    [
        *[missing(c, "dirty_customer") for c, _ in CUSTOMER_COLUMNS],
        *[blanks(c, "dirty_customer") for c in _CUSTOMER_TEXTS],
        *[spaces(c, "dirty_customer") for c in _CUSTOMER_TEXTS],
        *[case_variants(c, "dirty_customer") for c in _CUSTOMER_TEXTS],
        *[outliers(c, "dirty_customer", "c_custkey") for c in ("c_custkey", "c_acctbal")],
        emails("dirty_customer", "c_custkey"),
        phones("dirty_customer", "c_custkey"),
    ]
)
ORACLE["analyze_all"] = _with("dirty_customer", _ALL)
ORACLE["issue_summary"] = _with(
    "dirty_customer",
    f"""SELECT (SELECT count(*) FROM dirty_customer) AS row_count, CAST(8 AS BIGINT) AS column_count, count(*) AS issues,
      {n("severity = 'HIGH'")} AS high_issues, {n("severity = 'MEDIUM'")} AS medium_issues,
      {n("severity = 'LOW'")} AS low_issues FROM ({_ALL})""",
)
ORACLE["issue_rules"] = _with(
    "dirty_customer", f"SELECT suggested_action AS action, column_name, false AS approved FROM ({_ALL})"
)
ORACLE["safe_profile"] = _with(
    "dirty_customer",
    """SELECT count(*) AS row_count, 'name' AS second_column, count(DISTINCT name) AS second_distinct, false AS leaks
       FROM dirty_customer""",
)

# Proposals and passes ---------------------------------------------------------------------------

_SALES = "messy_sales"
_SALES_TEXTS = ("region", "sold_on", "amount", "label", "note")


def _probe(x: str) -> str:
    bare = rf"regexp_replace({strip(x)}, 'USD|EUR|GBP|U\$S|US\$|[$€£\s]', '', 'g')"
    bare = rf"regexp_replace({bare}, '^\((.+)\)$', '\1')"
    return f"TRY_CAST(replace(replace(rtrim({bare}, '%'), '.', ''), ',', '.') AS DOUBLE)"


def _shape(name: str) -> str:
    filled = f"{strip(name)} <> ''"
    return f"""SELECT '{name}' AS column_name, bool_or({name} <> {strip(name)}) AS outer_space,
      bool_or(regexp_matches({name}, '[\\r\\n\\t]|[\\x{{00a0}}\\x{{200b}}\\x{{feff}}]')) AS invisibles,
      count(DISTINCT lower({strip(name)})) FILTER (WHERE {filled}) > 1 AND
        count(DISTINCT {strip(name)}) FILTER (WHERE {filled}) > count(DISTINCT lower({strip(name)})) FILTER (WHERE {filled}) AS mixed_case,
      {n(filled)} AS filled, {n(f"{filled} AND {day(strip(name), True)} IS NOT NULL")} AS dates,
      {n(f"{filled} AND {_probe(name)} IS NOT NULL")} AS numbers,
      coalesce(bool_or({filled} AND regexp_matches({name}, '[$€£]|,|\\.|\\(|%')), false) AS evidence,
      {n(f"{filled} AND ends_with({name}, '%')")} AS percents FROM {_SALES}"""


ORACLE["auto_propose"] = _with(
    _SALES,
    f"""SELECT column_name, outer_space, invisibles, mixed_case, filled, dates, numbers,
      CASE WHEN dates >= 0.8 * filled AND dates > 0 THEN 'date'
           WHEN numbers >= 0.8 * filled AND evidence AND (percents = 0 OR percents >= 0.8 * filled) THEN 'number'
           ELSE 'text' END AS kind,
      numbers >= 0.8 * filled AND evidence AND percents >= 0.8 * filled AS percent
      FROM ({" UNION ALL ".join(_shape(c) for c in _SALES_TEXTS)})""",
)


def _clean_sales(extra: str = "") -> str:
    """Trim, invisibles and title on the flagged columns, then dates, numbers and nulls."""
    numbered = numbers("messy_sales", "amount")
    return f"""SELECT {extra} {day(strip('sold_on'), True)} AS sold_on, number AS amount,
      {title(strip('label'))} AS label, {blank(invisibles('note'))} AS note FROM ({numbered})"""


ORACLE["multipass_clean"] = _with(_SALES, f"SELECT DISTINCT * FROM ({_clean_sales('o_orderkey, region,')})")
ORACLE["multipass_pass1_only"] = _with(
    _SALES,
    f"""SELECT o_orderkey, region, {strip('sold_on')} AS sold_on, {strip('amount')} AS amount, {title('label')} AS label,
      {invisibles('note')} AS note FROM {_SALES}""",
)
ORACLE["multipass_row_counts"] = _with(
    _SALES,
    f"""SELECT * FROM (VALUES ('pass1'), ('pass2')) p(pass_name), (SELECT count(*) AS rows_before, count(*) AS rows_after,
        5 AS columns_before, 5 AS columns_after FROM {_SALES})
      UNION ALL SELECT 'pass3', (SELECT count(*) FROM {_SALES}),
        (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_clean_sales('region,')}))), 5, 5""",
)
ORACLE["proposal_intake"] = _with(
    "responses",
    """SELECT event_id, CAST(0 AS INTEGER) AS ordinal, action, kind AS column_name, 'seen' AS reason,
      CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 2 THEN 1.5 WHEN 3 THEN 1.0 END::DOUBLE AS confidence,
      CASE WHEN event_id % 2 = 0 THEN '{"format":"lower"}' ELSE '{}' END AS parameters,
      action <> 'drop_table' AND event_id % 4 IN (0, 3) AS accepted,
      CASE WHEN action = 'drop_table' THEN 'unknown action' WHEN event_id % 4 = 1 THEN 'confidence is not a number'
        WHEN event_id % 4 = 2 THEN 'confidence is out of range' END AS note
      FROM (SELECT event_id, event_type AS kind, CASE event_type WHEN 'click' THEN 'trim_text' WHEN 'error' THEN 'drop_table'
        ELSE 'normalize_case' END AS action FROM events)
      UNION ALL SELECT event_id, 1, 'blank_to_null', NULL, '', 0.25, '{}', true, NULL FROM events""",
)

# Validation and audit ---------------------------------------------------------------------------

_KEPT = f"""SELECT * FROM (SELECT c_custkey, {blank(strip('name'))} AS name, {junk('status')} AS status, number AS amount,
    upper(email) AS email, phone, segment, c_acctbal FROM ({numbers('dirty_customer', 'amount')}))
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY c_custkey) = 1"""
_AUDITED = [c for c, _ in CUSTOMER_COLUMNS]
ORACLE["validate_ok"] = "SELECT column_name, CAST(0 AS BIGINT) AS differing FROM (VALUES " + ", ".join(
    f"('{c}')" for c in ["(missing rows)", "(extra rows)", *_AUDITED]
) + ") v(column_name)"
ORACLE["validate_tampered"] = _with(
    "dirty_customer",
    f"""SELECT '(missing rows)' AS column_name, {n("segment = 'MACHINERY'")} AS differing FROM kept
      UNION ALL SELECT 'status', {n("segment = 'BUILDING'")} FROM kept
      UNION ALL SELECT column_name, 0 FROM (VALUES ('(extra rows)'), {", ".join(f"('{c}')" for c in _AUDITED if c != "status")}) v(column_name)""",
    kept=_KEPT,
)
ORACLE["validate_multiset"] = _with(
    "dirty_dup_customer",
    f"""SELECT name, segment, count(*) - 1 AS surplus FROM (SELECT {strip('name')} AS name, segment FROM
      (SELECT DISTINCT name, segment FROM dirty_dup_customer)) GROUP BY ALL HAVING count(*) > 1""",
)
ORACLE["authorisation_violations"] = """SELECT event_id, event_type AS action, user_id AS column_name FROM events
    WHERE event_type NOT IN ('error', 'purchase')"""


def _change(position: int, action: str, name: str, before: str, after: str, changed: str, summary: str) -> str:
    return f"""SELECT {position} AS position, '{action}' AS action, '{name}' AS column_name, {before} AS nulls_before,
      {after} AS nulls_after, {changed} AS values_changed, {summary} AS summary FROM
      (SELECT {n('"' + name + '" IS NULL') if name != 'GLOBAL' else 'max(0)'} AS nb FROM dirty_customer) b,
      (SELECT {n('"' + name + '" IS NULL') if name != 'GLOBAL' else 'max(0)'} AS na FROM kept) a,
      (SELECT {n(f'k."{name}" IS DISTINCT FROM d."{name}"') if name not in ('GLOBAL', 'amount') else 'max(0)'} AS x,
              {n('k.amount IS NOT NULL OR d.amount IS NOT NULL')} AS typed
       FROM kept k JOIN dirty_customer d USING (c_custkey)) c"""


def _texts(changed: str) -> str:
    parts = [
        "CASE WHEN na > nb THEN 'nulls: +' || (na - nb) END",
        f"CASE WHEN {changed} > 0 THEN 'changed: ' || {changed} END",
        "CASE WHEN na < nb THEN 'nulls: -' || (nb - na) END",
    ]
    return f"coalesce(nullif(concat_ws('; ', {', '.join(parts)}), ''), 'no visible change')"


_NULLS_IN = " + ".join(n(f"{c} IS NULL") for c in _AUDITED)
_TRANSFORMS = " UNION ALL ".join(
    [
        _change(0, "trim_text", "name", "nb", "na", "x", _texts("x")),
        _change(1, "blank_to_null", "name", "nb", "na", "x", _texts("x")),
        _change(2, "junk_to_null", "status", "nb", "na", "greatest(0, na - nb)", "'listed placeholders to null'"),
        _change(3, "normalize_numbers", "amount", "nb", "na", "typed", _texts("typed")),
        _change(4, "normalize_case", "email", "nb", "na", "x", _texts("x")),
        _change(
            5, "dedupe_by_key", "GLOBAL", f"(SELECT {_NULLS_IN} FROM dirty_customer)", f"(SELECT {_NULLS_IN} FROM kept)",
            "(SELECT count(*) FROM dirty_customer) - (SELECT count(*) FROM kept)", "'kept the first row per [''name'']'",
        ),
    ]
)
ORACLE["audit_transforms"] = _with("dirty_customer", _TRANSFORMS, kept=_KEPT)
ORACLE["total_changes"] = _with(
    "dirty_customer",
    f"""SELECT CAST(sum(values_changed) + (SELECT count(*) FROM dirty_customer) - (SELECT count(*) FROM kept) AS BIGINT) AS changes
        FROM ({_TRANSFORMS})""",
    kept=_KEPT,
)
ORACLE["audit_split_merge"] = _with(
    "dirty_customer",
    f"""SELECT 'split_column' AS action, 'name' AS column_name, 'string' AS input_type, 'string' AS output_type,
        {n('name IS NULL')} AS nulls_before, {n('name IS NULL')} AS nulls_after, count(*) AS values_changed FROM dirty_customer
      UNION ALL SELECT 'merge_columns', 'contact', 'string+string', 'string', {n('status IS NULL')}, 0, count(*) FROM dirty_customer""",
)
ORACLE["loss_counts"] = _with(
    "dirty_customer",
    f"""SELECT 0 AS position, 'junk_to_null' AS action, 'status' AS column_name, {n('status IS NOT NULL AND s IS NULL')} AS lost FROM step
      UNION ALL SELECT 1, 'normalize_numbers', 'amount', {n('amount IS NOT NULL AND number IS NULL')} FROM step
      UNION ALL SELECT 2, 'replace_values', 'email', {n("ends_with(email, '@mail')")} FROM step
      UNION ALL SELECT 4, 'normalize_dates', 'phone', count(phone) FROM (SELECT * FROM step
        QUALIFY row_number() OVER (PARTITION BY s ORDER BY c_custkey) = 1)""",
    step=f"SELECT *, {junk('status', _quote('n.d.'), True)} AS s FROM ({numbers('dirty_customer', 'amount')})",
)

# Batch ------------------------------------------------------------------------------------------

_LABELS = f"""SELECT region, o_orderkey, label AS label0, note AS note0, {title('label')} AS label, {blank(invisibles('note'))} AS note
    FROM {_SALES}"""
_FIRST = "row_number() OVER (PARTITION BY region, {} ORDER BY o_orderkey) = 1"
ORACLE["batch_clean"] = _with(
    _SALES,
    f"""SELECT region, o_orderkey, sold_on, CASE WHEN amount IS NULL THEN NULL ELSE CAST(amount AS VARCHAR) END AS amount, label, note
      FROM ({_clean_sales('region, o_orderkey,')}) QUALIFY {_FIRST.format('sold_on, amount, label, note')}""",
)
# The label gets one changing rule and a null rule, the note an invisibles rule and a null rule;
# each of the two row rules reports the removed rows next to the removal itself.
_ITEMS = f"""SELECT region AS source, 'ok' AS status, count(*) AS rows_before, {n('kept')} AS rows_after,
      {n('NOT kept')} AS rows_removed,
      CAST(2 * {n('kept AND label IS DISTINCT FROM label0')} + 2 * {n('kept AND note IS DISTINCT FROM note0')} +
        3 * {n('NOT kept')} AS BIGINT) AS changes,
      CAST(6 AS BIGINT) AS actions, 'CLEANED' AS result, CAST(NULL AS VARCHAR) AS reason
    FROM (SELECT *, {_FIRST.format('label, note')} AS kept FROM labelled) GROUP BY region"""
ORACLE["batch_items_labels"] = _with(_SALES, _ITEMS, labelled=_LABELS)
# The date has a trim and a date rule; the amount a trim, a number and a null rule, and all its cells
# count as changed, because a text becomes a number.
_WHOLE = f"""SELECT c.region AS source, 'ok' AS status, count(*) AS rows_before, {n('kept')} AS rows_after, {n('NOT kept')} AS rows_removed,
      CAST(2 * {n('kept AND c.sold_on IS DISTINCT FROM m.sold_on')} + 3 * {n('kept AND (m.amount IS NOT NULL OR c.amount IS NOT NULL)')} +
        2 * {n('kept AND c.label IS DISTINCT FROM m.label')} + 2 * {n('kept AND c.note IS DISTINCT FROM m.note')} + 3 * {n('NOT kept')} AS BIGINT) AS changes,
      CAST(11 AS BIGINT) AS actions, 'CLEANED' AS result, CAST(NULL AS VARCHAR) AS reason
    FROM (SELECT *, {_FIRST.format('sold_on, amount, label, note')} AS kept FROM ({_clean_sales('region, o_orderkey,')})) c
    JOIN {_SALES} m USING (o_orderkey) GROUP BY c.region"""
ORACLE["batch_items"] = _with(_SALES, _WHOLE)
ORACLE["batch_summary"] = _with(
    _SALES,
    f"""SELECT count(*) AS files_found, count(*) AS processed_ok, 0 AS processed_invalid, 0 AS errors, count(*) AS cleaned,
      0 AS unchanged, CAST(sum(rows_before) AS BIGINT) AS total_rows_before, CAST(sum(rows_after) AS BIGINT) AS total_rows_after,
      CAST(sum(rows_removed) AS BIGINT) AS total_rows_removed, CAST(sum(changes) AS BIGINT) AS total_changes FROM ({_WHOLE})""",
)
ORACLE["batch_self_check"] = "SELECT true AS consistent"

ORACLE["clean_segments"] = _with(
    "dirty_customer",
    f"""SELECT segment, count(*) AS customers, count(s) AS with_status, round(sum(number), 2) AS total_amount
      FROM (SELECT *, {junk('status', _quote('n.d.'), True)} AS s FROM ({numbers('dirty_customer', 'amount')})
        QUALIFY row_number() OVER (PARTITION BY email, phone ORDER BY c_custkey) = 1) GROUP BY segment""",
)

# Sources, sinks and streams ---------------------------------------------------------------------

ORACLE["recheck_segments"] = ORACLE["clean_segments"]
ORACLE["recheck_sales"] = _with(_SALES, f"SELECT DISTINCT * FROM ({_clean_sales('o_orderkey, region,')})")
ORACLE["csv_roundtrip"] = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN regexp_matches("text", '^[=+@\\t-]')
    THEN '''' || "text" ELSE "text" END AS text FROM documents"""
ORACLE["validate_orders_buckets"] = """
WITH c AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 991 <> 7 THEN o_orderstatus END AS o_orderstatus,
    o_totalprice + CASE WHEN o_orderkey % 983 = 3 THEN 1 ELSE 0 END AS o_totalprice, o_orderdate, true AS here FROM orders WHERE o_orderkey % 997 <> 5
  UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_totalprice, o_orderdate, true FROM orders WHERE o_orderkey % 499 = 6),
e AS (SELECT *, true AS there FROM orders),
j AS (SELECT e.*, c.here, c.o_orderstatus AS s, c.o_totalprice AS p, c.o_orderdate AS d FROM e FULL JOIN c USING (o_orderkey))
SELECT '(missing rows)' AS column_name, count(*) FILTER (here IS NULL) AS differing FROM j
UNION ALL SELECT '(extra rows)', count(*) FILTER (there IS NULL) FROM j
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (here AND there AND s IS DISTINCT FROM o_orderstatus) FROM j
UNION ALL SELECT 'o_totalprice', count(*) FILTER (here AND there AND p IS DISTINCT FROM o_totalprice) FROM j
UNION ALL SELECT 'o_orderdate', count(*) FILTER (here AND there AND d IS DISTINCT FROM o_orderdate) FROM j"""
ORACLE["quoted_scan_blocks"] = """
WITH d AS (SELECT lang, '"a";' || text || chr(10) AS note FROM documents)
SELECT lang, count(*) AS texts, sum(length(note) - length(replace(note, chr(10), '')))::BIGINT AS breaks,
  sum(length(note))::BIGINT AS chars, min(md5(note)) AS first_md5, max(md5(note)) AS last_md5 FROM d GROUP BY lang"""
ORACLE["delimiter_sniff"] = _with(
    "dirty_customer", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, nullif(amount, '') AS amount, phone FROM dirty_customer"
)
ORACLE["header_normalise"] = """SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS "Columna_2",
    CAST(n_regionkey AS VARCHAR) AS region FROM nation"""
ORACLE["encoding_detect"] = "SELECT doc_id || '#' || replace(lower(lang), 'e', '€') AS line FROM documents"
ORACLE["infer_column_types"] = """SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber,
      CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate), l_orderkey + 1234567890123456789 AS wide,
    '9' || CAST(l_orderkey + 1234567890123456789 AS VARCHAR) AS wider FROM lineitem"""
ORACLE["ragged_rows"] = """SELECT CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'kept' END AS part,
    CASE event_type WHEN 'error' THEN 'too many fields' WHEN 'view' THEN NULL ELSE event_type END AS kind, count(*) AS n
    FROM events GROUP BY ALL"""
ORACLE["file_inventory"] = """SELECT name, '.parquet' AS suffix, 'unsupported file type' AS problem FROM (VALUES ('region'),
    ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'),
    ('pages'), ('benchmark'), ('labels'), ('conversations')) t(name)"""
ORACLE["incremental_folder_clean"] = _with(
    _SALES,
    f"""SELECT CASE WHEN region = 'F' THEN 0 ELSE 1 END AS batch, o_orderkey, region, sold_on,
      number AS amount, {title('label')} AS label, nullif(note, '') AS note FROM ({numbers(_SALES, 'amount')})""",
)
ORACLE["folder_sync"] = _with(
    _SALES,
    f"""SELECT o_orderkey, region, sold_on, number AS amount, {title('label')} AS label, nullif(note, '') AS note
      FROM ({numbers(_SALES, 'amount')}) WHERE region = 'P' OR region = 'O' AND o_orderkey % 2 = 0""",
)
ORACLE["text_clean_run"] = _with(
    _SALES,
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, region, sold_on, number AS amount, {title('label')} AS label,
      nullif(note, '') AS note FROM ({numbers(_SALES, 'amount')})""",
)


def _published(cell: str) -> str:
    """A text cell as the text sink writes it and a reader gets it back."""
    return f"nullif(CASE WHEN left({cell}, 1) IN ('=', '+', '-', '@') THEN chr(39) || {cell} ELSE {cell} END, '') AS {cell}"


ORACLE["csv_roundtrip_customer"] = _with(
    "dirty_customer",
    "SELECT c_custkey, c_acctbal, "
    + ", ".join(map(_published, ("name", "status", "amount", "email", "phone", "segment")))
    + " FROM dirty_customer",
)
ORACLE["csv_one_column"] = _with("dirty_customer", f"SELECT {_published('name')}, count(*) AS n FROM dirty_customer GROUP BY 1")
ORACLE["intake_plan_size"] = f"""SELECT event_id % 10 AS team, count(*) AS n_rules FROM ({ORACLE['proposal_intake']})
    WHERE accepted GROUP BY 1"""
ORACLE["ragged_inner_quotes"] = """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'rejected' ELSE 'kept' END AS part,
    CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 3 = 0 THEN 'too many fields' ELSE '5" ' || p_name END AS name,
    CASE WHEN p_partkey % 3 <> 0 THEN '3" bolt' END AS size FROM part"""
# The list runs from 10,000 down to 1. '#n' is found by the greatest odd number that n begins with.
ORACLE["replace_values_long_list"] = """
WITH names AS (SELECT p_partkey, p_partkey % 15000 AS n, p_partkey % 3 = 0 AS inner_part FROM part),
heads AS (SELECT p_partkey, max(CAST(left(CAST(n AS VARCHAR), len) AS BIGINT)) AS hit
  FROM names, range(1, 6) t(len) WHERE inner_part AND len <= length(CAST(n AS VARCHAR))
  AND CAST(left(CAST(n AS VARCHAR), len) AS BIGINT) BETWEEN 1 AND 10000 AND CAST(left(CAST(n AS VARCHAR), len) AS BIGINT) % 2 = 1
  GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN inner_part AND hit IS NOT NULL THEN ' Part' || replace('#' || n, '#' || hit, '<' || hit || '>') || ' '
  WHEN inner_part THEN ' Part#' || n || ' '
  WHEN n % 2 = 0 AND n BETWEEN 1 AND 10000 THEN '<' || n || '>' ELSE ' Part' || n || ' ' END AS value
FROM names LEFT JOIN heads USING (p_partkey)"""
ORACLE["intake_by_segment"] = _with(
    "dirty_customer",
    f"""SELECT c_custkey, segment, CASE WHEN segment = 'BUILDING' THEN nullif({strip('name')}, '') ELSE name END AS name,
      CASE segment WHEN 'AUTOMOBILE' THEN {strip('lower(status)')} WHEN 'MACHINERY' THEN {junk('status')} ELSE status END AS status
    FROM dirty_customer""",
)
ORACLE["folder_rejects"] = """SELECT 'good' AS name, 'ok' AS status, NULL AS error_class, NULL AS reason,
  count(*) AS rows_before, 0 AS unpublished FROM orders
UNION ALL SELECT name, 'error', 'other', reason, NULL, NULL FROM (VALUES
  ('twice', 'duplicate column name ''LABEL'''), ('broken.xlsx', 'unreadable workbook: BadZipFile'),
  ('legacy.xls', 'legacy workbooks are not supported'), ('empty.csv', 'empty file')) t(name, reason)"""
ORACLE["profile_rollup"] = _with(
    _SALES,
    """SELECT column_name, region, label, 2 - GROUPING(region) - GROUPING(label) AS level, count(*) AS cells,
      count(v) AS non_null, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values
    FROM cells GROUP BY column_name, ROLLUP (region, label)""",
    cells=" UNION ALL ".join(
        f"SELECT region, label, '{c}' AS column_name, {c} AS v FROM messy_sales" for c in ("sold_on", "amount", "note")
    ),
)
ORACLE["folder_batch"] = """SELECT 0 AS processed_invalid, 0 AS errors, count(*) AS total_rows_before, 0 AS unpublished FROM orders"""
