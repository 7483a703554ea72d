"""For each query that SQL can express, the same result written for DuckDB."""

from __future__ import annotations

from itertools import combinations

from ..functions.hashing import poisson_steps
from ..operators.curves import LIFT_SHARES, bin_edges
from ..operators.leakage import LEAKY_NAMES
from ..operators.pii import PATTERNS, PERSONAL_NAMES


def cell(value: str) -> str:
    """A cell as the key hash and the fingerprint write it: with its length in front."""
    return f"coalesce(length({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def u(key: str, salt: str = "", seed: int = 42) -> str:
    text = " || ".join(cell(k.strip()) for k in key.split(",")) + f" || '|{seed}|{salt}'"
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def normal(key: str, salt: str) -> str:
    return (
        f"(sqrt(-2.0 * ln(1.0 - {u(key, salt + '#r')}))"
        f" * cos(2.0 * pi() * {u(key, salt + '#a')}))"
    )


_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice::DECIMAL(18,2)")
LINEITEM = f"""li AS (SELECT *, {' || '.join(cell(k) for k in _KEY)} AS key FROM lineitem)"""

BINARY = f"""{LINEITEM}, b0 AS (SELECT key, l_linestatus, l_linenumber,
  (l_returnflag = 'R')::INTEGER AS y, {u('key')} AS u FROM li),
b1 AS (SELECT key, l_linestatus, l_linenumber, y,
  floor((0.25 * y + 0.75 * u) * 1000) / 1000 AS p FROM b0),
scored AS (SELECT *, (p >= 0.5)::INTEGER AS yhat FROM b1)"""

CLASSES = f"""{LINEITEM}, c0 AS (SELECT key, l_linestatus, l_linenumber, l_returnflag AS y,
  {u('key')} AS u FROM li),
scored AS (SELECT *, CASE WHEN u < 0.1 THEN 'A' WHEN u < 0.2 THEN 'N' WHEN u < 0.3 THEN 'R'
  ELSE y END AS yhat FROM c0)"""

NUMBERS = f"""{LINEITEM}, scored AS (SELECT key, l_linestatus, l_linenumber,
  l_extendedprice AS y, 1000 * l_quantity + 25000 * {u('key')} AS yhat FROM li)"""

GAPPY = """gappy AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority
  FROM orders)"""

PARTED = f"""{LINEITEM}, p0 AS (SELECT key,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice, l_linenumber,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_linestatus END AS l_linestatus, l_returnflag,
  {u('key')} AS u FROM li),
parted AS (SELECT * EXCLUDE (u), CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.4 THEN 'val'
  ELSE 'train' END AS split FROM p0)"""

LEAKY = f"""{LINEITEM}, leaky AS (SELECT l_quantity, l_discount, l_extendedprice, l_returnflag,
  7.0::DOUBLE AS flat, 2 * l_extendedprice + 1 AS price_twin,
  l_extendedprice + 26000 * ({u('key')} - 0.5) AS price_score FROM li)"""

SQL: dict[str, str] = {}


def _missing_rows(table: str, columns: list[str]) -> str:
    total = " + ".join(f"count(*) - count({c})" for c in columns)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS missing_count,"
        f" round_even(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS missing_pct,"
        f" ({total})::BIGINT AS total_missing FROM {table}"
        for c in columns
    )


GAPPY_COLUMNS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
]


def _describe(table: str, columns: list[str], mean_digits: int = 6) -> str:
    quart = lambda c, q: f"round(quantile_cont({c}::DOUBLE, {q}), 6)"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}::DOUBLE), {mean_digits}) AS mean,"
        f" round(stddev_samp({c}::DOUBLE), 6) AS std, round(min({c})::DOUBLE, 6) AS min,"
        f" {quart(c, 0.25)} AS p25, {quart(c, 0.5)} AS p50, {quart(c, 0.75)} AS p75,"
        f" round(max({c})::DOUBLE, 6) AS max FROM {table}"
        for c in columns
    )


# --- sources

SQL["scan_named"] = "SELECT * FROM orders"
SQL["csv_types"] = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority,
  o_orderkey % 2 = 0 AS even FROM orders"""
SQL["csv_files"] = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority
  FROM orders"""
SQL["concat_by_name"] = """SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey, NULL::DOUBLE, o_orderpriority FROM orders"""
_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice::DECIMAL(20,4)", "epoch_us(o_orderdate)",
           "o_orderpriority")
SQL["fingerprint"] = f"""WITH d AS (SELECT md5({' || '.join(cell(c) for c in _ORDERS)}) AS m FROM orders),
t AS (SELECT count(*) AS n_rows,
  sum(('0x' || substr(m, 1, 16))::UBIGINT::HUGEINT)::VARCHAR || ','
  || sum(('0x' || substr(m, 17, 16))::UBIGINT::HUGEINT)::VARCHAR AS content_sum FROM d)
SELECT n_rows, content_sum, sha256({cell("'orders'")} || {cell("""'o_orderkey:bigint,o_custkey:bigint,'
  || 'o_orderstatus:string,o_totalprice:decimal(20,4),o_orderdate:bigint,o_orderpriority:string'""".replace(chr(10), " "))}
  || {cell('n_rows')} || {cell('content_sum')}) AS fingerprint FROM t"""

# --- profile

_GAPPY_TYPES = [
    ("o_orderkey", "bigint", "numeric"),
    ("o_custkey", "bigint", "numeric"),
    ("o_orderstatus", "string", "categorical"),
    ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "datetime"),
    ("o_orderpriority", "string", "categorical"),
]
SQL["profile_columns"] = " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS position, '{c}' AS \"column\", '{t}' AS dtype, '{k}' AS kind,"
    " count(*) AS n_rows FROM orders"
    for i, (c, t, k) in enumerate(_GAPPY_TYPES)
)
SQL["profile_shape"] = "SELECT count(*) AS n_rows, 6::INTEGER AS n_columns FROM orders"
SQL["profile_missing"] = f"WITH {GAPPY} " + _missing_rows("gappy", GAPPY_COLUMNS)
SQL["profile_numeric"] = _describe(
    "lineitem",
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
     "l_discount", "l_tax"],
    mean_digits=7,
)
SQL["profile_numeric_gaps"] = f"WITH {GAPPY} " + _describe(
    "gappy", ["o_orderkey", "o_custkey", "o_totalprice"]
)


def _counts(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {table}"
        f" WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


SQL["profile_categorical"] = f"""WITH {GAPPY},
vc AS ({_counts('gappy', ['o_orderstatus', 'o_orderpriority'])}),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank,
  count(*) OVER (PARTITION BY "column") AS unique_values FROM vc)
SELECT "column", unique_values, value AS most_frequent, n AS most_frequent_count FROM r WHERE rank = 1"""
SQL["top_values"] = f"""WITH vc AS ({_counts('customer', ['c_name', 'c_mktsegment'])}),
r AS (SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS rank,
  value, n FROM vc) SELECT * FROM r WHERE rank <= 5"""
SQL["distinct_counts"] = f"WITH {GAPPY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_values FROM gappy"
    for c in GAPPY_COLUMNS
)
_LINEITEM_NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
_LINEITEM_OTHER = ["l_returnflag", "l_linestatus", "l_shipdate"]
SQL["candidate_targets"] = (
    "WITH d AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_values,"
        f" {c in _LINEITEM_NUMERIC} AS number FROM lineitem"
        for c in _LINEITEM_NUMERIC + _LINEITEM_OTHER
    )
    + """) SELECT "column", unique_values, CASE WHEN unique_values BETWEEN 2 AND 20
  THEN 'classification_candidate' ELSE 'regression_candidate' END AS type FROM d
  WHERE unique_values BETWEEN 2 AND 20 OR (number AND unique_values > 20)"""
)
SQL["insights"] = f"""WITH {GAPPY}, m AS (SELECT count(*) AS n,
  (count(*) - count(o_totalprice)) + (count(*) - count(o_orderpriority)) AS gaps FROM gappy)
SELECT 1::INTEGER AS position, 'Dataset has ' || n || ' rows and 6 columns' AS insight FROM m
UNION ALL SELECT 2, 'Missing data: ' || gaps || ' total missing values' FROM m
UNION ALL SELECT 3, 'Data types: 3 numeric, 2 categorical' FROM m"""

_LEAKY_PAIRS = combinations(
    ["l_quantity", "l_discount", "l_extendedprice", "flat", "price_twin", "price_score"], 2
)
SQL["feature_correlations"] = f"WITH {LEAKY}, c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0"
    f" THEN corr({a}, {b}) END AS r FROM leaky"
    for a, b in _LEAKY_PAIRS
) + ") SELECT feature1, feature2, round(r, 6) AS correlation FROM c WHERE abs(r) > 0.7"
_FENCED = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", lo AS low, hi AS high, count(*) FILTER (v < lo OR v > hi) AS n_outliers
FROM (SELECT {c}::DOUBLE AS v FROM o), (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM o))
GROUP BY lo, hi"""
    for c in ("o_custkey", "o_totalprice", "skewed")
)
SQL["outliers"] = f"""WITH o AS (SELECT o_custkey, o_totalprice, pow(o_totalprice / 500000, 6.0) AS skewed
  FROM orders), f AS ({_FENCED})
SELECT "column", round(low, 6) AS low, round(high, 6) AS high, n_outliers FROM f WHERE n_outliers > 0"""

# --- leakage

_LEAKY_NUMERIC = ["l_quantity", "l_discount", "flat", "price_twin", "price_score"]
_CORRELATIONS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN stddev_pop({c}) > 0 THEN corr({c}, l_extendedprice) END"
    " AS r FROM leaky"
    for c in _LEAKY_NUMERIC
)
SQL["leakage_correlations"] = f"""WITH {LEAKY}, c AS ({_CORRELATIONS})
SELECT "column", round(r, 6) AS correlation FROM c"""


def _name_hits(columns: list[str], patterns: tuple[str, ...], label: str) -> str:
    names = ", ".join(f"('{c}')" for c in columns)
    parts = ", ".join(f"({i}, '{p}')" for i, p in enumerate(patterns))
    return (
        f"SELECT \"column\", min_by(pattern, pos) AS {label} FROM (VALUES {names}) n(\"column\")"
        f" JOIN (VALUES {parts}) p(pos, pattern) ON contains(lower(\"column\"), pattern)"
        ' GROUP BY "column"'
    )


_LEAKY_COLUMNS = ["l_quantity", "l_discount", "l_returnflag", "flat", "price_twin", "price_score"]
_FINDINGS = f"""findings AS (SELECT "column", CASE WHEN abs(r) > 0.99 THEN 'perfect_correlation'
  ELSE 'high_correlation' END AS issue, NULL::VARCHAR AS pattern, round(r, 6) AS correlation,
  CASE WHEN abs(r) > 0.99 THEN 'block' ELSE 'warn' END AS severity FROM c WHERE abs(r) > 0.95
UNION ALL SELECT "column", 'suspicious_name', pattern, NULL, 'warn'
  FROM ({_name_hits(_LEAKY_COLUMNS, LEAKY_NAMES, 'pattern')}))"""
SQL["leakage_findings"] = f"WITH {LEAKY}, c AS ({_CORRELATIONS}), {_FINDINGS} SELECT * FROM findings"
SQL["leakage_verdict"] = f"""WITH {LEAKY}, c AS ({_CORRELATIONS}), {_FINDINGS},
t AS (SELECT count(*) FILTER (severity = 'block') AS b, count(*) FILTER (severity = 'warn') AS w
  FROM findings)
SELECT CASE WHEN b > 0 THEN 'block' WHEN w > 0 THEN 'warn' ELSE 'pass' END AS status,
  b AS blocking_issues, w AS warnings, 6::INTEGER AS columns_checked FROM t"""
SQL["leakage_time_check"] = """WITH t AS (SELECT CASE WHEN event_id % 100 = 3 THEN 'soon'
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS txt FROM events)
SELECT 'at' AS "column", 'invalid_datetime_format' AS issue, NULL::VARCHAR AS pattern,
  NULL::DOUBLE AS correlation, 'warn' AS severity
FROM (SELECT count(*) AS bad FROM t WHERE try_cast(txt AS TIMESTAMP) IS NULL) WHERE bad > 0"""

# --- personal data


def _found(column: str, pattern: str) -> str:
    return f"regexp_extract_all({column}, '{PATTERNS[pattern]}', 0, 'i')"


def _scan(table: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, '{c}' AS \"column\", sum(len({_found(c, p)}))::BIGINT AS n_matches,"
        f" count(*) FILTER (len({_found(c, p)}) > 0) AS n_rows FROM {table}"
        for p in PATTERNS
        for c in columns
    )
    return f"SELECT * FROM ({parts}) WHERE n_matches > 0"


SQL["pii_scan"] = _scan("documents", ["text", "lang", "source"])
SQL["pii_scan_pages"] = _scan("pages", ["url", "html"])
_PER_ROW = ", ".join(
    f"len({_found(c, p)}) AS {p}_{c}" for p in PATTERNS for c in ("text", "lang", "source")
)
_CELLS = [f"{p}_{c}" for p in PATTERNS for c in ("text", "lang", "source")]
_PATTERNS_FOUND = " + ".join(
    "(" + " + ".join(f"sum({p}_{c})" for c in ("text", "lang", "source")) + " > 0)::INTEGER"
    for p in PATTERNS
)
_COLUMNS_FOUND = " + ".join(
    "(" + " + ".join(f"sum({p}_{c})" for p in PATTERNS) + " > 0)::INTEGER"
    for c in ("text", "lang", "source")
)
SQL["pii_summary"] = f"""WITH n AS (SELECT {_PER_ROW} FROM documents),
t AS (SELECT sum({' + '.join(_CELLS)})::BIGINT AS total, count(*) FILTER ({' + '.join(_CELLS)} > 0)
  AS rows_affected, ({_PATTERNS_FOUND})::INTEGER AS patterns_found,
  ({_COLUMNS_FOUND})::INTEGER AS columns_affected FROM n)
SELECT CASE WHEN total = 0 THEN 'none' WHEN total < 10 THEN 'low' WHEN total < 100 THEN 'medium'
  ELSE 'high' END AS risk_level, total AS total_matches, patterns_found, columns_affected,
  rows_affected FROM t"""
_MATCH_ROWS = " UNION ALL ".join(
    f"SELECT '{p}' AS pattern, '{c}' AS \"column\", doc_id AS key, {c} AS txt,"
    f" {_found(c, p)} AS found FROM documents"
    for p in PATTERNS
    for c in ("text", "lang", "source")
)
SQL["pii_samples"] = f"""WITH m AS ({_MATCH_ROWS}),
e AS (SELECT pattern, "column", key, txt, found, unnest(range(len(found))) AS pos FROM m
  WHERE len(found) > 0),
r AS (SELECT pattern, "column", row_number() OVER (PARTITION BY pattern, "column" ORDER BY key, pos)
  ::INTEGER AS sample, key, pos::INTEGER AS position, found[pos + 1] AS value,
  CASE WHEN length(txt) > 50 THEN substr(txt, 1, 50) || '...' ELSE txt END AS context FROM e)
SELECT * FROM r WHERE sample <= 5"""


def _redacted(column: str, upto: int | None = None) -> str:
    out = column
    for pattern in list(PATTERNS.values())[:upto]:
        out = f"regexp_replace({out}, '{pattern}', '[REDACTED]', 'gi')"
    return out


SQL["pii_redact"] = f"""SELECT doc_id, {_redacted('text')} AS text, {_redacted('lang')} AS lang,
  {_redacted('source')} AS source, n_chars FROM documents"""
SQL["pii_redaction_log"] = (
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, '{c}' AS \"column\","
        f" sum(len({_found(_redacted(c, i), p)}))::BIGINT AS n_redactions FROM pages"
        for i, p in enumerate(PATTERNS)
        for c in ("url", "html")
    )
    + ") WHERE n_redactions > 0"
)
SQL["pii_names"] = (
    "SELECT \"column\", keyword, CASE WHEN keyword IN ('ssn', 'social', 'password', 'secret')"
    " THEN 'high' ELSE 'medium' END AS risk_level FROM ("
    + _name_hits(
        ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], PERSONAL_NAMES, "keyword"
    )
    + ")"
)

# --- splits


def _allocate(source: str, total: str, out: str) -> str:
    """Largest-remainder shares of ``total`` over the strata of ``source(s, n)``."""
    return f"""{out}_x AS (SELECT s, n, n * {total} / (SELECT sum(n) FROM {source}) AS exact FROM {source}),
{out}_f AS (SELECT s, n, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, s)
  AS place FROM {out}_x),
{out} AS (SELECT s, (base + (place <= {total} - (SELECT sum(base) FROM {out}_f))::INTEGER)::BIGINT AS n
  FROM {out}_f)"""


SQL["split_random"] = f"""WITH sizes AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1),
tot AS (SELECT sum(n) AS n, ceil(0.2 * sum(n)) AS n_test FROM sizes),
tot2 AS (SELECT n, n_test, ceil(0.25 * (n - n_test)) AS n_val FROM tot),
{_allocate('sizes', '(SELECT n - n_test FROM tot2)', 'rest')},
{_allocate('rest', '(SELECT n - n_test - n_val FROM tot2)', 'tr')},
r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY
  {u('o_orderkey::VARCHAR')}, {u('o_orderkey::VARCHAR', 'tie')}) AS k FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN k <= sizes.n - rest.n THEN 'test'
  WHEN k <= sizes.n - tr.n THEN 'val' ELSE 'train' END AS split
FROM r JOIN sizes ON o_orderstatus = sizes.s JOIN rest ON rest.s = sizes.s JOIN tr ON tr.s = sizes.s"""
SQL["split_random_unstratified"] = f"""WITH t AS (SELECT count(*) AS n, ceil(0.2 * count(*)) AS a
  FROM orders),
t2 AS (SELECT n, a, a + ceil(0.25 * (n - a)) AS b FROM t),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {u('o_orderkey::VARCHAR')}) AS k FROM orders)
SELECT o_orderkey, CASE WHEN k <= a THEN 'test' WHEN k <= b THEN 'val' ELSE 'train' END AS split
FROM r, t2"""
SQL["split_hashed"] = f"""WITH {LINEITEM} SELECT key, CASE WHEN {u('key')} < 0.2 THEN 'test'
  WHEN {u('key')} < 0.4 THEN 'val' ELSE 'train' END AS split FROM li"""


def _time_split(table: str, key: str, at: str, keep: str = "") -> str:
    return f"""r AS (SELECT {key}{keep}, row_number() OVER (ORDER BY {at}, {u(key + '::VARCHAR')}) AS k,
  count(*) OVER () AS n FROM {table}),
parts AS (SELECT {key}{keep}, CASE WHEN k <= floor(floor(n * 0.8) * 0.8) THEN 'train'
  WHEN k <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM r)"""


SQL["split_time"] = f"WITH {_time_split('events', 'event_id', 'ts')} SELECT * FROM parts"
SQL["split_time_ties"] = (
    f"WITH {_time_split('orders', 'o_orderkey', 'o_orderdate::DATE')} SELECT * FROM parts"
)
SQL["split_summary"] = f"""WITH {PARTED} SELECT split, count(*) AS n_rows,
  round(count(*)::DOUBLE / (SELECT count(*) FROM parted), 6) AS proportion FROM parted GROUP BY split"""
SQL["split_classes"] = f"""WITH {PARTED} SELECT split, l_returnflag AS value, count(*) AS n_rows
  FROM parted GROUP BY 1, 2"""
SQL["split_time_ranges"] = f"""WITH {_time_split('events', 'event_id', 'ts', ', ts')}
  SELECT split, min(ts) AS first, max(ts) AS last FROM parts GROUP BY split"""
SQL["folds"] = f"""WITH r AS (SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus)
  AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {u('o_orderkey::VARCHAR', 'fold')}) AS k
  FROM orders)
SELECT o_orderkey, o_orderstatus, (CASE WHEN k <= n // 3 THEN 0 WHEN k <= 2 * n // 3 THEN 1 ELSE 2 END)
  ::INTEGER AS fold FROM r"""

SQL["folds_in_time"] = f"""WITH r AS (SELECT event_id, count(*) OVER () AS n, row_number() OVER
  (ORDER BY ts, {u('event_id::VARCHAR')}) AS k FROM events)
SELECT event_id, (CASE WHEN k <= n // 4 THEN 0 WHEN k <= 2 * n // 4 THEN 1 WHEN k <= 3 * n // 4 THEN 2
  ELSE 3 END)::INTEGER AS fold FROM r"""
SQL["sample_in_proportion"] = f"""WITH sizes AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders
  GROUP BY 1), {_allocate('sizes', '1000', 'share')},
r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY
  {u('o_orderkey::VARCHAR', 'sample')}) AS k FROM orders)
SELECT o_orderkey, o_orderstatus FROM r JOIN share ON s = o_orderstatus WHERE k <= share.n"""

# --- features

SQL["feature_plan"] = f"""WITH {GAPPY}
SELECT 0::INTEGER AS position, 'o_orderkey' AS "column", 'bigint' AS dtype, 0::BIGINT AS missing_count,
  count(DISTINCT o_orderkey) AS unique_values, 'standard_scale' AS transforms FROM gappy
UNION ALL SELECT 1, 'o_totalprice', 'double', count(*) - count(o_totalprice),
  count(DISTINCT o_totalprice), 'impute_median,standard_scale' FROM gappy
UNION ALL SELECT 2, 'o_orderdate', 'timestamp_ntz', 0, count(DISTINCT o_orderdate), '' FROM gappy
UNION ALL SELECT 3, 'o_orderpriority', 'string', count(*) - count(o_orderpriority),
  count(DISTINCT o_orderpriority), 'impute_mode,' || CASE WHEN count(DISTINCT o_orderpriority) > 50
  THEN 'high_cardinality_encode' ELSE 'label_encode' END FROM gappy"""
SQL["feature_plan_summary"] = f"""WITH {GAPPY} SELECT 4::INTEGER AS total_features,
  1::INTEGER AS excluded_features, 2::INTEGER AS numeric_features, 1::INTEGER AS categorical_features,
  ((count(*) > count(o_totalprice))::INTEGER + (count(*) > count(o_orderpriority))::INTEGER)::INTEGER
  AS missing_data_columns FROM gappy"""


def _params(c: str) -> str:
    median = f"(SELECT quantile_cont({c}::DOUBLE, 0.5) FROM parted WHERE split = 'train')"
    filled = f"coalesce({c}::DOUBLE, {median})"
    return (
        f"SELECT '{c}' AS \"column\", {median} AS median, avg({filled}) AS mean,"
        f" stddev_pop({filled}) AS std FROM parted WHERE split = 'train'"
    )


_PARAMS = " UNION ALL ".join(_params(c) for c in ("l_quantity", "l_extendedprice", "l_linenumber"))
SQL["feature_params"] = f"""WITH {PARTED}, params AS ({_PARAMS}) SELECT "column",
  round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std FROM params"""
_WORDS = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", coalesce({c}, 'missing') AS value FROM parted"
    " WHERE split = 'train'"
    for c in ("l_linestatus", "l_returnflag")
)
SQL["vocabulary"] = f"""WITH {PARTED}, words AS ({_WORDS}) SELECT "column", value,
  row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS idx FROM words"""
SQL["label_encode"] = f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS pr,
  {u('o_orderkey::VARCHAR')} AS u FROM orders),
s AS (SELECT o_orderkey, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.4 THEN 'val' ELSE 'train' END AS split,
  pr FROM o),
v AS (SELECT o_orderkey, split, coalesce(CASE WHEN split = 'test' AND o_orderkey % 9 = 0 THEN '9-NEW'
  WHEN o_orderkey % 10 <> 1 THEN pr END, 'missing') AS val FROM s),
w AS (SELECT val, row_number() OVER (ORDER BY val) - 1 AS idx
  FROM (SELECT DISTINCT val FROM v WHERE split = 'train'))
SELECT o_orderkey, coalesce(idx, -1)::BIGINT AS o_orderpriority, split FROM v LEFT JOIN w USING (val)"""


def _scaled(c: str) -> str:
    get = lambda what: f"(SELECT {what} FROM params WHERE \"column\" = '{c}')"
    return f"round((coalesce({c}::DOUBLE, {get('median')}) - {get('mean')}) / {get('std')}, 6) AS {c}"


SQL["apply_plan"] = f"""WITH {PARTED}, params AS ({_PARAMS}), words AS ({_WORDS}),
voc AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx FROM words
  WHERE "column" = 'l_linestatus')
SELECT key, {_scaled('l_quantity')}, {_scaled('l_extendedprice')}, {_scaled('l_linenumber')},
  coalesce(idx, -1)::BIGINT AS l_linestatus, l_returnflag, split
FROM parted LEFT JOIN voc ON coalesce(parted.l_linestatus, 'missing') = voc.value"""

# --- metrics


def _report(source: str, by: str = "", n: str = "n") -> str:
    """CTEs cells, sides and report over ``source`` with y, yhat and optional group columns."""
    g, comma = by, (", " if by else "")
    group = f"GROUP BY {g}{comma}class"
    return f"""sides AS (SELECT {g}{comma}y AS class, {n} AS support, 0 AS predicted,
  CASE WHEN y = yhat THEN {n} ELSE 0 END AS hits FROM {source}
  UNION ALL SELECT {g}{comma}yhat, 0, {n}, 0 FROM {source}),
sums AS (SELECT {g}{comma}class, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted,
  sum(hits)::BIGINT AS hits FROM sides {group}),
report AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0.0)::DOUBLE AS "precision",
  coalesce(hits / nullif(support, 0), 0.0)::DOUBLE AS recall,
  coalesce(2 * hits / nullif(support + predicted, 0), 0.0)::DOUBLE AS f1_score FROM sums)"""


_WEIGHTED = ", ".join(
    f"sum({m} * support) / sum(support) AS {m}" for m in ("f1_score", '"precision"', "recall")
)
_CELLS_CTE = "cells AS (SELECT y, yhat, count(*) AS n FROM scored GROUP BY 1, 2)"
SQL["confusion_matrix"] = f"WITH {CLASSES} SELECT y, yhat, count(*) AS n FROM scored GROUP BY 1, 2"
SQL["class_report"] = f"""WITH {CLASSES}, {_CELLS_CTE}, {_report('cells')} SELECT class, support,
  predicted, hits, round("precision", 6) AS "precision", round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score FROM report"""
_CLS = f"""{_CELLS_CTE}, {_report('cells')}, cls AS (SELECT sum(support)::BIGINT AS n_rows,
  sum(hits) / sum(support) AS accuracy, {_WEIGHTED} FROM report)"""
SQL["classification_metrics"] = f"""WITH {CLASSES}, {_CLS} SELECT n_rows, round(accuracy, 6) AS accuracy,
  round(f1_score, 6) AS f1_score, round("precision", 6) AS "precision", round(recall, 6) AS recall
  FROM cls"""


def _errors(y: str = "y", yhat: str = "yhat") -> dict[str, str]:
    e = f"({y} - {yhat})"
    return {
        "mae": f"avg(abs({e}))",
        "rmse": f"sqrt(avg({e} * {e}))",
        "r2": f"1 - sum({e} * {e}) / (var_pop({y}) * count(*))",
        "mape": f"avg(abs({e}) / greatest(abs({y}), 1e-8)) * 100",
    }


SQL["regression_metrics"] = f"WITH {NUMBERS} SELECT count(*) AS n_rows, " + ", ".join(
    f"round({x}, 6) AS {m}" for m, x in _errors().items()
) + " FROM scored"
_POINTS = """pts AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p),
run AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn
  FROM pts),
rank AS (SELECT sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc,
  sum(pos * (cp / (cp + cn))) / sum(pos) AS pr_auc FROM run)"""
SQL["ranking_metrics"] = f"""WITH {BINARY}, {_POINTS} SELECT round(roc_auc::DOUBLE, 6) AS roc_auc,
  round(pr_auc::DOUBLE, 6) AS pr_auc FROM rank"""
SQL["evaluate_binary"] = f"WITH {BINARY}, {_CLS}, {_POINTS} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(\"{m}\"::DOUBLE, 6) AS value FROM {t}"
    for t, ms in (("cls", ("accuracy", "f1_score", "precision", "recall")), ("rank", ("roc_auc", "pr_auc")))
    for m in ms
)
SQL["residual_bins"] = f"""WITH {NUMBERS}, lim AS (SELECT min(yhat) AS lo,
  (max(yhat) - min(yhat)) / 10 AS w FROM scored)
SELECT least(floor((yhat - lo) / w), 9)::INTEGER AS bin, count(*) AS n_rows,
  round(avg(y - yhat), 4) AS mean_residual, round(stddev_samp(y - yhat), 4) AS std_residual
FROM scored, lim GROUP BY 1"""
SQL["model_ranking"] = f"""WITH {BINARY}, m AS (SELECT unnest([
  {{'model_id': 'low', 'cut': 0.3::DOUBLE}}, {{'model_id': 'middle', 'cut': 0.5::DOUBLE}},
  {{'model_id': 'high', 'cut': 0.7::DOUBLE}}, {{'model_id': 'higher', 'cut': 0.8::DOUBLE}}]) AS m),
cells AS (SELECT m.model_id AS model_id, y, (p >= m.cut)::INTEGER AS yhat, count(*) AS n
  FROM scored, m GROUP BY ALL),
{_report('cells', 'model_id')},
res AS (SELECT model_id, sum(hits) / sum(support) AS accuracy, {_WEIGHTED} FROM report GROUP BY model_id),
r AS (SELECT row_number() OVER (ORDER BY f1_score DESC, model_id)::INTEGER AS rank, * FROM res)
SELECT rank, model_id, round(f1_score, 6) AS primary_score, round(accuracy, 6) AS accuracy,
  round(f1_score, 6) AS f1_score, round("precision", 6) AS "precision", round(recall, 6) AS recall
FROM r WHERE rank <= 3"""
SQL["model_ranking_errors"] = f"""WITH {NUMBERS}, s2 AS (SELECT 'plus_' || o AS model_id, y,
  yhat + o AS yh FROM scored, (SELECT unnest([0, 5000, 10000]) AS o)),
res AS (SELECT model_id, {_errors('y', 'yh')['mae']} AS mae, {_errors('y', 'yh')['r2']} AS r2
  FROM s2 GROUP BY model_id)
SELECT row_number() OVER (ORDER BY mae, model_id)::INTEGER AS rank, model_id,
  round(mae, 6) AS primary_score, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM res"""

# --- bootstrap


def _weights(replicates: int, units: int) -> str:
    hashed = u("unit, replicate", "weight")
    steps = " ".join(f"WHEN x < {s!r}::DOUBLE THEN {i}" for i, s in enumerate(poisson_steps()))
    return f"""wx AS (SELECT unit::VARCHAR AS unit, replicate, {hashed}
  AS x FROM range({units}) a(unit), range({replicates}) b(replicate)),
weights AS (SELECT unit, replicate::INTEGER AS replicate, CASE {steps} ELSE {len(poisson_steps())} END AS w
  FROM wx)"""


def _unit(units: int) -> str:
    return f"floor({u('key', 'unit')} * {units})::INTEGER::VARCHAR"


def _resampled_cells(replicates: int, units: int) -> str:
    return f"""{_weights(replicates, units)},
uc AS (SELECT {_unit(units)} AS unit, y, yhat, count(*) AS n FROM scored GROUP BY ALL),
cells AS (SELECT replicate, y, yhat, sum(n * w)::BIGINT AS n FROM uc JOIN weights USING (unit)
  GROUP BY ALL),
{_report('cells', 'replicate')},
scores AS (SELECT replicate, sum(hits) / sum(support) AS accuracy, {_WEIGHTED} FROM report
  GROUP BY replicate)"""


def _interval(metric: str, column: str) -> str:
    return f"""SELECT '{metric}' AS metric, round(avg({column}), 6) AS mean,
  round(quantile_cont({column}, 0.025), 6) AS lower, round(quantile_cont({column}, 0.975), 6) AS upper,
  round(stddev_pop({column}), 6) AS std, count({column}) AS n_bootstrap FROM scores"""


SQL["bootstrap_accuracy"] = f"""WITH {BINARY}, {_resampled_cells(1000, 1000)}
SELECT replicate, round(accuracy, 6) AS score FROM scores"""
SQL["bootstrap_ci_f1"] = f"WITH {CLASSES}, {_resampled_cells(1000, 1000)} {_interval('f1_score', 'f1_score')}"
_SUMS = f"""{_weights(1000, 1000)},
us AS (SELECT {_unit(1000)} AS unit, count(*) AS n, sum(abs(y - yhat)) AS a, sum((y - yhat) ** 2) AS s,
  sum(y - (SELECT avg(y) FROM scored)) AS c, sum((y - (SELECT avg(y) FROM scored)) ** 2) AS cc
  FROM scored GROUP BY 1)"""
SQL["bootstrap_ci_mae"] = f"""WITH {NUMBERS}, {_SUMS}, scores AS (SELECT replicate,
  sum(a * w) / sum(n * w) AS score FROM us JOIN weights USING (unit) GROUP BY replicate)
{_interval('mae', 'score')}"""
SQL["bootstrap_ci_r2"] = f"""WITH {NUMBERS}, {_SUMS}, scores AS (SELECT replicate,
  1 - sum(s * w) / (sum(cc * w) - sum(c * w) ** 2 / sum(n * w)) AS score
  FROM us JOIN weights USING (unit) GROUP BY replicate)
{_interval('r2', 'score')}"""
SQL["bootstrap_ci_rmse"] = f"""WITH {NUMBERS}, {_SUMS}, scores AS (SELECT replicate,
  sqrt(sum(s * w) / sum(n * w)) AS score FROM us JOIN weights USING (unit) GROUP BY replicate)
{_interval('rmse', 'score')}"""
SQL["bootstrap_ci_precision"] = (
    f"WITH {CLASSES}, {_resampled_cells(1000, 1000)} {_interval('precision', '"precision"')}"
)
SQL["bootstrap_ci_recall"] = f"WITH {CLASSES}, {_resampled_cells(1000, 1000)} {_interval('recall', 'recall')}"
SQL["bootstrap_ci_full"] = f"""WITH {BINARY}, {_resampled_cells(1000, 1000)}
{_interval('accuracy', 'accuracy')}"""

# --- curves

_CURVE = """curve AS (SELECT p AS threshold, cp / (cp + cn) AS "precision",
  cp / (SELECT sum(pos) FROM pts) AS recall FROM run)"""
SQL["pr_curve"] = f"""WITH {BINARY}, {_POINTS}, {_CURVE} SELECT round(threshold, 6) AS threshold,
  round("precision"::DOUBLE, 6) AS "precision", round(recall::DOUBLE, 6) AS recall FROM curve"""
SQL["optimal_threshold"] = f"""WITH {BINARY}, {_POINTS}, {_CURVE} SELECT round(threshold, 6)
  AS optimal_threshold FROM curve ORDER BY "precision" + recall DESC, threshold LIMIT 1"""
SQL["operating_point"] = f"""WITH {BINARY}, {_POINTS}, {_CURVE},
f AS (SELECT *, 2 * "precision" * recall / ("precision" + recall) AS f1 FROM curve)
SELECT round(threshold, 6) AS threshold, round("precision"::DOUBLE, 6) AS "precision",
  round(recall::DOUBLE, 6) AS recall, round(f1::DOUBLE, 6) AS f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1"""
_LIFT = f"""r AS (SELECT y, row_number() OVER (ORDER BY p DESC, {u('key', 'lift')}) AS k,
  count(*) OVER () AS n FROM scored),
shares AS (SELECT unnest([{', '.join(f'{s!r}::DOUBLE' for s in LIFT_SHARES)}]) AS share),
lift AS (SELECT share, floor(share * any_value(n))::BIGINT AS n_top,
  sum(y) FILTER (k <= floor(share * n))::BIGINT AS positives,
  sum(y) FILTER (k <= floor(share * n)) / floor(share * any_value(n)) / (sum(y) / any_value(n)) AS lift
  FROM r, shares GROUP BY share)"""
SQL["lift_curve"] = f"""WITH {BINARY}, {_LIFT} SELECT round(share, 6) AS share, n_top, positives,
  round(lift, 6) AS lift FROM lift"""
SQL["lift_summary"] = f"""WITH {BINARY}, {_LIFT} SELECT round(max(lift), 6) AS max_lift,
  round(min_by(lift, share), 6) AS lift_at_10pct FROM lift"""


def _bin(closed: str) -> str:
    edges = bin_edges()
    out = []
    for i in range(10):
        low, high = f"{edges[i]!r}::DOUBLE", f"{edges[i + 1]!r}::DOUBLE"
        if closed == "right":
            test = f"p > {low} AND p <= {high}"
        else:
            test = f"p >= {low} AND p {'<=' if i == 9 else '<'} {high}"
        out.append(f"WHEN {test} THEN {i}")
    return f"CASE {' '.join(out)} END"


_CENTERS = (
    "[" + ", ".join(f"{(a + b) / 2!r}::DOUBLE" for a, b in zip(bin_edges(), bin_edges()[1:])) + "]"
)


def _bins(closed: str) -> str:
    return f"""bins AS (SELECT ({_bin(closed)})::INTEGER AS bin, avg(p) AS mean_p, avg(y) AS accuracy,
  count(*) AS n_rows FROM scored GROUP BY 1),
filled AS (SELECT bin, {_CENTERS}[bin + 1] AS center, mean_p, accuracy, n_rows FROM bins
  WHERE bin IS NOT NULL)"""


SQL["calibration_curve"] = f"""WITH {BINARY}, {_bins('left')} SELECT bin, round(center, 6) AS center,
  round(mean_p, 6) AS mean_p, round(accuracy, 6) AS accuracy, n_rows FROM filled"""
_GAP = "round(sum(abs({at} - accuracy) * n_rows) / (SELECT count(*) FROM scored), 6) AS ece FROM filled"
SQL["ece_mean"] = f"WITH {BINARY}, {_bins('right')} SELECT {_GAP.format(at='mean_p')}"
SQL["ece_center"] = f"WITH {BINARY}, {_bins('left')} SELECT {_GAP.format(at='center')}"
SQL["brier"] = f"WITH {BINARY} SELECT round(avg((p - y) ** 2), 6) AS brier FROM scored"
SQL["bars"] = "SELECT event_type AS category, round(avg(value), 6) AS value FROM events GROUP BY 1"

# --- fairness

_BIASED = f"""{CLASSES}, biased AS (SELECT l_linestatus, l_linenumber, y,
  CASE WHEN (l_linestatus = 'O' AND {u('key', 'bias')} < 0.25)
    OR (l_linenumber > 5 AND {u('key', 'bias')} < 0.4) THEN 'A' ELSE yhat END AS yhat FROM scored),
long AS (SELECT 'l_linestatus' AS col, l_linestatus AS slice, y, yhat FROM biased
  UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, y, yhat FROM biased),
cells AS (SELECT col, slice, y, yhat, count(*) AS n FROM long GROUP BY ALL),
{_report('cells', 'col, slice')},
slices AS (SELECT col, slice, sum(hits) / sum(support) AS accuracy,
  sum(f1_score * support) / sum(support) AS f1_score, sum(support)::BIGINT AS sample_size
  FROM report GROUP BY col, slice),
gaps AS (SELECT col, max(accuracy) - min(accuracy) AS gap FROM slices GROUP BY col HAVING count(*) >= 2)"""
SQL["slice_metrics"] = f"""WITH {_BIASED} SELECT col AS "column", slice, round(accuracy, 6) AS accuracy,
  round(f1_score, 6) AS f1_score, sample_size FROM slices"""
SQL["slice_metrics_errors"] = f"""WITH {NUMBERS}, long AS (SELECT 'l_linestatus' AS col,
  l_linestatus AS slice, y, yhat FROM scored
  UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, y, yhat FROM scored)
SELECT col AS "column", slice, round(avg(abs(y - yhat)), 6) AS mae, count(*) AS sample_size
FROM long GROUP BY 1, 2"""
SQL["disparity"] = f"""WITH {_BIASED} SELECT col AS "column", 'accuracy' AS metric,
  round(gap, 6) AS disparity, CASE WHEN gap > 0.2 THEN 'high' ELSE 'medium' END AS severity
  FROM gaps WHERE gap > 0.1"""
SQL["fairness_summary"] = f"""WITH {_BIASED} SELECT CASE WHEN count(*) > 0 THEN 'issues_found'
  ELSE 'no_issues' END AS status, count(*) AS total_issues FROM gaps WHERE gap > 0.1"""

# --- robustness


def _lost(c: str) -> str:
    return f"CASE WHEN {u('key', 'missing ' + c)} >= 0.1 THEN {c} END"


SQL["shock_missing"] = f"""WITH {LINEITEM}, lost AS (SELECT key, {_lost('l_quantity')} AS q,
  {_lost('l_extendedprice')} AS e FROM li)
SELECT key, round(coalesce(q, (SELECT avg(q) FROM lost)), 6) AS l_quantity,
  round(coalesce(e, (SELECT avg(e) FROM lost)), 6) AS l_extendedprice FROM lost"""
SQL["shock_noise"] = f"WITH {LINEITEM} SELECT key, " + ", ".join(
    f"round({c} + 0.1 * (SELECT stddev_samp({c}) FROM li) * {normal('key', 'noise ' + c)}, 4) AS {c}"
    for c in ("l_quantity", "l_extendedprice")
) + " FROM li"
SQL["ablate_number"] = f"""WITH {LINEITEM} SELECT key, round((SELECT avg(l_quantity) FROM li), 6)
  AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM li"""
SQL["ablate_text"] = """SELECT o_orderkey, (SELECT o_orderpriority FROM orders GROUP BY 1
  ORDER BY count(*) DESC, 1 LIMIT 1) AS o_orderpriority FROM orders"""

# --- models

SQL["ols_line"] = """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem"""

# The isotonic fit at a score is the largest, over blocks that start at or before
# it, of the smallest mean over blocks that end at or after it.
_ISOTONIC = """pts AS (SELECT p, sum(y) AS o, count(*) AS n, row_number() OVER (ORDER BY p) AS i
  FROM scored GROUP BY p),
cum AS (SELECT i, sum(o) OVER (ORDER BY i) AS co, sum(n) OVER (ORDER BY i) AS cn FROM pts),
pairs AS (SELECT a.i AS a, b.i AS b, (b.co - coalesce(z.co, 0)) / (b.cn - coalesce(z.cn, 0)) AS m
  FROM pts a JOIN cum b ON b.i >= a.i LEFT JOIN cum z ON z.i = a.i - 1),
low AS (SELECT a, b AS s, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS g FROM pairs),
fit AS (SELECT s, max(g) AS f FROM low GROUP BY s),
cal AS (SELECT y, pts.p AS raw, f FROM scored JOIN pts ON pts.p = scored.p JOIN fit ON s = i)"""


def _ece_of(score: str, name: str) -> str:
    return f"""{name} AS (SELECT sum(gap) / (SELECT count(*) FROM cal) AS ece FROM (
  SELECT abs(avg(p) - avg(y)) * count(*) AS gap FROM (SELECT {score} AS p, y FROM cal)
  WHERE ({_bin('right')}) IS NOT NULL GROUP BY {_bin('right')}))"""


SQL["calibrate_isotonic"] = f"""WITH {BINARY}, {_ISOTONIC}, {_ece_of('raw', 'e0')}, {_ece_of('f', 'e1')},
b AS (SELECT avg((raw - y) ** 2) AS b0, avg((f - y) ** 2) AS b1 FROM cal)
SELECT round(e0.ece, 6) AS ece_before, round(e1.ece, 6) AS ece_after,
  round(e0.ece - e1.ece, 6) AS ece_improvement, round(b0, 6) AS brier_before,
  round(b1, 6) AS brier_after, round(b0 - b1, 6) AS brier_improvement FROM e0, e1, b"""

# Other bucket sizes of the same operators give the same rows.
SQL["ranking_metrics_buckets"] = SQL["ranking_metrics"]
SQL["pr_curve_buckets"] = SQL["pr_curve"]
SQL["vocabulary_large"] = SQL["vocabulary"]
SQL["label_encode_large"] = SQL["label_encode"]
SQL["labelled_lengths"] = f"""WITH scored AS (SELECT lang AS slice, quality AS y, (n_chars >= 300)::INTEGER AS yhat
  FROM documents JOIN labels USING (doc_id)),
cells AS (SELECT slice, y, yhat, count(*) AS n FROM scored GROUP BY ALL),
{_report('cells', 'slice')}
SELECT 'lang' AS "column", slice, round(sum(hits) / sum(support), 6) AS accuracy,
  round(sum(f1_score * support) / sum(support), 6) AS f1_score, sum(support)::BIGINT AS sample_size
FROM report GROUP BY slice"""
