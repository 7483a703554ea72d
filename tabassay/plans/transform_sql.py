"""The queries of feature transforms, rolling splits and exact resampling in DuckDB SQL."""

from __future__ import annotations

from ..operators.transforms import CANDIDATES, EXPONENTS, EXPONENT_STEP
from .duckdb_sql import LINEITEM, _errors, _redacted, cell, u
from .model_sql import FEATURES, PRICE, fit, predicted

TRANSFORM_SQL: dict[str, str] = {}

SUPPLIED = f"""{LINEITEM}, s0 AS (SELECT key, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
  l_extendedprice, CASE WHEN l_orderkey % 3 <> 0 THEN l_discount END AS l_discount, l_linenumber,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_linestatus END AS l_linestatus,
  CASE WHEN l_orderkey % 11 <> 0 THEN 'S' || l_suppkey END AS supplier, {u('key')} AS h FROM li),
supplied AS (SELECT * EXCLUDE (h), CASE WHEN h < 0.2 THEN 'test' WHEN h < 0.4 THEN 'val' ELSE 'train' END AS split,
  floor({u('key', 'target fold')} * 5)::INTEGER AS fold FROM s0)"""


def _means(c: str) -> str:
    """CTEs with the sums of a column's categories, and its encoded rows (key, c)."""
    value = f"coalesce({c}, 'missing')"
    return f"""{c}_f AS (SELECT {value} AS v, fold, sum(l_extendedprice) AS s, count(*) AS n FROM supplied
  WHERE split = 'train' GROUP BY ALL),
{c}_t AS (SELECT v, sum(s) AS s, sum(n) AS n FROM {c}_f GROUP BY v),
{c}_e AS (SELECT key, (coalesce(t.s - coalesce(f.s, 0), 0) + 10 * CASE WHEN split = 'train' THEN (all_s - fold_s) / (all_n - fold_n)
  ELSE all_s / all_n END) / (coalesce(t.n - coalesce(f.n, 0), 0) + 10) AS e
  FROM supplied r JOIN folds USING (fold), whole LEFT JOIN {c}_t t ON t.v = {value.replace(c, 'r.' + c)}
  LEFT JOIN {c}_f f ON f.v = t.v AND f.fold = r.fold AND r.split = 'train')"""


_FOLDS = """folds AS (SELECT fold, sum(l_extendedprice) AS fold_s, count(*) AS fold_n FROM supplied
  WHERE split = 'train' GROUP BY fold),
whole AS (SELECT sum(fold_s) AS all_s, sum(fold_n) AS all_n FROM folds)"""

TRANSFORM_SQL["target_encode"] = f"""WITH {SUPPLIED}, {_FOLDS}, {_means('supplier')}, {_means('l_linestatus')}
SELECT key, round(s.e, 4) AS supplier, round(l.e, 4) AS l_linestatus, split
FROM supplied JOIN supplier_e s USING (key) JOIN l_linestatus_e l USING (key)"""
TRANSFORM_SQL["target_encode_large"] = TRANSFORM_SQL["target_encode"]


def _words(c: str) -> str:
    return f"""{c}_w AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT
  coalesce({c}, 'missing') AS v FROM supplied WHERE split = 'train' AND l_linenumber < 5))"""


TRANSFORM_SQL["one_hot"] = f"""WITH {SUPPLIED}, {_words('supplier')}, {_words('l_linestatus')}
SELECT key, coalesce(s.i, -1)::BIGINT AS slot, (SELECT string_agg((l.i IS NOT DISTINCT FROM w.i)::INTEGER::VARCHAR, '' ORDER BY w.i)
  FROM l_linestatus_w w) AS status
FROM supplied r LEFT JOIN supplier_w s ON s.v = coalesce(r.supplier, 'missing')
LEFT JOIN l_linestatus_w l ON l.v = coalesce(r.l_linestatus, 'missing')"""
TRANSFORM_SQL["one_hot_large"] = TRANSFORM_SQL["one_hot"]


def _evaluated(rows: str) -> str:
    """Test metrics of the linear model on x0..x3 and y of ``rows``."""
    measured = ", ".join(f"{x} AS {m}" for m, x in _errors("y", "f").items())
    union = " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6) AS value FROM m" for m in _errors())
    return f"""{rows}, train AS (SELECT * FROM parted WHERE split = 'train'),
{fit('train')}, s AS (SELECT y, {predicted()} AS f FROM parted, w WHERE split = 'test'),
m AS (SELECT {measured} FROM s) {union}"""


TRANSFORM_SQL["one_hot_linear"] = "WITH " + _evaluated(f"""{LINEITEM}, parted AS (SELECT l_quantity::DOUBLE AS x0,
  (l_returnflag = 'A')::INTEGER::DOUBLE AS x1, (l_returnflag = 'N')::INTEGER::DOUBLE AS x2,
  (l_linestatus = 'F')::INTEGER::DOUBLE AS x3, 30 * l_quantity + CASE l_returnflag WHEN 'A' THEN 40 WHEN 'N' THEN -25
  ELSE 0 END + 7 * (l_linestatus = 'F')::INTEGER + 200 * ({u('key', 'price')} - 0.5) AS y,
  CASE WHEN {u('key')} < 0.2 THEN 'test' WHEN {u('key')} < 0.4 THEN 'val' ELSE 'train' END AS split FROM li)""")
TRANSFORM_SQL["product_linear"] = "WITH " + _evaluated(f"""{LINEITEM}, parted AS (SELECT l_quantity::DOUBLE AS x0,
  l_discount::DOUBLE AS x1, l_quantity * l_discount AS x2, l_linenumber::DOUBLE AS x3,
  30 * l_quantity * (1 - l_discount) + 5 * l_linenumber + 200 * ({u('key', 'price')} - 0.5) AS y,
  CASE WHEN {u('key')} < 0.2 THEN 'test' WHEN {u('key')} < 0.4 THEN 'val' ELSE 'train' END AS split FROM li)""")


def _hashed(c: str, width: int) -> tuple[str, str]:
    length = f"{len(c)}:{c}"
    value = f"coalesce({c}, 'missing')"
    digest = f"md5('{length}' || {cell(value)})"
    return (
        f"('0x' || substr({digest}, 1, 8))::BIGINT % {width}",
        f"(1 - 2 * (('0x' || substr({digest}, 9, 1))::BIGINT % 2))::INTEGER",
    )


TRANSFORM_SQL["hash_encode"] = f"""WITH {SUPPLIED} SELECT key, {', '.join(
    f'{_hashed(c, 64)[0]} AS {c}_slot, {_hashed(c, 64)[1]} AS {c}_sign' for c in ('supplier', 'l_linestatus'))}
FROM supplied"""


def _likeliest(c: str) -> str:
    """CTEs that search for the exponent of a column, in as many rounds as the step needs."""
    parts = [f"{c}_g AS (SELECT avg(ln({c})) AS g FROM lineitem)", f"{c}_u AS (SELECT {c} / exp(g) AS u FROM lineitem, {c}_g)"]
    low, high, k, width = f"{EXPONENTS[0]}::DOUBLE", f"{EXPONENTS[1]}::DOUBLE", 0, EXPONENTS[1] - EXPONENTS[0]
    source = f"(SELECT {low} AS low, {high} AS high)"
    while True:
        parts.append(f"""{c}_c{k} AS (SELECT i, low + (high - low) * i / {CANDIDATES - 1} AS e FROM {source}, range({CANDIDATES}) r(i)),
{c}_v{k} AS (SELECT i, e, avg(y) AS m, var_pop(y) AS v FROM (SELECT i, e, CASE WHEN abs(e) < 1e-9 THEN ln(u)
  ELSE (pow(u, e) - 1) / e END AS y FROM {c}_u, {c}_c{k}) GROUP BY i, e),
{c}_b{k} AS (SELECT * FROM {c}_v{k} ORDER BY v, i LIMIT 1)""")
        if width / (CANDIDATES - 1) <= EXPONENT_STEP:
            return ",\n".join(parts) + f""",
{c}_r AS (SELECT '{c}' AS "column", e AS exponent, exp(g * e) * m + CASE WHEN abs(e) < 1e-9 THEN g
  ELSE (exp(g * e) - 1) / e END AS mean, exp(g * e) * exp(g * e) * v AS variance FROM {c}_b{k}, {c}_g)"""
        source = (
            f"(SELECT a.e AS low, z.e AS high FROM {c}_b{k} b JOIN {c}_c{k} a ON a.i = greatest(b.i - 1, 0)"
            f" JOIN {c}_c{k} z ON z.i = least(b.i + 1, {CANDIDATES - 1}))"
        )
        width = 2 * width / (CANDIDATES - 1)
        k += 1


_POWERED = ("l_extendedprice", "l_quantity")
TRANSFORM_SQL["box_cox"] = f"""WITH {', '.join(_likeliest(c) for c in _POWERED)}
SELECT "column", round(exponent, 4) AS exponent, round(mean, 4) AS mean, round(variance, 4) AS variance
FROM ({' UNION ALL '.join(f'SELECT * FROM {c}_r' for c in _POWERED)})"""

_A, _B, _C = "l_quantity", "l_discount", "l_tax"
_PRODUCTS = {
    f"{_A}^2": (_A, _A), f"{_A}*{_B}": (_A, _B), f"{_A}*{_C}": (_A, _C), f"{_B}^2": (_B, _B), f"{_B}*{_C}": (_B, _C),
    f"{_C}^2": (_C, _C), f"{_A}^3": (_A, _A, _A), f"{_A}^2*{_B}": (_A, _A, _B), f"{_A}^2*{_C}": (_A, _A, _C),
    f"{_A}*{_B}^2": (_A, _B, _B), f"{_A}*{_B}*{_C}": (_A, _B, _C), f"{_A}*{_C}^2": (_A, _C, _C),
    f"{_B}^3": (_B, _B, _B), f"{_B}^2*{_C}": (_B, _B, _C), f"{_B}*{_C}^2": (_B, _C, _C), f"{_C}^3": (_C, _C, _C),
}
TRANSFORM_SQL["products"] = f"""WITH {LINEITEM} SELECT key, {', '.join(f'round({c}, 6) AS {c}' for c in (_A, _B, _C))}, {', '.join(
    f'round({" * ".join(t)}, 6) AS "{n}"' for n, t in _PRODUCTS.items())} FROM li"""

_TRAIN = "FROM supplied WHERE split = 'train'"
_MODE = "(SELECT {0} " + _TRAIN + " AND {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"
TRANSFORM_SQL["run_plan"] = f"""WITH {SUPPLIED}, {_FOLDS}, {_means('supplier')},
fills AS (SELECT (SELECT avg(l_quantity) {_TRAIN}) AS q, {_MODE.format('l_discount')} AS d, {_MODE.format('l_linestatus')} AS s),
powered AS (SELECT key, split, l_extendedprice, ln(1 + coalesce(l_quantity, q)) AS q, coalesce(l_discount, d) AS d,
  sqrt(l_linenumber) AS n, CASE coalesce(l_linestatus, s) WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE -1 END AS s FROM supplied, fills),
params AS (SELECT min(q) AS q0, max(q) - min(q) AS q1, avg(d) AS d0, stddev_pop(d) AS d1, quantile_cont(n, 0.5) AS n0,
  quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS n1 FROM powered WHERE split = 'train'),
scaled AS (SELECT key, split, l_extendedprice, (q - q0) / q1 AS q, (d - d0) / d1 AS d, (n - n0) / CASE n1 WHEN 0 THEN 1 ELSE n1 END AS n, s
  FROM powered, params)
SELECT key, round(q, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, round(d, 4) AS l_discount,
  round(n, 4) AS l_linenumber, s::BIGINT AS l_linestatus, round(e, 4) AS supplier, split, round(q * q, 4) AS "l_quantity^2",
  round(d * n, 4) + 0.0 AS "l_discount*l_linenumber"
FROM scaled JOIN supplier_e USING (key)"""


def _median(c: str) -> str:
    return f"(SELECT quantile_cont({c}::DOUBLE, 0.5) {_TRAIN})"


def _standard(c: str) -> str:
    return f"round((f.{c} - avg_{c}) / CASE sd_{c} WHEN 0 THEN 1 ELSE sd_{c} END, 4) AS {c}"


_NUMBERS = ("l_quantity", "l_discount", "l_linenumber")
TRANSFORM_SQL["run_plan_default"] = f"""WITH {SUPPLIED}, medians AS (SELECT {', '.join(f'{_median(c)} AS m_{c}' for c in _NUMBERS)},
  {_MODE.format('l_linestatus')} AS s, {_MODE.format('supplier')} AS p),
f AS (SELECT key, split, {', '.join(f'coalesce({c}::DOUBLE, m_{c}) AS {c}' for c in _NUMBERS)},
  coalesce(l_linestatus, s) AS l_linestatus, coalesce(supplier, p) AS supplier FROM supplied, medians),
params AS (SELECT {', '.join(f'avg({c}) AS avg_{c}, stddev_pop({c}) AS sd_{c}' for c in _NUMBERS)} FROM f WHERE split = 'train'),
many AS (SELECT count(DISTINCT supplier) > 50 AS many FROM supplied),
words AS (SELECT 'l' AS c, v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT l_linestatus AS v FROM f WHERE split = 'train')
  UNION ALL SELECT 's', v, row_number() OVER (ORDER BY v) - 1 FROM (SELECT DISTINCT supplier AS v FROM f WHERE split = 'train'))
SELECT key, {', '.join(_standard(c) for c in _NUMBERS)}, coalesce(a.i, -1)::BIGINT AS l_linestatus, split,
  CASE WHEN many THEN {_hashed('supplier', 32)[0]} ELSE coalesce(b.i, -1) END::BIGINT AS slot,
  CASE WHEN many THEN {_hashed('supplier', 32)[1]} ELSE 0 END::INTEGER AS sign
FROM f LEFT JOIN words a ON a.c = 'l' AND a.v = f.l_linestatus LEFT JOIN words b ON b.c = 's' AND b.v = f.supplier, params, many"""


def _rolling(count: int, intervals: list[tuple[int, str, int, int]]) -> str:
    cases = " ".join(f"WHEN place <= n * {i} // {count} THEN {i - 1}" for i in range(1, count))
    values = ", ".join(f"({k}, '{role}', {a}, {b})" for k, role, a, b in intervals)
    return f"""{LINEITEM}, placed AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY l_shipdate NULLS LAST,
  {u('key')}, {u('key', 'tie')}) AS place FROM li),
parted AS (SELECT *, CASE {cases} ELSE {count - 1} END AS stretch FROM placed),
roles AS (SELECT * FROM (VALUES {values}) t(fold, role, lo, hi))"""


_SUMMARY = """SELECT fold::INTEGER AS fold, role, count(l_shipdate) AS n_rows, min(l_shipdate) AS start, max(l_shipdate) AS "end"
FROM roles LEFT JOIN parted ON stretch BETWEEN lo AND hi GROUP BY fold, role"""
_EXPANDING = [
    row for k in range(4) for row in ((k, "train", 0, k), (k, "val", k + 2, k + 2), (k, "test", k + 3, k + 3))
]
TRANSFORM_SQL["rolling_splits"] = f"WITH {_rolling(7, _EXPANDING)} {_SUMMARY}"
_MOVING = [row for k in range(3) for row in ((k, "train", k, k + 1), (k, "test", k + 2, k + 3))]
TRANSFORM_SQL["rolling_windows"] = f"WITH {_rolling(6, _MOVING)} {_SUMMARY}"

_ROLLED = [row for k in range(3) for row in ((k, "train", 0, k), (k, "test", k + 1, k + 1))]
TRANSFORM_SQL["grid_rolling"] = f"""WITH {_rolling(4, _ROLLED)},
numbers AS (SELECT stretch, {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in enumerate(FEATURES))},
  30 * l_quantity * (1 - l_discount) + 5 * l_linenumber + 200 * ({u('key', 'price')} - 0.5) AS y FROM parted),
trials AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 10.0), (2, 1000.0)) t(trial_id, alpha)),
rest AS (SELECT trial_id, alpha, fold AS held, numbers.* FROM numbers JOIN roles ON role = 'train' AND stretch BETWEEN lo AND hi, trials),
{fit('rest', ('trial_id', 'held'), 'any_value(alpha)')},
errors AS (SELECT trial_id, fold, avg(abs(y - ({predicted()}))) AS mae FROM numbers JOIN roles ON role = 'test' AND stretch BETWEEN lo AND hi
  JOIN w ON fold = held GROUP BY ALL),
scores AS (SELECT trial_id, -avg(mae) AS score FROM errors GROUP BY trial_id)
SELECT trial_id::INTEGER AS trial_id, 'ridge_regression' AS name, '{{"alpha": ' || alpha::VARCHAR || '}}' AS params,
  round(score, 6) AS score, (1 + (SELECT count(*) FROM scores o WHERE o.score > s.score))::INTEGER AS rank
FROM scores s JOIN trials USING (trial_id)"""

_BALANCES = f"""balances AS (SELECT c_custkey, c_acctbal, c_acctbal + 3000 * ({u('c_custkey', 'guess')} - 0.5) AS guess FROM customer),
"""


def _drawn(key: str) -> str:
    """CTEs up to ``drawn(replicate, weight, ...)`` for 50 replicates; ``key`` is the text that is hashed."""
    return _BALANCES + f"""named AS (SELECT *, {key} AS key FROM balances),
placed AS (SELECT *, row_number() OVER (ORDER BY {u('key', 'place')}, {u('key', 'place tie')}, key) - 1 AS position FROM named),
total AS (SELECT count(*) AS n FROM balances),
draws AS (SELECT replicate, floor({u('replicate, draw', 'draw')} * n)::BIGINT AS position FROM total, range(50) a(replicate),
  generate_series(0, n - 1) b(draw)),
weights AS (SELECT replicate, position, count(*) AS weight FROM draws GROUP BY ALL),
drawn AS (SELECT * FROM weights JOIN placed USING (position))"""


TRANSFORM_SQL["bootstrap_exact"] = f"""WITH {_drawn(cell('c_custkey'))},
scores AS (SELECT replicate, sum(weight * abs(c_acctbal - guess)) / sum(weight) AS score FROM drawn GROUP BY replicate)
SELECT 'mae' AS metric, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.025), 6) AS lower,
  round(quantile_cont(score, 0.975), 6) AS upper, round(stddev_pop(score), 6) AS std, count(*) AS n_bootstrap FROM scores"""
TRANSFORM_SQL["bootstrap_exact_accuracy"] = f"""WITH {_drawn(cell('c_custkey'))}
SELECT replicate::INTEGER AS replicate, round(sum(weight) FILTER ((c_acctbal > 0) = (guess > 0)) / sum(weight), 6) AS score
FROM drawn GROUP BY replicate"""
TRANSFORM_SQL["exact_draws"] = f"""WITH {_drawn(cell('c_custkey'))}
SELECT replicate::INTEGER AS replicate, sum(weight)::BIGINT AS draws, count(*) AS rows FROM drawn GROUP BY replicate"""

TRANSFORM_SQL["split_sink"] = f"""WITH {SUPPLIED} SELECT split, count(*) AS n,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price FROM supplied GROUP BY split"""
TRANSFORM_SQL["deny_list"] = """WITH r AS (SELECT l_extendedprice AS y, l_quantity, l_discount,
  2 * l_extendedprice + 1 AS price_twin, l_extendedprice * 1.5 AS target_price FROM lineitem),
c AS (SELECT unnest(['l_quantity', 'l_discount', 'price_twin', 'target_price']) AS "column",
  unnest([corr(l_quantity, y), corr(l_discount, y), corr(price_twin, y), corr(target_price, y)]) AS r FROM r)
SELECT "column" FROM c WHERE abs(r) > 0.95"""
TRANSFORM_SQL["gate_redacts"] = f"SELECT doc_id, md5(coalesce({_redacted('text')}, '')) AS digest FROM documents"
_FENCES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", lo AS low, hi AS high, count(*) FILTER (v < lo OR v > hi) AS n_outliers
FROM (SELECT {c}::DOUBLE AS v FROM o), (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM o)) GROUP BY lo, hi"""
    for c in ("o_orderkey", "o_custkey", "o_totalprice", "skewed")
)
TRANSFORM_SQL["outliers_whole"] = f"""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice,
  pow(o_totalprice / 500000, 6.0) AS skewed FROM orders), f AS ({_FENCES})
SELECT "column", round(low, 6) AS low, round(high, 6) AS high, n_outliers FROM f WHERE n_outliers > 0"""
