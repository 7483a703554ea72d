"""Linear models in DuckDB SQL: normal equations solved step by step, and what is measured on them."""

from __future__ import annotations

from collections.abc import Sequence

from .duckdb_sql import LINEITEM, _errors, _interval, _unit, _weights, normal, u

FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
_X = [f"x{i}" for i in range(len(FEATURES))]

PRICE = f"""{LINEITEM}, pr0 AS (SELECT key, {', '.join(f'{c}::DOUBLE AS {x}' for c, x in zip(FEATURES, _X))},
  30 * l_quantity * (1 - l_discount) + 5 * l_linenumber + 200 * ({u('key', 'price')} - 0.5) AS y,
  {u('key')} AS h FROM li),
price AS (SELECT *, CASE WHEN h < 0.2 THEN 'test' WHEN h < 0.4 THEN 'val' ELSE 'train' END AS split FROM pr0),
train AS (SELECT * FROM price WHERE split = 'train'), val AS (SELECT * FROM price WHERE split = 'val'),
test AS (SELECT * FROM price WHERE split = 'test')"""


def fit(rows: str, keys: Sequence[str] = (), alpha: str = "0", name: str = "w") -> str:
    """CTEs that end in ``name(keys, w0.., b)``: ridge weights and intercept per key of ``rows``."""
    k = "".join(f"{c}, " for c in keys)
    using = f"JOIN {name}m USING ({', '.join(keys)})" if keys else f", {name}m"
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    n = len(_X)
    means = ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate([*_X, "y"]))
    gram = [
        f"sum((x{i} - m{i}) * (x{j} - m{j})){f' + {alpha}' if i == j else ''} AS a{i}_{j}"
        for i in range(n)
        for j in range(i, n)
    ] + [f"sum((x{i} - m{i}) * (y - m{n})) AS c{i}" for i in range(n)]
    parts = [
        f"{name}m AS (SELECT {k}{means} FROM {rows}{by})",
        f"{name}g AS (SELECT {k}{', '.join(gram)} FROM {rows} {using}{by})",
    ]
    # Elimination: each step takes one unknown out of the rows below.
    table = f"{name}g"
    for p in range(n - 1):
        cells = []
        for i in range(n):
            f = f"(a{p}_{i} / a{p}_{p})"
            for j in range(i, n):
                cells.append(f"a{i}_{j} - {f} * a{p}_{j} AS a{i}_{j}" if i > p else f"a{i}_{j}")
            cells.append(f"c{i} - {f} * c{p} AS c{i}" if i > p else f"c{i}")
        parts.append(f"{name}e{p} AS (SELECT {k}{', '.join(cells)} FROM {table})")
        table = f"{name}e{p}"
    for i in reversed(range(n)):
        known = "".join(f" - a{i}_{j} * w{j}" for j in range(i + 1, n))
        parts.append(f"{name}s{i} AS (SELECT *, (c{i}{known}) / a{i}_{i} AS w{i} FROM {table})")
        table = f"{name}s{i}"
    weights = ", ".join(f"w{i}" for i in range(n))
    offset = "".join(f" - w{i} * m{i}" for i in range(n))
    parts.append(f"{name} AS (SELECT {k}{weights}, m{n}{offset} AS b FROM {table} {using})")
    return ",\n".join(parts)


def predicted(cells: Sequence[str] = tuple(_X)) -> str:
    return " + ".join(f"w{i} * {c}" for i, c in enumerate(cells)) + " + b"


def _lost(i: int) -> str:
    return f"CASE WHEN {u('key', 'missing ' + FEATURES[i])} >= 0.1 THEN x{i} END"


MODEL_SQL: dict[str, str] = {}

MODEL_SQL["evaluate_regression"] = f"""WITH {PRICE}, {fit('train')},
s AS (SELECT y, {predicted()} AS f FROM test, w),
m AS (SELECT {', '.join(f'{x} AS {m}' for m, x in _errors('y', 'f').items())} FROM s)
""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6) AS value FROM m" for m in _errors())

_ABLATED = ",\n".join(
    f"d{i} AS (SELECT avg(abs(y - ({predicted([f'mean{j}' if j == i else x for j, x in enumerate(_X)])}))) AS mae"
    f" FROM val, w, means)"
    for i in range(len(_X))
)
_ABLATION = f"""{PRICE}, {fit('train')}, means AS (SELECT {', '.join(f'avg({x}) AS mean{i}' for i, x in enumerate(_X))}
  FROM val), base AS (SELECT avg(abs(y - ({predicted()}))) AS mae FROM val, w), {_ABLATED},
drops AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, base.mae AS before, d{i}.mae AS after FROM base, d{i}" for i, c in enumerate(FEATURES)
)})"""
MODEL_SQL["ablation_regression"] = f"""WITH {_ABLATION} SELECT feature, 1.0::DOUBLE AS importance,
  round(before, 6) AS baseline_score, round(after, 6) AS ablated_score,
  round(after - before, 6) AS performance_drop FROM drops"""
MODEL_SQL["ablation_summary"] = f"""WITH {_ABLATION} SELECT round(max(after - before), 6)
  AS max_performance_drop, round(avg(after - before), 6) AS avg_performance_drop FROM drops"""

_SHOCKS = f"""{PRICE}, {fit('train')},
kept AS (SELECT *, {', '.join(f'{_lost(i)} AS l{i}' for i in range(len(_X)))} FROM val),
stats AS (SELECT {', '.join(f'avg(l{i}) AS mean{i}, stddev_samp(x{i}) AS sd{i}' for i in range(len(_X)))} FROM kept),
base AS (SELECT avg(abs(y - ({predicted()}))) AS mae FROM val, w),
tests AS (SELECT 'missing_values' AS test, 0.1 AS allowed,
  avg(abs(y - ({predicted([f'coalesce(l{i}, mean{i})' for i in range(len(_X))])}))) AS mae FROM kept, w, stats
UNION ALL SELECT 'noise_injection', 0.05, avg(abs(y - ({predicted([
    f"(x{i} + sd{i} * 0.1 * {normal('key', 'noise ' + c)})" for i, c in enumerate(FEATURES)
])}))) FROM kept, w, stats),
shocks AS (SELECT test, base.mae AS before, tests.mae AS after, tests.mae - base.mae < allowed AS passed
  FROM tests, base)"""
MODEL_SQL["shock_tests_regression"] = f"""WITH {_SHOCKS} SELECT test, round(before, 6) AS baseline_score,
  round(after, 6) AS score, round(after - before, 6) AS performance_drop, passed FROM shocks"""
MODEL_SQL["shock_grade_regression"] = f"""WITH {_SHOCKS}, t AS (SELECT count(*) FILTER (passed) AS p, count(*) AS n
  FROM shocks)
SELECT CASE WHEN n = 0 THEN 'C' WHEN p = n THEN 'A' WHEN p >= 0.75 * n THEN 'B' WHEN p >= 0.5 * n THEN 'C'
  ELSE 'D' END AS resilience_grade, p AS passed_tests, n AS total_tests, round(p / n, 6) AS pass_rate FROM t"""

MODEL_SQL["grid_ridge"] = f"""WITH {PRICE},
placed AS (SELECT *, row_number() OVER (ORDER BY {u('key', 'fold')}, {u('key', 'fold tie')}) AS place,
  count(*) OVER () AS n FROM train),
folded AS (SELECT *, CASE WHEN place <= n // 3 THEN 0 WHEN place <= 2 * n // 3 THEN 1 ELSE 2 END AS fold FROM placed),
trials AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 1.0), (2, 10.0)) t(trial_id, alpha)),
rest AS (SELECT trial_id, alpha, held, folded.* FROM folded JOIN range(3) r(held) ON fold <> held, trials),
{fit('rest', ('trial_id', 'held'), 'any_value(alpha)')},
errors AS (SELECT trial_id, fold, avg(abs(y - ({predicted()}))) AS mae FROM folded JOIN w ON fold = held
  GROUP BY ALL),
scores AS (SELECT trial_id, -avg(mae) AS score FROM errors GROUP BY trial_id)
SELECT trial_id::INTEGER AS trial_id, 'ridge_regression' AS name, '{{"alpha": ' || alpha::VARCHAR || '}}' AS params,
  round(score, 6) AS score, (1 + (SELECT count(*) FROM scores o WHERE o.score > s.score))::INTEGER AS rank
FROM scores s JOIN trials USING (trial_id)"""


def _model_interval(model: str, alpha: str) -> str:
    return f"""(WITH {fit('train', alpha=alpha)}, scored AS (SELECT key, y, {predicted()} AS yhat FROM val, w),
us AS (SELECT {_unit(1000)} AS unit, count(*) AS n, sum(abs(y - yhat)) AS a FROM scored GROUP BY 1),
scores AS (SELECT replicate, sum(a * w) / sum(n * w) AS score FROM us JOIN weights USING (unit) GROUP BY replicate)
SELECT '{model}' AS model_id, * FROM ({_interval('mae', 'score')}))"""


MODEL_SQL["ladder_intervals"] = f"""WITH {PRICE}, {_weights(1000, 1000)}
{_model_interval('linear_regression', '0')} UNION ALL {_model_interval('ridge_regression', '10.0')}"""
