import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabassay.functions import ordering
from tabassay.functions.hashing import key_text, normal, poisson1, poisson_steps, uniform


def skewed_values(n=6000, seed=1):
    """A third of the rows share one value; the rest spread over several scales."""
    rng = np.random.default_rng(seed)
    values = np.concatenate([np.full(n // 3, 5.0), rng.normal(0, 10, n // 3), rng.exponential(1000, n // 3)])
    rng.shuffle(values)
    return values


@pytest.mark.parametrize("scale", [1.0, 1e-300, 1e300, -3.0])
def test_order_statistics_are_exact(spark, scale):
    values = skewed_values() * scale
    values[:4] = [0.0, np.inf, -np.inf, 2.0**-1074]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    n = len(values)
    ranks = [0, 1, n // 4, n // 2, n - 2, n - 1]
    found = ordering.order_statistics(df, {"x": F.col("x")}, {"x": ranks})
    ordered = np.sort(values)
    for r in ranks:
        got = found[("x", r)]
        assert got.value == ordered[r]
        assert got.below == (values < ordered[r]).sum()
        assert got.upto == (values <= ordered[r]).sum()


def test_order_statistics_of_a_constant_and_nulls(spark):
    df = spark.createDataFrame([(7.0, None)] * 200, "x double, y double")
    found = ordering.order_statistics(
        df, {"x": F.col("x"), "y": F.col("y")}, {"x": [0, 199, 200], "y": [0]}
    )
    assert {k for k in found} == {("x", 0), ("x", 199)}
    assert found[("x", 199)].value == 7.0


def test_quantiles_match_numpy(spark):
    values = skewed_values(900)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = ordering.quantiles(df, {"x": F.col("x"), "none": F.lit(None).cast("double")}, [0, 0.1, 0.5, 0.9, 1])
    assert np.allclose(got["x"], np.quantile(values, [0, 0.1, 0.5, 0.9, 1]))
    assert got["none"] == [None] * 5


def test_rank_cuts_take_exactly_k_rows_in_order(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(rng.integers(0, 4)), "a" if rng.random() < 0.7 else "b") for i in range(3000)]
    df = spark.createDataFrame(data, "id int, x double, g string")
    order = [F.col("x"), uniform(["id"], 1)]
    sizes = {g: sum(d[2] == g for d in data) for g in "ab"}
    wanted = {g: (F.col("g") == g, sizes[g], (0, 1, 700, sizes[g])) for g in "ab"}
    cuts = ordering.rank_cuts(df, order, wanted)
    hashed = {r["id"]: r["u"] for r in df.select("id", uniform(["id"], 1).alias("u")).collect()}
    for g in "ab":
        ordered = sorted((d for d in data if d[2] == g), key=lambda d: (d[1], hashed[d[0]]))
        for k in (0, 1, 700, sizes[g]):
            got = {r["id"] for r in df.where(cuts[(g, k)]).collect()}
            assert got == {d[0] for d in ordered[:k]}


@pytest.mark.parametrize("buckets", [1, 9, None])
def test_running_totals_across_buckets(spark, buckets):
    values = np.unique(skewed_values(3000))
    data = [(float(v), i % 7) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "p double, n long")
    for descending in (False, True):
        got = ordering.running_totals(df, "p", {"upto": "n"}, descending, buckets)
        ordered = sorted(data, reverse=descending)
        expected = dict(zip([p for p, _ in ordered], np.cumsum([n for _, n in ordered])))
        assert {r["p"]: r["upto"] for r in rows(got)} == expected


def test_running_totals_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 5)], "p double, n long")
    got = ordering.running_totals(df, "p", {"upto": "n"})
    assert [(r["p"], r["upto"]) for r in rows(got.orderBy("p"))] == [(1.0, 1), (2.0, 6)]
    assert rows(ordering.running_totals(df.limit(0), "p", {"upto": "n"})) == []


@pytest.mark.parametrize("off", [0.0, -500.0, 500.0])
def test_a_wrong_sketch_costs_time_only(spark, monkeypatch, off):
    values = np.sort(skewed_values(30000))
    df = spark.createDataFrame([(float(v), None if i % 2 else float(-v)) for i, v in enumerate(values)], "x double, y double")
    real = F.kll_sketch_get_quantile_double

    def shifted(sketch, shares):
        return F.transform(real(sketch, shares), lambda v: v + off)

    monkeypatch.setattr(ordering.F, "kll_sketch_get_quantile_double", shifted)
    ranks = [0, 1, 2999, 15000, 15001, 29999]
    found = ordering.order_statistics(df.repartition(7), {"x": F.col("x"), "y": F.col("y")}, {"x": ranks, "y": [7000]})
    assert [found["x", r].value for r in ranks] == [values[r] for r in ranks]
    assert found["y", 7000].value == np.sort(-values[::2])[7000]
    assert all(found["x", r].below == (values < values[r]).sum() for r in ranks)


def test_no_task_gets_a_whole_column(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("x"))
    plans = []
    real = type(df).collect

    def spy(self):
        plans.append(self._jdf.queryExecution().toString())
        return real(self)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "collect", spy)
        ordering.order_statistics(df, {"x": F.col("x")}, {"x": [500]}, {"x": 1000})
        ordering.order_statistics(spark.range(9000).select(F.col("id").cast("double").alias("x")), {"x": F.col("x")}, {"x": [8]})
    assert plans
    assert not any("percentile" in p for p in plans)
    # What meets in one task are counts that every task has summed up before.
    assert all("partial_count" in p for p in plans if "SinglePartition" in p)


def test_hash_depends_on_the_key_only(spark):
    df = spark.range(500).withColumn("k", key_text(["id"]))
    draw = lambda d: {r["id"]: r["u"] for r in d.select("id", uniform(["k"], 9, "s").alias("u")).collect()}
    first = draw(df)
    assert first == draw(df.repartition(7))
    assert 0.4 < np.mean(list(first.values())) < 0.6
    assert all(0 <= u < 1 for u in first.values())


def test_normal_and_poisson_draws(spark):
    got = spark.range(20000).select(
        normal(["id"], 1).alias("z"), poisson1(uniform(["id"], 1)).alias("k")
    ).agg(F.avg("z"), F.stddev_pop("z"), F.avg("k"), F.var_pop("k")).first()
    assert abs(got[0]) < 0.03 and abs(got[1] - 1) < 0.03
    assert abs(got[2] - 1) < 0.03 and abs(got[3] - 1) < 0.06
    assert abs(poisson_steps()[-1] - 1) < 1e-12


def test_the_shared_folder_is_the_one_the_cluster_names():
    from types import SimpleNamespace

    from tabassay.functions.storage import shared_folder

    def session(folder):
        context = SimpleNamespace(getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: folder or d))

    assert shared_folder(session("hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(session(None)) is None


@pytest.mark.parametrize("a, b", [((None, "q"), ("q", None)), (("p|q", "r"), ("p", "q|r")), (("", None), (None, ""))])
def test_different_keys_have_different_texts(spark, a, b):
    df = spark.createDataFrame([a, b], "x string, y string")
    assert df.select(key_text(["x", "y"]).alias("k")).distinct().count() == 2


def test_wide_searches_are_split_over_scans(spark, monkeypatch):
    monkeypatch.setattr(ordering, "INTERVALS_PER_SCAN", 2)
    df = spark.range(400).select(*[((F.col("id") * (7 + i)) % 397).cast("double").alias(f"c{i}") for i in range(5)])
    found = ordering.order_statistics(
        df, {f"c{i}": F.col(f"c{i}") for i in range(5)}, {f"c{i}": [0, 200, 399] for i in range(5)}
    )
    data = df.toPandas()
    for i in range(5):
        ordered = np.sort(data[f"c{i}"].to_numpy())
        assert [found[(f"c{i}", r)].value for r in (0, 200, 399)] == [ordered[0], ordered[200], ordered[399]]
