"""One query per operator over the catalog tables. Each reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions.hashing import key_text, uniform
from ..functions.storage import prepared, shared_folder
from ..operators import (
    bootstrap,
    calibration,
    curves,
    exploration,
    fairness,
    features,
    leakage,
    metrics,
    models,
    pii,
    profile,
    robustness,
    splits,
)
from .study import Settings, run_study

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(
        *[
            (F.round(c, special.get(c, digits)) if c in doubles else F.col(c)).alias(c)
            for c in df.columns
        ]
    )


# --- inputs -----------------------------------------------------------------


def spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A catalog table over all cores, for queries that hash or search every row."""
    return sources.spread_table(
        sources.read_table(spark, sf, name), sources.table_info(name).keys
    )


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with one text ``key`` that identifies a row."""
    rows = spread(spark, sf, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    key = key_text(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price])
    return rows.withColumn("key", key)


def scored_binary(spark: SparkSession, sf: str) -> DataFrame:
    """y is whether the row was returned, p a score that knows it in part, with many ties."""
    y = (F.col("l_returnflag") == "R").cast("int")
    p = F.floor((0.25 * F.col("y") + 0.75 * uniform(["key"])) * 1000) / 1000
    return (
        lineitem(spark, sf)
        .select("key", "l_linestatus", "l_linenumber", y.alias("y"))
        .withColumn("p", p)
        .withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    )


def scored_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes; a tenth of the guesses per other class are wrong."""
    u = uniform(["key"])
    guess = (
        F.when(u < 0.1, F.lit("A")).when(u < 0.2, F.lit("N")).when(u < 0.3, F.lit("R"))
        .otherwise(F.col("l_returnflag"))
    )
    return lineitem(spark, sf).select(
        "key", "l_linestatus", "l_linenumber", F.col("l_returnflag").alias("y"), guess.alias("yhat")
    )


def scored_numbers(spark: SparkSession, sf: str) -> DataFrame:
    guess = 1000 * F.col("l_quantity") + 25000 * uniform(["key"])
    return lineitem(spark, sf).select(
        "key", "l_linestatus", "l_linenumber", F.col("l_extendedprice").alias("y"), guess.alias("yhat")
    )


def gappy_orders(spark: SparkSession, sf: str) -> DataFrame:
    """orders with cells emptied by rule: NULL, and NaN in the price."""
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, None).when(k % 11 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    return sources.read_table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        price.alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


def split_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem features with gaps and a hashed split."""
    k = F.col("l_orderkey")
    rows = lineitem(spark, sf).select(
        "key",
        F.when(k % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        "l_linenumber",
        F.when(k % 5 != 0, F.col("l_linestatus")).alias("l_linestatus"),
        "l_returnflag",
    )
    return splits.hashed_split(rows, ["key"])


# --- sources ----------------------------------------------------------------


@query
def scan_named(spark, sf):
    return sources.read_table(spark, sf, "orders")


@query
def csv_types(spark, sf):
    k = F.col("o_orderkey")
    raw = sources.read_table(spark, sf, "orders").select(
        k.cast("string").alias("o_orderkey"),
        F.when(k % 3 == 0, F.lit("NA")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(k % 4 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("even"),
    )
    return sources.typed_csv(raw)


@query
def csv_files(spark, sf):
    """Two CSV files with different columns and missing cells, written and read back."""
    orders = sources.read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 3 == 0, F.lit("NA")).otherwise(F.col("o_totalprice").cast("string"))
    priority = F.when(k % 5 == 0, F.lit("n/a")).otherwise(F.col("o_orderpriority"))
    parts = [
        orders.where(k % 2 == 0).select("o_orderkey", price.alias("o_totalprice")),
        orders.where(k % 2 == 1).select(priority.alias("o_orderpriority"), "o_orderkey"),
    ]
    folder = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    paths = [
        sources.write_table(part, f"{folder}/tabassay-csv-{uuid.uuid4().hex}", "csv") for part in parts
    ]
    return sources.read_csv(spark, paths)


@query
def concat_by_name(spark, sf):
    orders = sources.read_table(spark, sf, "orders")
    return sources.concat_tables(
        [
            orders.select("o_orderkey", "o_totalprice"),
            orders.select("o_orderpriority", "o_orderkey"),
        ]
    )


@query
def fingerprint(spark, sf):
    orders = sources.read_table(spark, sf, "orders")
    # Prices as decimals and dates as microseconds: texts of doubles and dates differ between engines.
    exact = orders.withColumns(
        {
            "o_totalprice": F.col("o_totalprice").cast("decimal(20,4)"),
            "o_orderdate": F.unix_micros(F.col("o_orderdate").cast("timestamp")),
        }
    )
    return sources.fingerprint(exact, "orders")


# --- profile ----------------------------------------------------------------


@query
def profile_columns(spark, sf):
    return profile.column_types(gappy_orders(spark, sf)).join(
        profile.missing_profile(gappy_orders(spark, sf)).select("column", "n_rows"), "column"
    )


@query
def profile_shape(spark, sf):
    return profile.shape(gappy_orders(spark, sf))


@query
def profile_missing(spark, sf):
    return profile.missing_profile(gappy_orders(spark, sf))


@query
def profile_numeric(spark, sf):
    # The mean of cents over 60,000 rows can end exactly half way at 6 digits.
    return rounded(profile.numeric_profile(spread(spark, sf, "lineitem")), mean=7)


@query
def profile_numeric_gaps(spark, sf):
    return rounded(profile.numeric_profile(gappy_orders(spark, sf)))


@query
def profile_categorical(spark, sf):
    return profile.categorical_profile(gappy_orders(spark, sf))


@query
def top_values(spark, sf):
    return profile.top_values(sources.read_table(spark, sf, "customer"))


@query
def distinct_counts(spark, sf):
    return profile.distinct_counts(gappy_orders(spark, sf)).drop("position")


@query
def candidate_targets(spark, sf):
    return profile.candidate_targets(spread(spark, sf, "lineitem"))


@query
def insights(spark, sf):
    return profile.insights(gappy_orders(spark, sf))


@query
def feature_correlations(spark, sf):
    return rounded(exploration.feature_correlations(leaky_lineitem(spark, sf)))


@query
def outliers(spark, sf):
    """A high power of the price has a long right tail."""
    orders = sources.read_table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    return rounded(
        exploration.outliers(orders.withColumn("skewed", F.pow(F.col("o_totalprice") / 500000, F.lit(6.0))))
    )


# --- leakage ----------------------------------------------------------------


def leaky_lineitem(spark, sf):
    price = F.col("l_extendedprice")
    return lineitem(spark, sf).select(
        "l_quantity",
        "l_discount",
        "l_extendedprice",
        "l_returnflag",
        F.lit(7.0).alias("flat"),
        (2 * price + 1).alias("price_twin"),
        (price + 26000 * (uniform(["key"]) - 0.5)).alias("price_score"),
    )


@query
def leakage_correlations(spark, sf):
    return rounded(leakage.correlations(leaky_lineitem(spark, sf), "l_extendedprice"))


@query
def leakage_findings(spark, sf):
    return rounded(leakage.leakage_findings(leaky_lineitem(spark, sf), "l_extendedprice"))


@query
def leakage_verdict(spark, sf):
    rows = leaky_lineitem(spark, sf)
    return leakage.leakage_verdict(
        leakage.leakage_findings(rows, "l_extendedprice"), len(rows.columns) - 1
    )


@query
def leakage_time_check(spark, sf):
    events = sources.read_table(spark, sf, "events")
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    texts = events.select(
        F.col("value"),
        F.when(F.col("event_id") % 100 == 3, F.lit("soon")).otherwise(when).alias("at"),
    )
    return rounded(leakage.leakage_findings(texts, "value", "time", "at"))


# --- personal data ----------------------------------------------------------


@query
def pii_scan(spark, sf):
    return pii.scan(spread(spark, sf, "documents"))


@query
def pii_scan_pages(spark, sf):
    return pii.scan(spread(spark, sf, "pages"))


@query
def pii_summary(spark, sf):
    return pii.summarize(spread(spark, sf, "documents"))


@query
def pii_samples(spark, sf):
    return pii.samples(spread(spark, sf, "documents"), "doc_id")


@query
def pii_redact(spark, sf):
    return pii.redact(spread(spark, sf, "documents"))


@query
def pii_redaction_log(spark, sf):
    return pii.redaction_log(spread(spark, sf, "pages"))


@query
def pii_names(spark, sf):
    return pii.personal_names(sources.read_table(spark, sf, "customer"))


# --- splits -----------------------------------------------------------------


@query
def split_random(spark, sf):
    orders = sources.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return splits.random_split(orders, "o_orderstatus", ["o_orderkey"])


@query
def split_random_unstratified(spark, sf):
    orders = sources.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return splits.random_split(orders, "o_totalprice", ["o_orderkey"]).drop("o_totalprice")


@query
def split_hashed(spark, sf):
    return splits.hashed_split(lineitem(spark, sf).select("key"), ["key"])


@query
def split_time(spark, sf):
    events = sources.read_table(spark, sf, "events").select("event_id", "ts")
    return splits.time_split(events, "ts", ["event_id"]).drop("ts")


@query
def split_time_ties(spark, sf):
    """Many rows per day: the cuts fall inside a day."""
    orders = sources.read_table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day")
    )
    return splits.time_split(orders, "day", ["o_orderkey"]).drop("day")


@query
def split_summary(spark, sf):
    return rounded(splits.split_summary(split_lineitem(spark, sf)))


@query
def split_classes(spark, sf):
    return splits.class_distribution(split_lineitem(spark, sf), "l_returnflag")


@query
def split_time_ranges(spark, sf):
    events = sources.read_table(spark, sf, "events").select("event_id", "ts")
    return splits.time_ranges(splits.time_split(events, "ts", ["event_id"]), "ts")


@query
def folds(spark, sf):
    orders = sources.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return splits.assign_folds(orders, ["o_orderkey"], 3, "o_orderstatus")


@query
def folds_in_time(spark, sf):
    events = sources.read_table(spark, sf, "events").select("event_id", "ts")
    return splits.time_folds(events, "ts", ["event_id"]).drop("ts")


@query
def sample_in_proportion(spark, sf):
    orders = sources.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return splits.stratified_sample(orders, "o_orderstatus", ["o_orderkey"], 1000)


# --- features ---------------------------------------------------------------


@query
def feature_plan(spark, sf):
    plan = features.plan(gappy_orders(spark, sf), "o_orderstatus", ["o_custkey"])
    return plan.withColumn("transforms", F.concat_ws(",", "transforms"))


@query
def feature_plan_summary(spark, sf):
    return features.plan_summary(gappy_orders(spark, sf), "o_orderstatus", ["o_custkey"])


@query
def feature_params(spark, sf):
    rows = split_lineitem(spark, sf).where(F.col("split") == "train")
    columns = ["l_quantity", "l_extendedprice", "l_linenumber"]
    return rounded(features.FeatureParams(features.fit_numeric(rows, columns)).table(spark))


@query
def vocabulary(spark, sf):
    rows = split_lineitem(spark, sf).where(F.col("split") == "train")
    return features.fit_vocabulary(rows, ["l_linestatus", "l_returnflag"])[0]


def _encoded(spark, sf, small_rows=None):
    orders = splits.hashed_split(
        sources.read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"]
    )
    odd = (F.col("split") == "test") & (F.col("o_orderkey") % 9 == 0)
    rows = orders.withColumn(
        "o_orderpriority",
        F.when(odd, F.lit("9-NEW")).when(F.col("o_orderkey") % 10 != 1, F.col("o_orderpriority")),
    )
    words, n = features.fit_vocabulary(rows.where(F.col("split") == "train"), ["o_orderpriority"], small_rows)
    return features.encode(rows, words, ["o_orderpriority"], n)


@query
def label_encode(spark, sf):
    """Orders of the training split teach the clerks' priorities; the last day brings new ones."""
    return _encoded(spark, sf)


@query
def label_encode_large(spark, sf):
    """The same codes, as from a vocabulary too large to broadcast."""
    return _encoded(spark, sf, small_rows=2)


@query
def vocabulary_large(spark, sf):
    """The same positions, as from a vocabulary too large to broadcast."""
    rows = split_lineitem(spark, sf).where(F.col("split") == "train")
    return features.fit_vocabulary(rows, ["l_linestatus", "l_returnflag"], small_rows=2)[0].drop("share")


@query
def apply_plan(spark, sf):
    rows = prepared(split_lineitem(spark, sf))
    ready, _ = features.fit_transform(rows, "l_returnflag", ["key"])
    return rounded(ready)


# --- metrics ----------------------------------------------------------------


@query
def confusion_matrix(spark, sf):
    return metrics.confusion(scored_classes(spark, sf))


@query
def class_report(spark, sf):
    return rounded(metrics.class_report(metrics.confusion(scored_classes(spark, sf))))


@query
def classification_metrics(spark, sf):
    return rounded(metrics.classification_metrics(scored_classes(spark, sf)))


@query
def regression_metrics(spark, sf):
    return rounded(metrics.regression_metrics(scored_numbers(spark, sf)))


@query
def evaluate_binary(spark, sf):
    return rounded(metrics.evaluate(scored_binary(spark, sf), "classification", p="p"))


@query
def ranking_metrics(spark, sf):
    return rounded(metrics.ranking_metrics(scored_binary(spark, sf)))


@query
def ranking_metrics_buckets(spark, sf):
    """The same areas with running totals over many buckets."""
    return rounded(metrics.ranking_metrics(scored_binary(spark, sf), buckets=5))


@query
def residual_bins(spark, sf):
    return rounded(metrics.residual_bins(scored_numbers(spark, sf)), 4)


@query
def model_ranking(spark, sf):
    """Cut-offs of one score as competing models, measured and ranked together."""
    rows = scored_binary(spark, sf)
    guesses = F.array(
        *[
            F.struct(F.lit(name).alias("model_id"), (F.col("p") >= cut).cast("int").alias("yhat"))
            for name, cut in (("low", 0.3), ("middle", 0.5), ("high", 0.7), ("higher", 0.8))
        ]
    )
    results = metrics.classification_metrics(
        rows.select("y", F.inline(guesses)), by=["model_id"]
    ).drop("n_rows")
    return rounded(metrics.top_models(metrics.rank_models(results, "f1_score"), 3))


@query
def model_ranking_errors(spark, sf):
    """Ascending ranking by mae of guesses with different offsets."""
    rows = scored_numbers(spark, sf)
    guesses = F.array(
        *[
            F.struct(F.lit(f"plus_{o}").alias("model_id"), (F.col("yhat") + o).alias("yhat"))
            for o in (0, 5000, 10000)
        ]
    )
    results = metrics.regression_metrics(rows.select("y", F.inline(guesses)), by=["model_id"])
    return rounded(metrics.rank_models(results.select("model_id", "mae", "r2"), "mae"))


# --- bootstrap --------------------------------------------------------------


@query
def labelled_lengths(spark, sf):
    """Documents joined with their labels: how well length alone tells good quality, per language."""
    docs = sources.read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = sources.read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    scored = docs.join(labels, "doc_id").withColumn("yhat", (F.col("n_chars") >= 300).cast("int"))
    return rounded(fairness.slice_metrics(scored, ["lang"], "classification"))


@query
def bootstrap_accuracy(spark, sf):
    return rounded(
        bootstrap.bootstrap_scores(scored_binary(spark, sf), ["key"], "accuracy")
    )


@query
def bootstrap_ci_f1(spark, sf):
    return rounded(
        bootstrap.bootstrap_ci(scored_classes(spark, sf), ["key"], "f1_score")
    )


@query
def bootstrap_ci_mae(spark, sf):
    return rounded(
        bootstrap.bootstrap_ci(scored_numbers(spark, sf), ["key"], "mae")
    )


@query
def bootstrap_ci_r2(spark, sf):
    return rounded(
        bootstrap.bootstrap_ci(scored_numbers(spark, sf), ["key"], "r2")
    )


@query
def bootstrap_ci_precision(spark, sf):
    return rounded(bootstrap.bootstrap_ci(scored_classes(spark, sf), ["key"], "precision"))


@query
def bootstrap_ci_recall(spark, sf):
    return rounded(bootstrap.bootstrap_ci(scored_classes(spark, sf), ["key"], "recall"))


@query
def bootstrap_ci_rmse(spark, sf):
    return rounded(bootstrap.bootstrap_ci(scored_numbers(spark, sf), ["key"], "rmse"))


@query
def bootstrap_ci_full(spark, sf):
    """The default interval: 1000 replicates."""
    return rounded(bootstrap.bootstrap_ci(scored_binary(spark, sf), ["key"], "accuracy"))


# --- curves -----------------------------------------------------------------


@query
def pr_curve(spark, sf):
    return rounded(curves.pr_curve(scored_binary(spark, sf)))


@query
def pr_curve_buckets(spark, sf):
    """The same curve with running totals over many buckets."""
    return rounded(curves.pr_curve(scored_binary(spark, sf), buckets=5))


@query
def optimal_threshold(spark, sf):
    return rounded(curves.optimal_threshold(curves.pr_curve(scored_binary(spark, sf))))


@query
def operating_point(spark, sf):
    return rounded(curves.operating_point(curves.pr_curve(scored_binary(spark, sf))))


@query
def lift_curve(spark, sf):
    return rounded(curves.lift_curve(scored_binary(spark, sf), ["key"]))


@query
def lift_summary(spark, sf):
    return rounded(curves.lift_summary(curves.lift_curve(scored_binary(spark, sf), ["key"])))


@query
def calibration_curve(spark, sf):
    return rounded(curves.calibration_curve(scored_binary(spark, sf)))


@query
def ece_mean(spark, sf):
    return rounded(curves.ece(scored_binary(spark, sf)))


@query
def ece_center(spark, sf):
    return rounded(curves.ece(scored_binary(spark, sf), closed="left", at="center"))


@query
def brier(spark, sf):
    return rounded(curves.brier(scored_binary(spark, sf)))


@query
def bars(spark, sf):
    return rounded(curves.bars(sources.read_table(spark, sf, "events"), "event_type", "value", "avg"))


# --- fairness ---------------------------------------------------------------


def biased_classes(spark, sf):
    """Guesses for one line status and for late line numbers are worse."""
    u = uniform(["key"], salt="bias")
    worse = (F.col("l_linestatus") == "O") & (u < 0.25) | (F.col("l_linenumber") > 5) & (u < 0.4)
    return scored_classes(spark, sf).withColumn("yhat", F.when(worse, F.lit("A")).otherwise(F.col("yhat")))


@query
def slice_metrics(spark, sf):
    return rounded(
        fairness.slice_metrics(
            biased_classes(spark, sf), ["l_linestatus", "l_linenumber", "absent"], "classification"
        )
    )


@query
def slice_metrics_errors(spark, sf):
    return rounded(
        fairness.slice_metrics(scored_numbers(spark, sf), ["l_linestatus", "l_linenumber"], "regression")
    )


@query
def disparity(spark, sf):
    slices = fairness.slice_metrics(
        biased_classes(spark, sf), ["l_linestatus", "l_linenumber"], "classification"
    )
    return rounded(fairness.disparity(slices))


@query
def fairness_summary(spark, sf):
    slices = fairness.slice_metrics(
        biased_classes(spark, sf), ["l_linestatus", "l_linenumber"], "classification"
    )
    return fairness.fairness_summary(slices)


# --- robustness -------------------------------------------------------------


def shock_input(spark, sf):
    return lineitem(spark, sf).select("key", "l_quantity", "l_extendedprice")


@query
def shock_missing(spark, sf):
    return rounded(
        robustness.missing_shock(shock_input(spark, sf), ["l_quantity", "l_extendedprice"], ["key"])
    )


@query
def shock_noise(spark, sf):
    return rounded(
        robustness.noise_shock(shock_input(spark, sf), ["l_quantity", "l_extendedprice"], ["key"]), 4
    )


@query
def ablate_number(spark, sf):
    return rounded(robustness.ablate(shock_input(spark, sf), "l_quantity"))


@query
def ablate_text(spark, sf):
    orders = sources.read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return robustness.ablate(orders, "o_orderpriority")


# --- models -----------------------------------------------------------------

PRICE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def price_table(spark, sf):
    """A number that depends on the other columns, for regression models."""
    rows = lineitem(spark, sf)
    noise = 200 * (uniform(["key"], salt="price") - 0.5)
    total = 30 * F.col("l_quantity") * (1 - F.col("l_discount")) + 5 * F.col("l_linenumber") + noise
    table = splits.hashed_split(rows.select("key", *PRICE_FEATURES, total.alias("total")), ["key"])
    return prepared(table)


def returned_table(spark, sf):
    """A flag that depends on the other columns, for classification models."""
    rows = lineitem(spark, sf)
    chance = 0.1 + 0.7 * (F.col("l_quantity") > 25).cast("int") * (F.col("l_discount") > 0.04).cast("int")
    flag = (uniform(["key"], salt="flag") < chance).cast("int")
    table = rows.select("key", "l_linestatus", *PRICE_FEATURES, flag.alias("flag"))
    parted = prepared(splits.hashed_split(table, ["key"]))
    return features.fit_transform(parted, "flag", ["key", "l_linestatus"])[0]


def _parts(df):
    return [splits.split_rows(df, s) for s in ("train", "val", "test")]


@query
def ols_line(spark, sf):
    """Slope and intercept of the price on the quantity."""
    fitted = models.fit_model(
        {"name": "linear_regression"}, lineitem(spark, sf), "l_extendedprice", ["l_quantity"]
    )
    row = [(float(fitted.model.coefficients[0]), float(fitted.model.intercept))]
    return rounded(spark.createDataFrame(row, "slope double, intercept double"), 4)


@query
def ladder_classification(spark, sf):
    train, val, _ = _parts(returned_table(spark, sf))
    specs = [
        {"name": "logistic_regression", "params": {}},
        {"name": "random_forest_classifier", "params": {"n_estimators": 100, "max_depth": 6}},
    ]
    trained = models.whole_ladder(train, val, "flag", PRICE_FEATURES, "classification", specs)
    return rounded(models.leaderboard(train, trained).drop("train_seconds"))


@query
def ladder_regression(spark, sf):
    train, val, _ = _parts(price_table(spark, sf))
    specs = [
        {"name": "linear_regression", "params": {}},
        {"name": "random_forest_regressor", "params": {"n_estimators": 100, "max_depth": 6}},
    ]
    trained = models.whole_ladder(train, val, "total", PRICE_FEATURES, "regression", specs)
    return rounded(models.leaderboard(train, trained).drop("train_seconds"))


@query
def ladder_intervals(spark, sf):
    train, val, _ = _parts(price_table(spark, sf))
    specs = [
        {"name": "linear_regression", "params": {}},
        {"name": "ridge_regression", "params": {"alpha": 10.0}},
    ]
    trained, _ = models.train_ladder(train, val, "total", PRICE_FEATURES, "regression", specs)
    return rounded(models.leaderboard_intervals(trained, val, "total", ["key"], "mae"))


@query
def evaluate_model(spark, sf):
    train, _, test = _parts(returned_table(spark, sf))
    fitted = models.fit_model({"name": "logistic_regression"}, train, "flag", PRICE_FEATURES)
    return rounded(models.evaluate_model(fitted, test, "flag"))


@query
def grid_logistic(spark, sf):
    train, _, _ = _parts(returned_table(spark, sf))
    folded = splits.assign_folds(train, ["key"], 3, "flag")
    return rounded(models.grid_search(folded, "flag", PRICE_FEATURES, "logistic_regression"))


@query
def grid_ridge(spark, sf):
    train, _, _ = _parts(price_table(spark, sf))
    folded = splits.assign_folds(train, ["key"], 3)
    return rounded(models.grid_search(folded, "total", PRICE_FEATURES, "logistic_regression", "regression"))


@query
def grid_forest(spark, sf):
    train, _, _ = _parts(returned_table(spark, sf))
    folded = splits.assign_folds(train, ["key"], 3, "flag")
    return rounded(models.grid_search(folded, "flag", PRICE_FEATURES, "random_forest", "classification"))


@query
def calibrate_isotonic(spark, sf):
    scored = scored_binary(spark, sf)
    calibrated, _ = calibration.calibrate(scored, method="isotonic")
    return rounded(calibration.calibration_report(calibrated))


@query
def calibrate_sigmoid(spark, sf):
    scored = scored_binary(spark, sf)
    calibrated, _ = calibration.calibrate(scored, method="sigmoid")
    return rounded(calibration.calibration_report(calibrated))


def _forest(spark, sf):
    train, val, _ = _parts(returned_table(spark, sf))
    spec = {"name": "random_forest_classifier", "params": {"n_estimators": 100, "max_depth": 5}}
    return models.fit_model(spec, train, "flag", PRICE_FEATURES), val


@query
def feature_importance(spark, sf):
    fitted, val = _forest(spark, sf)
    return rounded(robustness.feature_importance(val, fitted))


@query
def ablation(spark, sf):
    fitted, val = _forest(spark, sf)
    return rounded(robustness.ablation(val, fitted, "flag"))


@query
def ablation_summary(spark, sf):
    train, val, _ = _parts(price_table(spark, sf))
    fitted = models.fit_model({"name": "linear_regression"}, train, "total", PRICE_FEATURES)
    return rounded(robustness.drop_summary(robustness.ablation(val, fitted, "total")))


def _linear(spark, sf):
    train, val, test = _parts(price_table(spark, sf))
    return models.fit_model({"name": "linear_regression"}, train, "total", PRICE_FEATURES), val, test


@query
def evaluate_regression(spark, sf):
    fitted, _, test = _linear(spark, sf)
    return rounded(models.evaluate_model(fitted, test, "total"))


@query
def ablation_regression(spark, sf):
    fitted, val, _ = _linear(spark, sf)
    return rounded(robustness.ablation(val, fitted, "total"))


@query
def shock_tests_regression(spark, sf):
    fitted, val, _ = _linear(spark, sf)
    return rounded(robustness.shock_tests(val, fitted, "total", ["key"]))


@query
def shock_grade_regression(spark, sf):
    fitted, val, _ = _linear(spark, sf)
    return rounded(robustness.grade(robustness.shock_tests(val, fitted, "total", ["key"])))


@query
def shock_tests(spark, sf):
    fitted, val = _forest(spark, sf)
    return rounded(robustness.shock_tests(val, fitted, "flag", ["key"]))


@query
def shock_grade(spark, sf):
    fitted, val = _forest(spark, sf)
    return rounded(robustness.grade(robustness.shock_tests(val, fitted, "flag", ["key"])))


@query
def full_study(spark, sf):
    """Every stage on the priority of orders with gaps, ending in the report rows."""
    orders = gappy_orders(spark, sf)
    urgent = (F.col("o_totalprice") > 250000) & (uniform(["o_orderkey"], salt="urgent") < 0.8)
    table = orders.select(
        "o_orderkey",
        "o_totalprice",
        "o_orderstatus",
        "o_orderpriority",
        F.coalesce(urgent, F.lit(False)).cast("int").alias("urgent"),
    )
    settings = Settings(
        target="urgent",
        keys=["o_orderkey"],
        sensitive=["o_orderstatus"],
        specs=[
            {"name": "logistic_regression", "params": {}},
            {"name": "random_forest_classifier", "params": {"n_estimators": 100, "max_depth": 4}},
        ],
        calibrate="isotonic",
    )
    return run_study(table, settings).tables["report"]
