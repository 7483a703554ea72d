"""Queries of feature transforms, executed plans, rolling splits and exact resampling."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import sources
from ..functions.columns import col
from ..functions.hashing import uniform
from ..functions.storage import prepared, shared_folder, stored
from ..operators import (
    bootstrap,
    encoders,
    exploration,
    fairness,
    features,
    leakage,
    models,
    pii,
    splits,
    transforms,
)
from .catalog_queries import PRICE_FEATURES, _parts, lineitem, price_table, query, rounded


def supplied(spark, sf):
    """lineitem with two text columns, one of many values and gaps, and a hashed split."""
    k = F.col("l_orderkey")
    rows = lineitem(spark, sf).select(
        "key",
        F.when(k % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(k % 3 != 0, F.col("l_discount")).alias("l_discount"),
        "l_linenumber",
        F.when(k % 5 != 0, F.col("l_linestatus")).alias("l_linestatus"),
        F.when(k % 11 != 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("supplier"),
    )
    return prepared(splits.hashed_split(rows, ["key"]))


def _train(df):
    return df.where(F.col("split") == "train")


def _target_encoded(spark, sf, small_rows=None):
    rows = supplied(spark, sf)
    columns = ["supplier", "l_linestatus"]
    means = encoders.fit_target_means(_train(rows), columns, "l_extendedprice", ["key"], small_rows=small_rows)
    out = encoders.target_encode(rows.select("key", *columns, "split"), means)
    return rounded(out, 4)


@query
def target_encode(spark, sf):
    """Mean price per supplier and status: training rows without their own fold, others with all."""
    return _target_encoded(spark, sf)


@query
def target_encode_large(spark, sf):
    """The same means, as from too many categories to broadcast."""
    return _target_encoded(spark, sf, small_rows=2)


def _one_hot(spark, sf, small_rows=None):
    rows = supplied(spark, sf).withColumn("flag", F.col("l_linestatus"))
    teach = _train(rows).where("l_linenumber < 5")
    vocabulary, small = features.fit_vocabulary(teach, ["supplier", "l_linestatus"], small_rows)
    out = encoders.one_hot(rows, vocabulary, ["supplier", "l_linestatus"], small)
    shown = lambda c: F.array_join(F.transform(vector_to_array(c), lambda x: x.cast("int").cast("string")), "")
    return out.select("key", encoders.hot_slot("supplier").alias("slot"), shown("l_linestatus").alias("status"))


@query
def one_hot(spark, sf):
    """Slots per supplier and status seen in training; others have none."""
    return _one_hot(spark, sf)


@query
def one_hot_large(spark, sf):
    """The same slots, as from a vocabulary too large to broadcast."""
    return _one_hot(spark, sf, small_rows=2)


@query
def one_hot_linear(spark, sf):
    """A linear model on one-hot texts and a number, measured on test rows."""
    noise = 200 * (uniform(["key"], salt="price") - 0.5)
    lift = F.when(F.col("l_returnflag") == "A", 40).when(F.col("l_returnflag") == "N", -25).otherwise(0)
    rows = lineitem(spark, sf)
    total = 30 * F.col("l_quantity") + lift + 7 * (F.col("l_linestatus") == "F").cast("int") + noise
    table = prepared(
        splits.hashed_split(rows.select("key", "l_quantity", "l_returnflag", "l_linestatus", total.alias("total")), ["key"])
    )
    plan = {c: ["one_hot_encode"] for c in ("l_returnflag", "l_linestatus")}
    params = transforms.fit_plan(_train(table), plan, options=transforms.Options(drop_last=True))
    train, _, test = _parts(transforms.apply_plan(table, params))
    fitted = models.fit_model({"name": "linear_regression"}, train, "total", models.model_features(train, "total", ["key"]))
    return rounded(models.evaluate_model(fitted, test, "total"))


@query
def hash_encode(spark, sf):
    """Slot and sign of every supplier and status in vectors of 64 slots."""
    rows = supplied(spark, sf)
    columns = ["supplier", "l_linestatus"]
    out = encoders.hash_encode(rows, columns, 64)
    cells = []
    for c in columns:
        filled = vector_to_array(c)
        cells.append((F.array_position(F.transform(filled, F.abs), 1.0) - 1).cast("bigint").alias(f"{c}_slot"))
        cells.append(F.aggregate(filled, F.lit(0.0), lambda a, x: a + x).cast("int").alias(f"{c}_sign"))
    return out.select("key", *cells)


@query
def box_cox(spark, sf):
    """Exponent of the largest likelihood per column, and moments of the transformed values."""
    rows = lineitem(spark, sf)
    values = {c: col(c).cast("double") for c in ("l_extendedprice", "l_quantity")}
    found = transforms.box_cox_exponents(rows, values)
    table = [(c, e, m, v) for c, (e, m, v) in found.items()]
    df = spark.createDataFrame(table, "column string, exponent double, mean double, variance double")
    return rounded(df, 4)


@query
def products(spark, sf):
    """Powers and products of three columns up to the third degree."""
    names = ["l_quantity", "l_discount", "l_tax"]
    rows = lineitem(spark, sf).select("key", *names)
    return rounded(transforms.add_products(rows, transforms.monomials(names, 3)))


@query
def product_linear(spark, sf):
    """A linear model that needs a product of two columns."""
    table = transforms.add_products(price_table(spark, sf), [("l_quantity", "l_discount")])
    train, _, test = _parts(table)
    names = ["l_quantity", "l_discount", "l_quantity*l_discount", "l_linenumber"]
    fitted = models.fit_model({"name": "linear_regression"}, train, "total", names)
    return rounded(models.evaluate_model(fitted, test, "total"))


EDITED = {
    "l_quantity": ["impute_mean", "log_transform", "min_max_scale", "polynomial_features"],
    "l_discount": ["impute_mode", "interaction_features", "standard_scale"],
    "l_linenumber": ["sqrt_transform", "robust_scale", "interaction_features"],
    "l_linestatus": ["impute_mode", "ordinal_encode"],
    "supplier": ["target_encode"],
}


@query
def run_plan(spark, sf):
    """A plan whose transforms were edited, carried out."""
    rows = supplied(spark, sf)
    plan = features.plan(rows.drop("split"), "l_extendedprice", ["key"])
    edited = F.lit(None).cast("array<string>")
    for c, steps in EDITED.items():
        edited = F.when(F.col("column") == c, F.array(*[F.lit(s) for s in steps])).otherwise(edited)
    plan = plan.withColumn("transforms", F.coalesce(edited, F.col("transforms")))
    options = transforms.Options(orders={"l_linestatus": ["O", "F"]})
    out, _ = transforms.run_plan(rows, plan, "l_extendedprice", ["key"], options)
    return rounded(out, 4)


@query
def run_plan_default(spark, sf):
    """The plan as made, with its high-cardinality encoding, carried out."""
    rows = supplied(spark, sf)
    plan = features.plan(rows.drop("split"), "l_extendedprice", ["key"])
    out, _ = transforms.run_plan(rows, plan, "l_extendedprice", ["key"], transforms.Options(hash_width=32))
    many = dict(out.dtypes)["supplier"] == "vector"
    vector = vector_to_array("supplier") if many else F.array(F.col("supplier").cast("double"))
    slot = F.array_position(F.transform(vector, F.abs), 1.0) - 1 if many else vector[0]
    sign = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x) if many else F.lit(0)
    shown = out.select(
        "key", "l_quantity", "l_discount", "l_linenumber", "l_linestatus", "split",
        slot.cast("bigint").alias("slot"), sign.cast("int").alias("sign"),
    )
    return rounded(shown, 4)


def shipped(spark, sf):
    return lineitem(spark, sf).select("key", "l_shipdate")


@query
def rolling_splits(spark, sf):
    """Expanding windows over the ship date, with a gap before validation and test."""
    rows, roles = splits.rolling_split(shipped(spark, sf), "l_shipdate", ["key"], folds=4, gap=1, val=1)
    return splits.rolling_summary(rows, roles, "l_shipdate")


@query
def rolling_windows(spark, sf):
    """Windows of two stretches that move along the ship date, tested on the next two."""
    rows, roles = splits.rolling_split(shipped(spark, sf), "l_shipdate", ["key"], folds=3, window=2, test=2, first=2)
    return splits.rolling_summary(rows, roles, "l_shipdate")


@query
def grid_rolling(spark, sf):
    """Ridge strengths compared on windows that move along the ship date."""
    dates = lineitem(spark, sf).select("key", "l_shipdate")
    rows = stored(price_table(spark, sf).join(dates, "key"))  # joined once, not in every pass over it
    parted, roles = splits.rolling_split(rows, "l_shipdate", ["key"], folds=3)
    found = models.grid_search(
        parted, "total", PRICE_FEATURES, "logistic_regression", "regression", {"alpha": [0.1, 10.0, 1000.0]}, roles=roles
    )
    return rounded(found)


def balances(spark, sf):
    """Customers with a guess of their balance, and whether it is in the black."""
    guess = F.col("c_acctbal") + 3000 * (uniform(["c_custkey"], salt="guess") - 0.5)
    rows = sources.read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", guess.alias("guess"))
    sign = lambda c: (F.col(c) > 0).cast("int")
    return rows.withColumns({"y": sign("c_acctbal"), "yhat": sign("guess")})


@query
def bootstrap_exact(spark, sf):
    """Interval of the mean error from resampled rows, as many draws as rows."""
    return rounded(
        bootstrap.bootstrap_ci(balances(spark, sf), ["c_custkey"], "mae", "c_acctbal", "guess", 50, method="exact")
    )


@query
def bootstrap_exact_accuracy(spark, sf):
    rows = balances(spark, sf)
    return rounded(bootstrap.bootstrap_scores(rows, ["c_custkey"], "accuracy", "y", "yhat", 50, method="exact"))


@query
def exact_draws(spark, sf):
    """How many rows each replicate draws, and how many of them are different."""
    drawn = bootstrap.exact_weights(balances(spark, sf), ["c_custkey"], 50, bootstrap.SEED)
    return drawn.groupBy("replicate").agg(F.sum("weight").alias("draws"), F.count(F.lit(1)).alias("rows"))


# --- sinks and gates


@query
def split_sink(spark, sf):
    """Rows written in a folder per split and read back, as counts and sums."""
    folder = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    path = sources.write_splits(supplied(spark, sf), f"{folder}/tabassay-splits-{uuid.uuid4().hex}")
    back = spark.read.parquet(path)
    totals = back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price")
    )
    return totals.select("split", "n", F.col("price").cast("double").alias("price"))


@query
def deny_list(spark, sf):
    """Columns of lineitem that a twin of the target makes unfit as features."""
    price = F.col("l_extendedprice")
    rows = lineitem(spark, sf).select(
        "l_quantity", "l_discount", price, (2 * price + 1).alias("price_twin"), (price * 1.5).alias("target_price")
    )
    names = leakage.deny_list(leakage.leakage_findings(rows, "l_extendedprice"))
    return spark.createDataFrame([(c,) for c in names], "column string")


@query
def gate_redacts(spark, sf):
    """Documents as intake lets them through: redacted, because their risk is not low."""
    docs = sources.read_table(spark, sf, "documents").select("doc_id", "text")
    return pii.gate(docs).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query
def gates_block(spark, sf):
    """Which gates refuse: personal data in documents, and a gap between slices."""
    docs = sources.read_table(spark, sf, "documents").select("doc_id", "text")
    labels = sources.read_table(spark, sf, "labels")
    scored = sources.read_table(spark, sf, "documents").join(labels, "doc_id").select(
        F.col("source"), F.col("quality").alias("y"), (F.col("n_chars") >= 300).cast("int").alias("yhat")
    )
    slices = fairness.slice_metrics(scored, ["source"], "classification")

    def refused(run) -> bool:
        try:
            run()
        except ValueError:
            return True
        return False

    found = [
        ("personal_data", refused(lambda: pii.gate(docs, "block"))),
        ("personal_data_let_pass", refused(lambda: pii.gate(docs, "none"))),
        ("fairness", refused(lambda: fairness.require_fair(slices, "block"))),
    ]
    return spark.createDataFrame(found, "gate string, refused boolean")


@query
def outliers_whole(spark, sf):
    """All number columns of orders, keys included."""
    orders = sources.read_table(spark, sf, "orders")
    return rounded(
        exploration.outliers(orders.withColumn("skewed", F.pow(F.col("o_totalprice") / 500000, F.lit(6.0))))
    )
