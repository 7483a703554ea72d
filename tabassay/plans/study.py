"""A whole study of one table: check it, prepare it, train, evaluate and report.

The operators do the work; this only wires them. The prepared table is written
once and every later step reads it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.storage import prepared, stored
from ..operators import (
    calibration,
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

_SLICE = "slice of "


@dataclass
class Settings:
    target: str
    keys: Sequence[str]
    task: str | None = None
    policy: str = "iid"
    time_col: str | None = None
    test_size: float = splits.DEFAULT_TEST
    val_size: float = splits.DEFAULT_VAL
    seed: int = splits.DEFAULT_SEED
    pii_action: str = "redact"
    pii_patterns: Sequence[str] | None = None
    sensitive: Sequence[str] = ()
    fairness_action: str = "warn"
    deny: Sequence[str] = ()
    drop_leaky: bool = False
    primary: str | None = None
    specs: Sequence[Mapping] | None = None
    calibrate: str | None = None


@dataclass
class Study:
    """Result tables by name, and what was fitted."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: list[models.TrainedModel] = field(default_factory=list)
    failures: dict[str, str] = field(default_factory=dict)
    params: features.FeatureParams | None = None
    best: models.TrainedModel | None = None


def check(df: DataFrame, settings: Settings, study: Study) -> tuple[DataFrame, list[str]]:
    """Personal data, profile and leakage; returns the cleaned table and the denied columns."""
    study.tables["pii"] = pii.scan(df, settings.pii_patterns)
    clean = pii.gate(df, settings.pii_action, settings.pii_patterns)
    if clean is not df:
        clean = stored(clean)  # redact once, not in every later pass
    study.tables["missing"] = profile.missing_profile(clean)
    study.tables["numeric"] = profile.numeric_profile(clean)
    study.tables["categorical"] = profile.categorical_profile(clean)
    study.tables["candidates"] = profile.candidate_targets(clean)
    study.tables["insights"] = profile.insights(clean)
    found = leakage.leakage_findings(clean, settings.target, settings.policy, settings.time_col)
    verdict = leakage.leakage_verdict(
        found, len(clean.columns) - 1, settings.target in clean.columns
    )
    study.tables["leakage"], study.tables["verdict"] = found, verdict
    denied = list(settings.deny)
    if verdict.first()["status"] == "block":
        leaky = leakage.deny_list(found)
        if not settings.drop_leaky or settings.target in leaky:
            raise RuntimeError(f"Data quality check failed: {', '.join(leaky)}")
        denied += leaky
    return clean, denied


def prepare(df: DataFrame, settings: Settings, denied: Sequence[str], study: Study) -> DataFrame:
    """Split, fit the features on the training rows and write the prepared table once."""
    skip = [*settings.keys, *denied]
    study.tables["plan"] = features.plan(df, settings.target, skip)
    sliced = df.withColumns({_SLICE + c: col(c) for c in settings.sensitive if c in df.columns})
    parted = splits.make_splits(
        sliced,
        settings.target,
        settings.policy,
        list(settings.keys),
        settings.time_col,
        settings.test_size,
        settings.val_size,
        settings.seed,
    )
    table = prepared(parted)
    study.tables["splits"] = splits.split_summary(table)
    study.tables["classes"] = splits.class_distribution(table, settings.target)
    raw = [c for c in table.columns if c.startswith(_SLICE)]
    ready, study.params = features.fit_transform(table, settings.target, [*skip, *raw])
    return ready


def run_study(df: DataFrame, settings: Settings) -> Study:
    """All stages. Raises on blocking leakage unless ``drop_leaky``."""
    study = Study()
    clean, denied = check(df, settings, study)
    table = prepare(clean, settings, denied, study)
    train, val, test = (splits.split_rows(table, s) for s in ("train", "val", "test"))
    target = settings.target
    raw = [c for c in table.columns if c.startswith(_SLICE)]
    inputs = models.model_features(table, target, [*settings.keys, *denied, *raw])
    task = settings.task or splits.infer_task(table, target)
    study.models, study.failures = models.train_ladder(train, val, target, inputs, task, settings.specs)
    if not study.models:
        raise RuntimeError(f"No model could be trained: {study.failures}")
    board = models.leaderboard(table, study.models, settings.primary)
    study.tables["leaderboard"] = board
    winner = metrics.top_models(board, 1).first()
    by_id = {m.model_id: m for m in study.models}
    study.best = by_id[winner["model_id"]] if winner else study.models[0]
    study.tables["test_metrics"] = models.evaluate_model(study.best, test, target)
    scored = study.best.score(test)
    slices = fairness.slice_metrics(
        scored.withColumnsRenamed({c: c.removeprefix(_SLICE) + " " for c in raw}),
        [c.removeprefix(_SLICE) + " " for c in raw],
        task,
        target,
    ).withColumn("column", F.rtrim("column"))
    study.tables["slices"] = slices
    study.tables["disparity"] = fairness.require_fair(slices, settings.fairness_action)
    shocks = robustness.shock_tests(val, study.best, target, list(settings.keys), settings.seed)
    study.tables["shocks"], study.tables["grade"] = shocks, robustness.grade(shocks)
    study.tables["ablation"] = robustness.ablation(val, study.best, target)
    if settings.calibrate and study.best.gives_probability:
        high = F.lit(study.best.labels[-1])
        judged = study.best.score(val).select((col(target) == high).cast("int").alias("y"), "p")
        calibrated, _ = calibration.calibrate(judged, method=settings.calibrate)
        study.tables["calibration"] = calibration.calibration_report(calibrated)
    study.tables["report"] = report(study)
    return study


def report(study: Study) -> DataFrame:
    """``section, item, value`` text rows: the findings a reader looks at first."""
    tables = study.tables

    def lines(name: str, item: str, value: str) -> DataFrame:
        return tables[name].select(
            F.lit(name).alias("section"),
            F.expr(item).cast("string").alias("item"),
            F.expr(value).cast("string").alias("value"),
        )

    parts = [
        lines("insights", "position", "insight"),
        lines("verdict", "'status'", "status"),
        lines("splits", "split", "n_rows"),
        metrics.top_models(tables["leaderboard"], 3).select(
            F.lit("leaderboard").alias("section"),
            F.col("model_id").alias("item"),
            F.round("primary_score", 6).cast("string").alias("value"),
        ),
        lines("test_metrics", "metric", "round(value, 6)"),
        lines("disparity", "`column`", "severity"),
        lines("grade", "'grade'", "resilience_grade"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
