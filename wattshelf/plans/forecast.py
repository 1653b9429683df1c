"""Meter forecasting: preprocess, fit regressors, compare, gate, save, score."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import finite, null_if_nan, quoted
from wattshelf.functions.fixed_values import (
    MODEL_CATEGORICAL,
    MODEL_NUMERIC,
    OPTIONAL_REGRESSORS,
    REGRESSOR_ROSTER,
    SERIES_TARGET,
    SERIES_TIME,
)
from wattshelf.operators.metrics import best_regressor, comparison_table, regression_metrics
from wattshelf.operators.ranks import exact_quantiles
from wattshelf.operators.regression_forest import RegressionForest, RegressionSettings
from wattshelf.operators.series_features import build_features
from wattshelf.operators.series_quality import SeriesRules, validate_series
from wattshelf.operators.split import chronological_split
from wattshelf.session import materialise, spread
from wattshelf.sources.json_records import require_payloads

LINEAR, FOREST, BOOSTED = REGRESSOR_ROSTER
PARTS = ("train", "validation", "test")
RUN_COLUMNS = (
    "ordinal int, model_name string, status string, reason string, "
    + ", ".join(f"{part}_{m} double" for part in PARTS[1:] for m in ("mae", "rmse", "r2"))
)


@dataclass(frozen=True)
class NumericFill:
    """Median for missing values, then centre and population scale (1 where it is 0)."""

    median: float
    mean: float
    scale: float


def fit_numeric(df: DataFrame, columns: Sequence[str]) -> dict[str, NumericFill]:
    """Exact medians from histograms, then mean and deviation of the filled columns in one pass."""
    safe = {f"n{i}": name for i, name in enumerate(columns)}
    numbers = df.select(*[null_if_nan(quoted(name).cast("double")).alias(alias) for alias, name in safe.items()])
    quantiles, _ = exact_quantiles(numbers, list(safe), [0.5])
    medians = {alias: (quantiles[alias] or [0.0])[0] for alias in safe}
    aggregates = []
    for alias, median in medians.items():
        filled = F.coalesce(finite(F.col(alias)), F.lit(median))
        aggregates += [F.avg(filled).alias(f"{alias}_mean"), F.stddev_pop(filled).alias(f"{alias}_std")]
    row = numbers.agg(*aggregates).first()
    return {
        name: NumericFill(medians[alias], row[f"{alias}_mean"], row[f"{alias}_std"] or 1.0)
        for alias, name in safe.items()
    }


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent value of each column, the smallest of equals."""
    cells = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(name).alias("column"), quoted(name).cast("string").alias("value")) for name in columns]
            )
        ).alias("c")
    ).select("c.*")
    counts = cells.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    most = counts.groupBy("column").agg(F.max("rows").alias("rows"))
    modes = counts.join(most, ["column", "rows"]).groupBy("column").agg(F.min("value").alias("value"))
    found = {row["column"]: row["value"] for row in modes.collect()}
    return {name: found.get(name, "") for name in columns}


def filled_numeric(df: DataFrame, fills: Mapping[str, NumericFill]) -> DataFrame:
    """The imputed and scaled columns under their own names."""
    return df.withColumns(
        {
            name: (F.coalesce(null_if_nan(quoted(name).cast("double")), F.lit(f.median)) - F.lit(f.mean)) / F.lit(f.scale)
            for name, f in fills.items()
        }
    )


def _literal(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def fill_stage(fills: Mapping[str, NumericFill], modes: Mapping[str, str]) -> SQLTransformer:
    """Imputation and scaling as a stage that Spark can save and load."""
    cells = []
    for i, (name, fill) in enumerate(fills.items()):
        column = f"CAST(`{name}` AS DOUBLE)"
        present = f"CASE WHEN NOT isnan({column}) THEN {column} END"
        cells.append(
            f"(coalesce({present}, {_literal(fill.median)}) - {_literal(fill.mean)}) / {_literal(fill.scale)} AS _n{i}"
        )
    for i, (name, mode) in enumerate(modes.items()):
        text = mode.replace("\\", "\\\\").replace("'", "\\'")
        cells.append(f"coalesce(CAST(`{name}` AS STRING), '{text}') AS _c{i}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")


def fit_preprocessor(
    train: DataFrame,
    numeric: Sequence[str] = MODEL_NUMERIC,
    categorical: Sequence[str] = MODEL_CATEGORICAL,
) -> PipelineModel:
    """Fill, scale, one-hot (unseen values give zeros) and assemble ``features``."""
    fills = fit_numeric(train, numeric)
    modes = fit_modes(train, categorical) if categorical else {}
    codes = [f"_c{i}" for i in range(len(modes))]
    stages: list[Any] = [fill_stage(fills, modes)]
    if codes:
        stages += [
            StringIndexer(
                inputCols=codes,
                outputCols=[f"{c}_index" for c in codes],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            OneHotEncoder(
                inputCols=[f"{c}_index" for c in codes], outputCols=[f"{c}_hot" for c in codes], dropLast=True
            ),
        ]
    inputs = [f"_n{i}" for i in range(len(fills))] + [f"{c}_hot" for c in codes]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages).fit(train)


def candidate_regressors(
    target: str = SERIES_TARGET, trees: int = 200, rounds: int = 200, seed: int = 42
) -> dict[str, Any]:
    """The regressor roster; the first one listed wins a tie."""
    columns = {"featuresCol": "features", "labelCol": target}
    return {
        LINEAR: LinearRegression(solver="normal", **columns),
        FOREST: RegressionForest(RegressionSettings(trees, 15, 2, seed), "features", target),
        BOOSTED: GBTRegressor(maxIter=rounds, stepSize=0.05, maxDepth=4, seed=seed, **columns),
    }


def default_regressor(target: str = SERIES_TARGET) -> Any:
    return candidate_regressors(target)[FOREST]


def create_model(estimator: Any, preprocessor: PipelineModel, train: DataFrame) -> PipelineModel:
    """Preprocessor and regressor as one model, fitted on ``train``."""
    return PipelineModel([*preprocessor.stages, estimator.fit(preprocessor.transform(train))])


def evaluate(predicted: DataFrame, target: str, part: str) -> dict[str, float]:
    row = regression_metrics(predicted, target, "prediction").first()
    return {f"{part}_{name}": row[name] for name in ("mae", "rmse", "r2")}


@dataclass
class ForecastResult:
    selected_model: str
    model: PipelineModel
    runs: DataFrame
    metrics: dict[str, float]
    predictions: dict[str, DataFrame]


def fit_and_compare(
    split: DataFrame,
    target: str = SERIES_TARGET,
    numeric: Sequence[str] = MODEL_NUMERIC,
    categorical: Sequence[str] = MODEL_CATEGORICAL,
    roster: Mapping[str, Any] | None = None,
    optional: Sequence[str] = OPTIONAL_REGRESSORS,
    key: str | None = None,
    parallel_fits: int = 4,
) -> ForecastResult:
    """Fit every candidate on the train part, side by side, measure it on the other two, keep the best.

    ``predictions`` holds each candidate's rows (key, if one is named, split, target, prediction), written once; the
    errors are read from them.
    """
    named = [quoted(key)] if key else []
    needed = split.select(*named, *[quoted(name) for name in dict.fromkeys((*numeric, *categorical, target))], "split")
    parts = {part: needed.filter(F.col("split") == part).drop("split") for part in PARTS}
    preprocessor = fit_preprocessor(parts["train"], numeric, categorical)
    # A fit passes over these copies many times: they are dealt out evenly over all cores.
    ready = {
        part: materialise(spread(preprocessor.transform(frame).select(*named, "features", quoted(target))))
        for part, frame in parts.items()
    }
    rows, models, predictions = [], {}, {}
    roster = roster if roster is not None else candidate_regressors(target)
    names = [column.split()[0] for column in RUN_COLUMNS.split(", ")]
    fit = inheritable_thread_target(split.sparkSession)(lambda estimator: estimator.fit(ready["train"]))
    with ThreadPoolExecutor(max(1, parallel_fits)) as pool:
        models = dict(zip(roster, pool.map(fit, roster.values()), strict=True))
    for name, fitted in models.items():
        parted = [fitted.transform(ready[part]).withColumn("split", F.lit(part)) for part in PARTS[1:]]
        predictions[name] = materialise(parted[0].unionByName(parted[1]).select(*named, "split", quoted(target), "prediction"), "predictions")
        row = {"ordinal": len(rows), "model_name": name, "status": "trained"}
        for part in PARTS[1:]:
            row |= evaluate(predictions[name].filter(F.col("split") == part), target, part)
        rows.append(row)
    for name in optional:
        rows.append({"ordinal": len(rows), "model_name": name, "status": "skipped", "reason": f"{name} is not installed"})
    runs = split.sparkSession.createDataFrame([tuple(row.get(n) for n in names) for row in rows], RUN_COLUMNS)
    best = best_regressor(runs).first()
    if best is None:
        raise RuntimeError("no regressor was trained")
    metrics = {n: best[n] for n in names if best[n] is not None and n.startswith(("validation_", "test_"))}
    model = PipelineModel([*preprocessor.stages, models[best["model_name"]]])
    return ForecastResult(best["model_name"], model, comparison_table(runs, best_regressor(runs)), metrics, predictions)


def train_forecaster(
    df: DataFrame, key: str = SERIES_TIME, rules: SeriesRules | None = None, roster: Mapping[str, Any] | None = None
) -> ForecastResult:
    """Validate, build features, split by time, fit, compare."""
    rules = rules or SeriesRules()
    validate_series(df, rules)
    featured = materialise(build_features(df, rules.time, rules.target, rules.series))
    split = chronological_split(featured, quoted(rules.time), key)
    return fit_and_compare(split, rules.target, roster=roster)


def missing_features(columns: Sequence[str], numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    return sorted(set([*numeric, *categorical]) - set(columns))


def score_energy(
    df: DataFrame,
    model: PipelineModel,
    numeric: Sequence[str] = MODEL_NUMERIC,
    categorical: Sequence[str] = MODEL_CATEGORICAL,
    reject: bool = True,
) -> DataFrame:
    """Predictions for rows that carry every feature; a non-finite one fails the job.

    With ``reject=False`` such rows keep a null prediction, for a quarantine filter.
    """
    absent = missing_features(df.columns, numeric, categorical)
    if absent:
        raise ValueError(f"missing features: {absent}")
    predicted = model.transform(df)
    good = finite(F.col("prediction"))
    checked = F.when(good.isNotNull(), good)
    if reject:
        checked = checked.otherwise(F.raise_error(F.lit("non-finite prediction")).cast("double"))
    return predicted.select(*[quoted(name) for name in df.columns], checked.alias("prediction"))


def score_payloads(
    df: DataFrame,
    payload: str,
    model: PipelineModel,
    keep: Sequence[str],
    numeric: Sequence[str] = MODEL_NUMERIC,
    categorical: Sequence[str] = MODEL_CATEGORICAL,
) -> DataFrame:
    """One prediction per record of JSON payloads (an object, a list of objects, or either under ``data``).

    A payload of another shape, a record without a feature and a non-finite prediction fail the job.
    """
    fields = [T.StructField(name, T.DoubleType()) for name in numeric] + [T.StructField(name, T.StringType()) for name in categorical]
    record = T.StructType(fields)
    checked = require_payloads(df, payload, record)
    rows = checked.select(*[quoted(name) for name in keep], F.posexplode("records").alias("position", "_record"))
    complete = F.lit(True)
    for name in (*numeric, *categorical):
        complete = complete & F.col("_record")[name].isNotNull()
    sound = F.when(complete, F.col("_record")).otherwise(F.raise_error(F.lit("a record lacks features")).cast(record))
    features = rows.withColumn("_record", sound).select(*keep, "position", "_record.*")
    return score_energy(features, model, numeric, categorical)


def metrics_json(result: ForecastResult) -> str:
    return json.dumps({"selected_model": result.selected_model, **result.metrics})
