"""Evaluation, comparison, gates and the run registry as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshelf.functions.columns import finite, null_if_nan, quoted
from wattshelf.functions.fixed_values import CLASSIFIER_ROSTER


def confusion(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    keys = [quoted(name).alias(name) for name in groups]
    return df.groupBy(
        *keys, quoted(actual).cast("string").alias("actual"), quoted(predicted).cast("string").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("rows"))


def class_scores(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    hit = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("rows")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.col("rows").alias("support"),
            none.alias("claimed"),
            hit.cast("bigint").alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            none.alias("support"),
            F.col("rows").alias("claimed"),
            none.alias("hits"),
        ),
    )
    per_class = (
        confusion(df, actual, predicted, groups)
        .select(*groups, F.explode(sides).alias("s"))
        .groupBy(*groups, F.col("s.label").alias("label"))
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.claimed").alias("claimed"),
            F.sum("s.hits").alias("hits"),
        )
    )
    return per_class.withColumns(
        {
            "precision": F.coalesce(F.try_divide("hits", "claimed"), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide("hits", "support"), F.lit(0.0)),
            "f1_score": F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("claimed")), F.lit(0.0)),
        }
    )


def classification_metrics(
    df: DataFrame, actual: str, predicted: str, average: str = "weighted", groups: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and averaged precision, recall and F1: one row (per group)."""
    scores = class_scores(df, actual, predicted, groups)

    def averaged(name: str) -> Column:
        if average == "weighted":
            return F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support"))
        if average == "macro":
            return F.avg(name)
        if average == "micro":
            return F.try_divide(F.sum("hits"), F.sum("support"))
        raise ValueError(f"unknown average: {average}")

    measures = [
        F.sum("support").alias("row_count"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[averaged(name).alias(name) for name in ("precision", "recall", "f1_score")],
    ]
    return scores.groupBy(*groups).agg(*measures) if groups else scores.agg(*measures)


def regression_metrics(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R2 = 1 - SSE/SST in one pass: one row (per group)."""
    y, p = F.col("_y"), F.col("_p")
    pairs = df.select(
        *[quoted(name).alias(name) for name in groups],
        null_if_nan(quoted(actual).cast("double")).alias("_y"),
        null_if_nan(quoted(predicted).cast("double")).alias("_p"),
    ).filter(y.isNotNull() & p.isNotNull())
    sums = [
        F.count(F.lit(1)).alias("row_count"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("_mse"),
        F.var_pop(y).alias("_var"),
    ]
    totals = pairs.groupBy(*groups).agg(*sums) if groups else pairs.agg(*sums)
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).otherwise(
        F.when(F.col("_mse") == 0, 1.0).otherwise(0.0)
    )
    return totals.select(*groups, "row_count", "mae", F.sqrt("_mse").alias("rmse"), r2.alias("r2"))


def best_classifier(runs: DataFrame) -> DataFrame:
    """Highest (F1, accuracy) among trained runs; the earlier run wins a tie."""
    trained = runs.filter(F.col("status") == "trained")
    return trained.orderBy(F.desc("f1_score"), F.desc("accuracy"), F.asc("ordinal")).limit(1)


def best_regressor(runs: DataFrame, metric: str = "validation_rmse") -> DataFrame:
    """Lowest validation error among trained runs; the earlier run wins a tie."""
    trained = runs.filter(F.col("status") == "trained")
    return trained.orderBy(F.asc(metric), F.asc("ordinal")).limit(1)


def comparison_table(runs: DataFrame, best: DataFrame) -> DataFrame:
    """All runs with the chosen one marked."""
    chosen = best.select(F.col("model_name").alias("_best"))
    return runs.join(F.broadcast(chosen), F.col("model_name") == F.col("_best"), "left").withColumn(
        "selected", F.col("_best").isNotNull()
    ).drop("_best")


def comparison_roster(metrics: DataFrame, roster: Sequence[str] = CLASSIFIER_ROSTER) -> DataFrame:
    """The known models in fixed order, absent ones as ``not run``, then any further models."""
    known = metrics.sparkSession.createDataFrame(list(enumerate(roster)), "position int, model_name string")
    values = ["accuracy", "precision", "recall", "f1_score"]
    listed = known.join(metrics, "model_name", "left").select(
        "position",
        "model_name",
        *values,
        F.coalesce("status", F.lit("not run")).alias("status"),
    )
    further = metrics.join(F.broadcast(known), "model_name", "left_anti").select(
        F.lit(len(roster)).alias("position"), "model_name", *values, "status"
    )
    return listed.unionByName(further)


def quality_gate(
    metrics: DataFrame,
    max_mae: float | None = None,
    min_r2: float | None = None,
    mae: str = "validation_mae",
    r2: str = "validation_r2",
) -> DataFrame:
    """Failures per metrics row. An unset limit is no check; a missing metric fails a set one."""
    infinity = float("inf")
    checks = []
    if max_mae is not None:
        worse = F.coalesce(quoted(mae), F.lit(infinity)) > F.lit(float(max_mae))
        checks.append(F.when(worse, F.lit(f"{mae} is above {max_mae}")))
    if min_r2 is not None:
        worse = F.coalesce(quoted(r2), F.lit(-infinity)) < F.lit(float(min_r2))
        checks.append(F.when(worse, F.lit(f"{r2} is below {min_r2}")))
    failures = F.filter(F.array(*checks).cast("array<string>"), lambda text: text.isNotNull())
    return metrics.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def prediction_checks(df: DataFrame, prediction: str, upper: float | None = None) -> DataFrame:
    """Are all predictions finite and non-negative; count and range. Missing values fail."""
    value = null_if_nan(quoted(prediction).cast("double"))
    no = F.lit(False)
    aggregates = [
        F.coalesce(F.bool_and(finite(quoted(prediction)).isNotNull()), F.lit(True)).alias("finite_predictions"),
        F.coalesce(F.bool_and(F.coalesce(value >= 0, no)), F.lit(True)).alias("non_negative_predictions"),
        F.count(value).alias("prediction_count"),
        F.min(value).alias("prediction_min"),
        F.max(value).alias("prediction_max"),
    ]
    if upper is not None:
        inside = F.coalesce(value <= F.lit(float(upper)), no)
        aggregates.append(F.coalesce(F.bool_and(inside), F.lit(True)).alias("within_range"))
    return df.agg(*aggregates)


# --- Run registry -------------------------------------------------------------------------

RUN_SCHEMA = (
    "run_id string, model_name string, model_version string, params map<string,string>, "
    "tags map<string,string>, metrics map<string,double>, created_at timestamp"
)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each model."""
    newest = F.max_by(F.struct("run_id", "model_version"), F.struct("created_at", "run_id"))
    return runs.groupBy("model_name").agg(newest.alias("r")).select("model_name", "r.*")


def best_run(runs: DataFrame, metric: str = "f1_score") -> DataFrame:
    """The run with the highest metric of each model, the earliest of equals."""
    scored = runs.withColumn("_m", F.col("metrics")[metric]).filter(F.col("_m").isNotNull())
    rank = F.struct(F.col("_m"), -F.unix_micros("created_at"))
    return (
        scored.groupBy("model_name")
        .agg(F.max_by(F.struct("run_id", "model_version", F.col("_m").alias(metric)), rank).alias("r"))
        .select("model_name", "r.*")
    )


def next_version(registered: DataFrame, model_name: str) -> DataFrame:
    """The version number the next registration of a model gets."""
    mine = registered.filter(F.col("model_name") == model_name)
    return mine.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
