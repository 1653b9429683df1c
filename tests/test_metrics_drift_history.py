import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from wattshelf.operators import drift, history, metrics

NAN, INF = float("nan"), float("inf")


def column(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_class_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "y string, p string")
    got = metrics.classification_metrics(rows, "y", "p").first()
    assert got["accuracy"] == 0.5 and got["row_count"] == 4
    assert math.isclose(got["precision"], (2 * 1 + 1 * 0.5) / 4)
    assert math.isclose(got["recall"], (2 * 0.5 + 1) / 4)
    assert math.isclose(got["f1_score"], (2 * (2 / 3) + 1 * (2 / 3)) / 4)
    macro = metrics.classification_metrics(rows, "y", "p", "macro").first()
    assert math.isclose(macro["recall"], (0.5 + 1 + 0 + 0) / 4)
    assert metrics.classification_metrics(rows, "y", "p", "micro").first()["f1_score"] == 0.5
    with pytest.raises(ValueError):
        metrics.classification_metrics(rows, "y", "p", "other")


def test_class_metrics_agree_with_the_evaluator(spark):
    rows = spark.range(500).select(((F.col("id") * 7) % 4).cast("double").alias("label"), ((F.col("id") * 7 + F.col("id") % 3) % 4).cast("double").alias("prediction"))
    got = metrics.classification_metrics(rows, "label", "prediction").first()
    for ours, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1_score", "f1")):
        assert math.isclose(got[ours], MulticlassClassificationEvaluator(metricName=theirs).evaluate(rows), rel_tol=1e-9)


def test_regression_metrics(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (6.0, 3.0), (None, 1.0)], "y double, p double")
    got = metrics.regression_metrics(rows, "y", "p").first()
    assert got["row_count"] == 3 and math.isclose(got["mae"], 4 / 3)
    assert math.isclose(got["rmse"], math.sqrt(10 / 3)) and math.isclose(got["r2"], 1 - 10 / 14)
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(constant, "y", "p").first()["r2"] == 1.0


RUNS = "ordinal int, model_name string, f1_score double, accuracy double, precision double, recall double, validation_rmse double, status string"


def test_choices_and_ties(spark):
    runs = spark.createDataFrame(
        [(0, "a", 0.5, 0.6, 0.0, 0.0, 2.0, "trained"), (1, "b", 0.5, 0.7, 0.0, 0.0, 1.0, "trained"), (2, "c", 0.5, 0.7, 0.0, 0.0, 1.0, "trained"), (3, "d", 0.9, 0.9, 0.0, 0.0, 0.1, "skipped")],
        RUNS,
    )
    assert metrics.best_classifier(runs).first()["model_name"] == "b"
    assert metrics.best_regressor(runs).first()["model_name"] == "b"
    table = metrics.comparison_table(runs, metrics.best_classifier(runs))
    assert [r["model_name"] for r in table.collect() if r["selected"]] == ["b"]
    roster = metrics.comparison_roster(runs, ("x", "b")).orderBy("position", "model_name").collect()
    assert [(r["model_name"], r["status"]) for r in roster[:2]] == [("x", "not run"), ("b", "trained")]
    assert roster[0]["accuracy"] is None and {r["model_name"] for r in roster[2:]} == {"a", "c", "d"}


def test_quality_gate(spark):
    rows = spark.createDataFrame([(5.0, 0.5), (None, None), (NAN, 0.99)], "validation_mae double, validation_r2 double")
    none = metrics.quality_gate(rows).collect()
    assert all(r["passed"] and r["failures"] == [] for r in none)
    gated = metrics.quality_gate(rows.limit(2), max_mae=4.0, min_r2=0.4).collect()
    assert [len(r["failures"]) for r in gated] == [1, 2]
    assert metrics.quality_gate(rows.limit(1), max_mae=5.0, min_r2=0.5).first()["passed"]


def test_prediction_checks(spark):
    good = metrics.prediction_checks(column(spark, [1.0, 0.0, 3.0]), "x", upper=3).first()
    assert good["finite_predictions"] and good["non_negative_predictions"] and good["within_range"]
    assert (good["prediction_count"], good["prediction_min"], good["prediction_max"]) == (3, 0.0, 3.0)
    bad = metrics.prediction_checks(column(spark, [1.0, NAN, -1.0]), "x", upper=3).first()
    assert not (bad["finite_predictions"] or bad["non_negative_predictions"] or bad["within_range"])
    assert bad["prediction_count"] == 2
    assert not metrics.prediction_checks(column(spark, [1.0, INF]), "x").first()["finite_predictions"]


def psi_by_hand(expected, actual, buckets=10):
    breaks = np.unique(np.quantile(expected, np.linspace(0, 1, buckets + 1)))
    if len(breaks) < 3:
        breaks = np.linspace(min(expected), max(expected) + 1e-6, buckets + 1)
    e, a = (np.histogram(x, breaks)[0] for x in (expected, actual))
    e, a = (np.clip(x / max(x.sum(), 1), 1e-6, None) for x in (e, a))
    return float(((a - e) * np.log(a / e)).sum())


def test_psi_equals_definition(spark):
    rng = np.random.default_rng(11)
    cases = [
        (rng.normal(size=500), rng.normal(0.4, 1.2, size=400)),
        (rng.integers(0, 4, 300).astype(float), rng.integers(0, 6, 300).astype(float)),
        (np.full(40, 7.0), np.array([7.0, 7.0, 8.0])),
        (np.array([0.0] * 30 + [1.0] * 10), np.array([1.0] * 5 + [0.5])),
    ]
    for expected, actual in cases:
        got = drift.drift_report(column(spark, expected.tolist()), column(spark, actual.tolist()), ["x"]).first()
        assert math.isclose(got["psi"], psi_by_hand(expected, actual), rel_tol=1e-9, abs_tol=1e-12)
        assert got["drifted"] == (got["psi"] >= 0.2)


def test_psi_ignores_missing_and_infinite_and_itself_is_zero(spark):
    values = [float(i) for i in range(50)]
    clean, dirty = column(spark, values), column(spark, values + [NAN, INF, -INF, None])
    assert drift.drift_report(clean, dirty, ["x"]).first()["psi"] == 0.0
    for reference, current in ((column(spark, [NAN]), clean), (clean, column(spark, [INF]))):
        with pytest.raises(ValueError):
            drift.drift_report(reference, current, ["x"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-5, 15), min_size=1, max_size=30))
def test_bins_equal_numpy(spark, values):
    breaks = [0.0, 1.0, 2.5, 10.0]
    rows = column(spark, values).select(drift.bin_of(F.col("x"), breaks).alias("b")).filter("b is not null")
    got = np.bincount([r["b"] for r in rows.collect()], minlength=3)
    assert got.tolist() == np.histogram(values, breaks)[0].tolist()


def test_summaries(spark):
    row = drift.prediction_summary(column(spark, [1.0, 3.0, NAN]), "x").first()
    assert (row["count"], row["mean"], row["std"], row["min"], row["max"]) == (2, 2.0, 1.0, 1.0, 3.0)
    frame = spark.createDataFrame([(1.0, 1, "a"), (NAN, 3, "b")], "x double, k int, s string")
    rows = {r["column"]: r for r in drift.feature_summary(frame).collect()}
    assert set(rows) == {"x", "k"} and rows["x"]["missing_rate"] == 0.5 and rows["k"]["std"] == 1.0


def test_delayed_labels(spark):
    p = spark.createDataFrame([(1, 2.0), (2, 5.0)], "id long, p double")
    y = spark.createDataFrame([(1, 1.0), (9, 4.0)], "id long, y double")
    assert drift.delayed_label_performance(p, y, "id", "p", "y").first()["mae"] == 1.0


HISTORY = "prediction_id long, product_id long, predicted_category string, predicted_sub_category string, confidence double, timestamp timestamp"


def test_history(spark):
    day = [datetime(2024, 1, d) for d in range(1, 7)]
    rows = spark.createDataFrame(
        [
            (1, 10, "b", "x", 0.5, day[1]), (2, 10, "a", None, 0.7, day[0]), (3, 11, "a", "", None, day[5]),
            (4, 12, "b", "x", 0.1, day[4]), (5, 10, "", "y", 0.2, day[3]), (6, 11, "", "y", 0.3, day[2]), (7, 11, "", None, 0.3, day[2]),
        ],
        HISTORY,
    )
    kpis = history.history_kpis(rows).first()
    assert (kpis["total_predictions"], kpis["categories"], kpis["sub_categories"]) == (7, 3, 3)
    assert history.top_category(rows).first()[0] == "a"  # as frequent as b, but seen first
    assert history.top_category(rows.limit(0)).first()[0] == "No predictions"
    assert [r["prediction_id"] for r in history.recent_predictions(rows, 2).collect()] == [3, 4]
    assert [tuple(r) for r in history.value_counts(rows, "predicted_sub_category").collect()] == [("x", 2), ("y", 2), ("", 1)]
    assert [r["prediction_id"] for r in history.confidence_series(rows).collect()][:2] == [2, 1]
    assert [r[0] for r in history.category_values(rows).collect()] == ["", "a", "b"]
    products = spark.createDataFrame(
        [(10, "p", "d", "", 1.0), (11, "q", None, None, 2.0), (13, "r", None, "Acme", 3.0)],
        "id long, product_name string, description string, brand string, price double",
    )
    enriched = history.enriched_predictions(rows, products)
    assert enriched.count() == 6
    assert [tuple(r) for r in history.brand_mix(enriched).collect()] == [("Unknown", 6)]


def test_runs(spark):
    rows = spark.createDataFrame(
        [("r1", "m", "1", {"f1_score": 0.5}, datetime(2024, 1, 1)), ("r2", "m", "2", {"f1_score": 0.5}, datetime(2024, 1, 2)), ("r3", "m", "3", {}, datetime(2024, 1, 3))],
        "run_id string, model_name string, model_version string, metrics map<string,double>, created_at timestamp",
    )
    assert metrics.best_run(rows).first()["run_id"] == "r1"
    assert metrics.latest_run(rows).first()["run_id"] == "r3"
    versions = spark.createDataFrame([("m", 3)], "model_name string, version int")
    assert metrics.next_version(versions, "m").first()[0] == 4 and metrics.next_version(versions, "n").first()[0] == 1
