import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from frames import CLASS_ROWS, class_frame, meter_frame
from wattshelf.functions.fixed_values import CLASSIFIER_ROSTER, MODEL_CATEGORICAL, MODEL_NUMERIC
from wattshelf.operators.metrics import best_run
from wattshelf.operators.series_features import build_features
from wattshelf.operators.series_quality import SeriesRules
from wattshelf.operators.split import chronological_split
from wattshelf.plans import classify, forecast


def settings(**changes):
    base = dict(
        key="row_id", text_columns=("name",), category="main_category", min_df=1, max_df=1.0, test_share=0.25,
        logistic_iterations=50, forest_trees=5, forest_depth=5, boosted_rounds=None,
    )
    return classify.TrainingSettings(**(base | changes))


@pytest.fixture(scope="module")
def trained(spark):
    return classify.train_and_select(class_frame(spark), settings())


def test_training_result(trained):
    assert trained.best_model_name in CLASSIFIER_ROSTER[:3]
    assert (trained.row_count, trained.train_row_count, trained.test_row_count) == (8, 6, 2)
    assert trained.category_column == "main_category" and trained.sub_category_column is None
    rows = {r["model_name"]: r for r in trained.runs.collect()}
    assert list(sorted(rows, key=lambda n: rows[n]["ordinal"])) == list(CLASSIFIER_ROSTER)
    assert [r["status"] for r in sorted(rows.values(), key=lambda r: r["ordinal"])] == ["trained"] * 3 + ["skipped"]
    assert [n for n in rows if rows[n]["selected"]] == [trained.best_model_name]
    assert len(trained.model_version) == 14 and len(trained.dataset_version) == 64


def test_report_rows_feed_the_registry(trained):
    report = trained.report()
    assert report.count() == 4
    assert report.first()["params"]["category_column"] == "main_category"
    assert best_run(report, "f1_score").count() == 4


def test_scorer_survives_storage(spark, trained, tmp_path):
    requests = spark.createDataFrame(
        [(1, "running <b>shoes</b>", None, None), (2, " ", "bluetooth", "audio"), (3, None, "", None)],
        "id long, text string, product_name string, description string",
    )
    scored, rejected = classify.score_products(trained.scorer, requests)
    rows = {r["id"]: r for r in scored.collect()}
    assert set(rows) == {1, 2} and rejected.first()["id"] == 3
    assert rows[1]["cleaned_text"] == "running shoes" and rows[2]["cleaned_text"] == "bluetooth audio"
    assert rows[1]["predicted_category"] in {"garden", "kitchen"} and rows[1]["predicted_sub_category"] is None
    assert 0 < rows[1]["confidence"] <= 1
    trained.scorer.save(str(tmp_path / "scorer"))
    again, _ = classify.score_products(classify.ProductScorer.load(str(tmp_path / "scorer")), requests)
    assert {r["id"]: r for r in again.collect()} == rows


def test_composite_labels_come_back_in_two_parts(spark):
    chosen = settings(sub_category="sub_category", forest_trees=None, test_share=0.5)
    result = classify.train_and_select(class_frame(spark, sub_category=True), chosen)
    assert result.sub_category_column == "sub_category"
    row = result.scorer.score(spark.createDataFrame([("bread knife",)], "request_text string")).first()
    assert row["predicted_category"] in {"garden", "kitchen"}
    assert row["predicted_sub_category"] in {"watering", "planting", "cookware", "knives"}


@pytest.mark.parametrize("name", [*CLASSIFIER_ROSTER[:3], classify.BOOSTED])
def test_every_classifier_learns_a_separable_set(spark, name):
    rows = [(i, CLASS_ROWS[i % 8][0], CLASS_ROWS[i % 8][1]) for i in range(64)]
    frame = spark.createDataFrame(rows, "row_id long, name string, main_category string")
    chosen = settings(boosted_rounds=3, boosted_depth=3)
    frames = classify.training_frames(frame, chosen)
    roster = [c for c in classify.candidates(chosen, float(frames.counts["train"])) if c.name == name]
    metrics, models = classify.fit_candidates(frames, chosen, roster)
    assert metrics[0]["accuracy"] == 1.0
    predicted = models[name].predict(frames.test)
    assert predicted.filter("confidence between 0.5 and 1").count() == predicted.count() == metrics[0]["predictions"].count()


def test_naive_bayes_uses_plain_class_shares(spark):
    """Posterior from the definition: log share of the class plus smoothed term log-probabilities."""
    rows = [(i, "red apple" if i % 4 else "blue sea", "a" if i % 4 else "b") for i in range(40)]
    rows += [(100 + i, "red sea", "a") for i in range(4)]
    frame = spark.createDataFrame(rows, "row_id long, name string, main_category string")
    frames = classify.training_frames(frame, settings())
    roster = [c for c in classify.candidates(settings(), 1.0) if c.name == classify.BAYES]
    _, models = classify.fit_candidates(frames, settings(), roster)
    train = frames.train.select(vector_to_array("features").alias("x"), "label").collect()
    x, y = np.array([r["x"] for r in train]), np.array([r["label"] for r in train])
    joint = []
    for label in models[classify.BAYES].labels:
        sums = x[y == label].sum(0) + 1
        joint.append((np.log((y == label).mean()), np.log(sums / sums.sum())))
    for row in models[classify.BAYES].predict(frames.train).select(vector_to_array("features").alias("x"), "confidence", "predicted_label").collect():
        scores = np.array([prior + np.array(row["x"]) @ theta for prior, theta in joint])
        shares = np.exp(scores - scores.max())
        assert math.isclose(row["confidence"], shares.max() / shares.sum(), rel_tol=1e-9)
        assert row["predicted_label"] == models[classify.BAYES].labels[int(scores.argmax())]


def test_one_label_is_refused(spark):
    with pytest.raises(ValueError, match="two different labels"):
        classify.train_and_select(class_frame(spark).filter("main_category = 'kitchen'"), settings())


def test_logistic_regression_minimises_the_penalised_loss(spark):
    """Weighted loss with unit penalty: the gradient vanishes at the fitted coefficients."""
    frames = classify.training_frames(class_frame(spark), settings())
    model = classify.candidates(settings(logistic_iterations=1000), float(frames.counts["train"]))[0].estimator.fit(frames.train)
    rows = frames.train.select(vector_to_array("features").alias("x"), "label_index", "weight").collect()
    x = np.array([r["x"] for r in rows])
    y = np.eye(model.numClasses)[[int(r["label_index"]) for r in rows]]
    weight = np.array([r["weight"] for r in rows])[:, None]
    beta = model.coefficientMatrix.toArray()
    z = x @ beta.T + model.interceptVector.toArray()
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    used = sorted({int(r["label_index"]) for r in rows})
    gradient = ((p - y) * weight).T @ x + beta
    assert np.abs(gradient[used]).max() < 2e-2


def test_naive_bayes_parameters(spark):
    terms = spark.createDataFrame([("x",), ("y",)], "term string")
    rows = spark.createDataFrame([("a", "x")] * 2 + [("a", "z")] * 9 + [("b", "y")], "label string, term string")
    got = {(r["label"], r["term"]): r["log_probability"] for r in classify.naive_bayes_parameters(rows, terms).collect()}
    expected = {("a", "x"): 3 / 4, ("a", "y"): 1 / 4, ("b", "x"): 1 / 3, ("b", "y"): 2 / 3}
    assert all(math.isclose(got[k], math.log(v)) for k, v in expected.items()) and len(got) == 4


# --- Forecasting --------------------------------------------------------------------------


def test_fill_and_scale(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "`a.b` double").withColumn("k", F.lit(5.0))
    fills = forecast.fit_numeric(frame, ["a.b", "k"])
    assert fills["a.b"].median == 2.5 and fills["k"].scale == 1.0
    values = np.array([1, 2, 3, 10, 2.5])
    got = sorted(r[0] for r in forecast.filled_numeric(frame, {"a.b": fills["a.b"]}).select("`a.b`").collect())
    np.testing.assert_allclose(got, sorted((values - values.mean()) / values.std()))


def test_mode_takes_smallest_of_equals(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert forecast.fit_modes(frame, ["c"]) == {"c": "a"}


def test_preprocessor_stage_equals_columns_and_ignores_unseen(spark, tmp_path):
    frame = spark.createDataFrame([(1.0, "x's"), (None, "y"), (5.0, "x's"), (float("nan"), None)], "`n.1` double, c string")
    model = forecast.fit_preprocessor(frame, ["n.1"], ["c"])
    model.write().overwrite().save(str(tmp_path / "prep"))
    model = PipelineModel.load(str(tmp_path / "prep"))
    new = spark.createDataFrame([(3.0, "new"), (3.0, "y")], "`n.1` double, c string")
    rows = [r["features"].toArray().tolist() for r in model.transform(new).collect()]
    assert rows == [[0.0, 0.0, 0.0], [0.0, 0.0, 1.0]]


@pytest.fixture(scope="module")
def featured(spark):
    return build_features(meter_frame(spark, 1000)).cache()


def test_forecaster_end_to_end(spark, featured, tmp_path):
    roster = forecast.candidate_regressors(trees=3, rounds=3)
    split = chronological_split(featured, F.col("date"), "date")
    result = forecast.fit_and_compare(split, roster=roster)
    rows = {r["model_name"]: r for r in result.runs.collect()}
    assert set(rows) == {"linear_regression", "random_forest", "gradient_boosting", "xgboost", "lightgbm"}
    assert rows["xgboost"]["status"] == "skipped" and rows["xgboost"]["reason"]
    trained = [r for r in rows.values() if r["status"] == "trained"]
    assert result.selected_model == min(trained, key=lambda r: (r["validation_rmse"], r["ordinal"]))["model_name"]
    assert rows["linear_regression"]["validation_r2"] > 0.5
    result.model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    a = forecast.score_energy(featured, result.model).orderBy("date").select("prediction").collect()
    assert a == forecast.score_energy(featured, loaded).orderBy("date").select("prediction").collect()


def test_train_forecaster_validates_first(spark):
    roster = {"linear_regression": forecast.candidate_regressors()["linear_regression"]}
    assert forecast.train_forecaster(meter_frame(spark, 800), rules=SeriesRules(), roster=roster).selected_model == "linear_regression"
    with pytest.raises(ValueError, match="uninterrupted"):
        forecast.train_forecaster(meter_frame(spark, 800).filter("NSM <> 900"), roster=roster)


def test_roster_settings():
    roster = forecast.candidate_regressors()
    assert list(roster) == ["linear_regression", "random_forest", "gradient_boosting"]
    forest = forecast.default_regressor()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getSeed()) == (200, 15, 2, 42)
    boosted = roster["gradient_boosting"]
    assert (boosted.getMaxIter(), boosted.getStepSize(), boosted.getMaxDepth()) == (200, 0.05, 4)
    assert len(MODEL_NUMERIC) == 20 and len(MODEL_CATEGORICAL) == 3


def test_scoring_refuses_missing_features_and_bad_predictions(spark, featured):
    with pytest.raises(ValueError, match="usage_lag_672"):
        forecast.score_energy(featured.drop("usage_lag_672"), None)
    class Broken:
        @staticmethod
        def transform(df):
            return df.withColumn("prediction", F.lit(float("nan")))
    kept = forecast.score_energy(featured, Broken, reject=False)
    assert kept.filter("prediction is null").count() == featured.count()
    with pytest.raises(Exception, match="non-finite"):
        forecast.score_energy(featured, Broken).collect()


def test_queries_fit_with_default_features_rounds_and_depth():
    from wattshelf.plans.catalog import models

    assert models.SETTINGS == classify.TrainingSettings(key="doc_id", text_columns=("description",))


def test_regressors_read_rows_dealt_over_all_cores(spark):
    """A series that comes from one task, as from one row group, is fitted and scored by as many tasks as there are cores."""
    seen = []

    class Reader:
        def fit(self, train):
            seen.append((train.rdd.glom().map(len).collect(), train.count()))
            return LinearRegression(solver="normal", featuresCol="features", labelCol="y").fit(train)

    at = F.when(F.col("id") < 700, "train").when(F.col("id") < 850, "validation").otherwise("test")
    rows = spark.range(0, 1000, 1, 1).select("id", (F.col("id") * 2.0).alias("y"), F.col("id").cast("double").alias("x"), at.alias("split"))
    result = forecast.fit_and_compare(rows, "y", ["x"], [], {"linear": Reader()}, (), key="id")
    sizes, total = seen[0]
    cores = spark.sparkContext.defaultParallelism
    assert total == sum(sizes) == 700 and len(sizes) >= cores and max(sizes) <= 2 * 700 / cores
    found = result.predictions["linear"].collect()
    assert sorted(r["id"] for r in found) == list(range(700, 1000)) and all(abs(r["prediction"] - r["y"]) < 1e-6 for r in found)
