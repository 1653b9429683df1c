"""From a CSV file to stored results."""

import csv
from dataclasses import replace

from pyspark.ml import PipelineModel

from frames import CLASS_ROWS, METER_SCHEMA, meter_rows
from wattshelf.operators.product_quality import QualityRules
from wattshelf.operators.tfidf import TfidfSettings
from wattshelf.plans import classify, forecast, jobs


def write(path, header, rows):
    with path.open("w", newline="", encoding="utf-8") as handle:
        csv.writer(handle).writerows([header, *rows])
    return str(path)


def test_check_products(spark, tmp_path):
    path = write(
        tmp_path / "p.csv", ["product_name", "description", "brand", "price", "category"],
        [["Kettle", "Gooseneck kettle,\nholds one litre", "Brugg", 48.5, "Kitchen"], ["Trowel", "n/a", "Brugg", "12", "None"]],
    )
    rules = QualityRules(row_id="", allowed_categories=("Kitchen",))
    report = jobs.check_products(spark, path, str(tmp_path / "reports"), rules).first()
    # The spellings of missing are read as null, so the second row fails on both counts.
    assert (report["row_count"], report["empty_description_count"], report["null_category_count"]) == (2, 1, 1)
    assert spark.read.json(str(tmp_path / "reports")).count() == 1
    header = write(tmp_path / "q.csv", ["product_name", "description", "brand", "price", "category"], [["a", "b", "c", 1, "Kitchen"]])
    assert jobs.check_products(spark, header, rules=rules).first()["is_valid"]


def test_column_types_of_a_csv(spark, tmp_path):
    names = ["product_name", "description", "brand", "price", "category"]
    path = write(tmp_path / "t.csv", names, [[1, "a", "b", 5, "Kitchen"], [2, "c", "d", 6, "Kitchen"]])
    rules = QualityRules(row_id="", allowed_categories=("Kitchen",))
    assert jobs.check_products(spark, path, rules=rules).first()["is_valid"]  # everything is text
    typed = jobs.check_products(spark, path, rules=rules, infer=True).first()
    assert not typed["is_valid"] and "product_name" in str(typed["incorrect_data_types"])


def test_check_meter_keeps_text_for_the_numeric_check(spark, tmp_path):
    names = [part.strip().rsplit(" ", 1)[0].strip("`") for part in METER_SCHEMA.split(",")]
    rows = [list(r) for r in meter_rows(50)]
    rows[3][1] = "a lot"
    path = write(tmp_path / "meter.csv", names, rows)
    errors = jobs.check_meter(spark, path)
    assert errors == ["column Usage_kWh must be numeric"], errors


def test_build_features(spark, tmp_path):
    path = write(tmp_path / "p.csv", ["product_name", "description"], [["Oak shelf", "Wall shelf, oiled oak"], ["Desk lamp", "Brass lamp with dimmer"]])
    out = str(tmp_path / "out")
    summary = jobs.build_features(spark, path, out, settings=TfidfSettings(min_df=1, max_df=1.0)).first()
    assert summary["row_count"] == 2 and summary["text_columns"] == "product_name,description"
    assert spark.read.parquet(f"{out}/vocabulary").count() == summary["feature_count"] > 0
    assert spark.read.parquet(f"{out}/features").count() == 2
    assert len(PipelineModel.load(f"{out}/vectorizer").stages[0].vocabulary) == summary["feature_count"]


def test_train_products(spark, tmp_path):
    path = write(tmp_path / "p.csv", ["name", "main_category"], [row[:2] for row in CLASS_ROWS])
    settings = classify.TrainingSettings(
        key="", min_df=1, max_df=1.0, test_share=0.25, logistic_iterations=20, forest_trees=None, boosted_rounds=None
    )
    result = jobs.train_products(spark, path, str(tmp_path / "out"), settings)
    assert result.category_column == "main_category" and result.train_row_count == 6
    assert spark.read.parquet(str(tmp_path / "out" / "runs")).count() == 3
    scorer = classify.ProductScorer.load(str(tmp_path / "out" / "scorer"))
    assert scorer.score(spark.createDataFrame([("knife",)], "request_text string")).count() == 1
    small = jobs.train_products(spark, path, str(tmp_path / "small"), replace(settings, sample_size=6))
    assert small.row_count == 6


def test_train_energy(spark, tmp_path):
    names = [part.strip().rsplit(" ", 1)[0].strip("`") for part in METER_SCHEMA.split(",")]
    path = write(tmp_path / "meter.csv", names, meter_rows(800))
    roster = {"linear_regression": forecast.candidate_regressors()["linear_regression"]}
    result = jobs.train_energy(spark, path, METER_SCHEMA, str(tmp_path / "out"), roster=roster)
    assert result.selected_model == "linear_regression"
    assert spark.read.json(str(tmp_path / "out" / "comparison")).count() == 3
    assert len(PipelineModel.load(str(tmp_path / "out" / "model")).stages) == 5
