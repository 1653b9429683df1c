from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.sources import csv_files, json_records, tables


def test_csv_null_spellings_quotes_and_types(spark, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text('name,category,price\n"a ""b"", c",None,1.5\nx,none,NaN\n,N/A,\n"two\nlines",ok,2\n', encoding="utf-8")
    rows = csv_files.read_csv(spark, str(path), "name string, category string, price double", multi_line=True).collect()
    assert [tuple(r) for r in rows] == [('a "b", c', None, 1.5), ("x", "none", None), (None, None, None), ("two\nlines", "ok", 2.0)]
    texts = csv_files.read_csv(spark, str(path), multi_line=True)
    assert dict(texts.dtypes) == {"name": "string", "category": "string", "price": "string"}
    with pytest.raises(ValueError):
        csv_files.read_csv(spark, "data.xlsx")


def test_folder_of_csv_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f"x;y\n{name};1\n", encoding="utf-8")
    assert sorted(r["x"] for r in csv_files.read_csv(spark, str(tmp_path), separator=";").collect()) == ["a", "b"]


def test_cleaned_csv(spark, tmp_path):
    path = tmp_path / "raw_products.csv"
    path.write_text('name,main_category,discount_price\n"Running Shoes, for Men",Shoes,"₹1,999"\n', encoding="utf-8")
    out = csv_files.clean_csv(spark, str(path), str(tmp_path / "out"))
    assert out.endswith("/out/raw_products_processed.csv")
    row = csv_files.read_csv(spark, out).first()
    assert row["name_cleaned"] == "running shoes men" and row["discount_price"] == "₹1,999"


RECORD = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType())])


def test_payload_shapes(spark):
    payloads = ['{"k": 1}', '[{"k": 2}, {"k": 3, "s": "x"}]', '{"data": [{"k": 4}]}', '{"data": {"k": 5}}', '"text"', "7", "[]"]
    frame = spark.createDataFrame(list(enumerate(payloads)), "id long, body string")
    rows = json_records.payload_rows(frame, "body", RECORD, ["id"]).orderBy("id", "position").collect()
    assert [(r["id"], r["k"]) for r in rows] == [(0, 1), (1, 2), (1, 3), (2, 4), (3, 5)]
    assert [r["id"] for r in json_records.rejected_payloads(frame, "body", RECORD).collect()] == [4, 5]
    with pytest.raises(Exception, match="unsupported payload"):
        json_records.require_payloads(frame, "body", RECORD).collect()


def test_reports_skip_broken_lines(spark, tmp_path):
    path = tmp_path / "reports"
    path.mkdir()
    (path / "a.json").write_text('{"n": 1, "generated_at": "2024-01-01"}\n{broken\n{"n": 2, "generated_at": "2024-01-02"}\n')
    schema = T.StructType.fromDDL("n bigint, generated_at string")
    reports = json_records.read_reports(spark, str(path), schema)
    assert reports.count() == 2 and json_records.latest_report(reports).first()["n"] == 2
    assert json_records.latest_report(reports.filter("n > 5")).count() == 0


def scored(spark, names):
    return spark.createDataFrame(
        [(i, n, None, None, 1.239, "cat", None, 0.123456) for i, n in enumerate(names)],
        "request_id long, product_name string, description string, brand string, price double, predicted_category string, predicted_sub_category string, confidence double",
    )


def test_scored_batches_replace_themselves(spark, tmp_path):
    products, predictions = str(tmp_path / "products"), str(tmp_path / "predictions")
    order = F.col("request_id")
    stored, made = tables.write_scored_batch(scored(spark, "ab"), 0, order, products, predictions)
    assert sorted(r["id"] for r in stored.collect()) == [1, 2]
    assert made.first()["confidence"] == Decimal("0.12346") and stored.first()["price"] == Decimal("1.24")
    tables.write_scored_batch(scored(spark, "cd"), 1, order, products, predictions)
    tables.write_scored_batch(scored(spark, "cd"), 1, order, products, predictions)
    rows = spark.read.parquet(products).orderBy("id").collect()
    assert [(r["id"], r["product_name"]) for r in rows] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    joined = spark.read.parquet(predictions).withColumnRenamed("timestamp", "t")
    assert tables.missing_products(joined, spark.read.parquet(products)).count() == 0
    assert joined.select("prediction_id").distinct().count() == 4


def test_ids_go_on_from_the_highest(spark):
    rows = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "k long, product_name string")
    rows = rows.withColumns({n: F.lit(None).cast("string") for n in ("description", "brand", "price")})
    got = tables.new_products(rows, F.col("k"), after=7)
    assert [(r["id"], r["product_name"]) for r in got.orderBy("id").collect()] == [(8, "a"), (9, "b"), (10, "c")]
    assert got.schema["created_at"].dataType == T.TimestampType()


def test_append_predictions_by_day(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = spark.createDataFrame([(1, "b", datetime(2024, 1, 1)), (2, "a", datetime(2024, 1, 2))], "prediction_id long, predicted_category string, timestamp timestamp")
    rows = rows.withColumn("predicted_sub_category", F.lit(None).cast("string"))
    tables.append_predictions(rows, path)
    plan = spark.read.parquet(path).filter("day = '2024-01-02'")
    assert [r["prediction_id"] for r in plan.collect()] == [2]
    assert "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().executedPlan().toString()


def test_missing_table_reads_as_empty(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path / "none"), tables.MODELS_SCHEMA).count() == 0


def test_checks_and_upsert(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (-0.1,), (None,)], "confidence double")
    assert tables.confidence_violations(rows).count() == 2
    base = spark.createDataFrame([("1", 0.5, 100), ("2", None, 200)], "version string, accuracy double, created_at long")
    new = spark.createDataFrame([("1", None, 900), ("3", 0.7, 300)], "version string, accuracy double, created_at long")
    merged = {r["version"]: (r["accuracy"], r["created_at"]) for r in tables.upsert_models(base, new).collect()}
    assert merged == {"1": (None, 100), "2": (None, 200), "3": (0.7, 300)}


def test_model_generations(spark, tmp_path):
    path = str(tmp_path / "models")
    at = [datetime(2024, 1, d) for d in (1, 2, 3)]
    first = spark.createDataFrame([("1", Decimal("0.5"), at[0])], tables.MODELS_SCHEMA)
    second = spark.createDataFrame([("1", Decimal("0.75"), at[1]), ("2", None, at[2])], tables.MODELS_SCHEMA)
    tables.store_models(first, path)
    rows = {r["version"]: (r["accuracy"], r["created_at"]) for r in tables.store_models(second, path).collect()}
    assert rows == {"1": (Decimal("0.75000"), at[0]), "2": (None, at[2])}
    assert tables.read_models(spark, path).count() == 2
