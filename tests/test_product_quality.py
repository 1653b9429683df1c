import pytest
from pyspark.sql import functions as F

from frames import DIRTY_PRODUCTS, PRODUCT_SCHEMA
from wattshelf.operators import product_quality as q

RULES = q.QualityRules(row_id="id")


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(DIRTY_PRODUCTS, PRODUCT_SCHEMA)


def test_report_of_a_dirty_table(dirty):
    row = q.quality_report(dirty, RULES, "memory").first()
    assert row["is_valid"] is False
    assert row["row_count"] == 4 and row["column_count"] == 5
    assert row["duplicate_row_count"] == 1 and row["duplicate_rows"] == [0, 1]
    assert row["null_category_count"] == 1 and row["null_category_rows"] == [3]
    assert row["invalid_category_count"] == 2 and row["invalid_category_rows"] == [2, 3]
    assert row["invalid_category_values"] == ["unknown"]
    assert row["empty_description_count"] == 2 and row["empty_description_rows"] == [0, 1]
    assert row["missing_values"]["brand"] == 1
    assert "price" in row["incorrect_data_types"]
    assert len(row["errors"]) == 4 and len(row["warnings"]) == 1


def test_counts_take_one_scan(dirty):
    plan = q.count_checks(dirty, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_aliases_give_no_type_issue(spark):
    frame = spark.createDataFrame(
        [(1, "Running Shoes", "Contoso", "₹1,999", "Shoes")],
        "id long, name string, manufacturer string, discount_price string, main_category string",
    )
    row = q.quality_report(frame, RULES).first()
    assert row["column_roles"]["description"] == "name"
    assert row["incorrect_data_types"] == {} and row["is_valid"]
    assert len(row["warnings"]) == 6


def test_whitelist_ignores_case_and_space(spark):
    frame = spark.createDataFrame(
        [(1, "Laptop", "Business laptop", "Acme", 1200.0, " electronics ")],
        "id long, product_name string, description string, brand string, price double, category string",
    )
    rules = q.QualityRules(row_id="id", allowed_categories=("Electronics",))
    row = q.quality_report(frame, rules).first()
    assert row["is_valid"] and row["warnings"] == []
    other = q.QualityRules(row_id="id", allowed_categories=("Shoes",))
    assert q.quality_report(frame, other).first()["invalid_category_count"] == 1


def test_unresolved_columns_count_every_row(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "id long, product_name string")
    row = q.quality_report(frame, RULES).first()
    assert row["missing_required_columns"] == ["description", "brand", "price", "category"]
    assert row["missing_values"]["brand"] == 2
    assert row["null_category_count"] == 2 and row["invalid_category_count"] == 2
    assert row["invalid_category_values"] == [] and not row["is_valid"]


def test_wrong_types(spark):
    frame = spark.createDataFrame([(1, 5, "d", "b", 1.0, "c")], "id long, product_name int, description string, brand string, price double, category string")
    row = q.quality_report(frame, RULES).first()
    assert set(row["incorrect_data_types"]) == {"product_name"} and not row["is_valid"]


@pytest.mark.parametrize(
    "value, invalid",
    [("Shoes", False), (" N/A ", True), ("12345", True), ("x" * 121, True), ("x" * 120, False), ("None", True), ("-", True), (None, True), ("5a", False), ("  ", True)],
)
def test_category_rules(spark, value, invalid):
    frame = spark.createDataFrame([(value,)], "c string")
    assert frame.select(q.invalid_category(F.col("c"), RULES).alias("i")).first()["i"] is invalid


def test_samples_are_capped_but_counts_are_not(spark):
    frame = spark.range(1000).select(
        "id", *[F.lit("x").alias(n) for n in ("product_name", "description", "brand")], F.lit("1").alias("price"), F.lit("unknown").alias("category")
    )
    row = q.quality_report(frame, RULES).first()
    assert row["invalid_category_count"] == 1000 and row["invalid_category_rows"] == list(range(20))
    assert row["duplicate_row_count"] == 999 and row["duplicate_rows"] == list(range(20))
