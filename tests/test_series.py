from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from frames import METER_SCHEMA, meter_frame, meter_rows, usage_at
from wattshelf.functions.series import parse_timestamp
from wattshelf.operators import series_quality as q
from wattshelf.operators.ranks import with_ordinals, windowed_in_blocks
from wattshelf.operators.series_features import build_features, history_features

RULES = q.SeriesRules(
    allowed={"WeekStatus": ["Weekday", "Weekend"], "Load_Type": ["Light_Load", "Medium_Load", "Maximum_Load"]}
)


def test_valid_series_passes(spark):
    assert q.validate_series(meter_frame(spark), RULES) == []


def broken(spark, change, n=200):
    rows = meter_rows(n)
    change(rows)
    return q.validate_series(spark.createDataFrame(rows, METER_SCHEMA), RULES, raise_on_error=False)


def put(row, column, value):
    names = [part.strip().split()[0].strip("`") for part in METER_SCHEMA.split(",")]
    def change(rows):
        cells = list(rows[row])
        cells[names.index(column)] = value
        rows[row] = tuple(cells)
    return change


def test_each_rule_is_reported(spark):
    assert broken(spark, put(0, "Usage_kWh", -1.0)) == ["Usage_kWh cannot be negative"]
    assert "missing values" in broken(spark, put(3, "NSM", None))
    assert broken(spark, put(3, "Usage_kWh", float("inf"))) == ["column Usage_kWh contains infinite values"]
    nan = broken(spark, put(3, "Usage_kWh", float("nan")))
    assert nan == ["missing values", "column Usage_kWh must be numeric"]
    assert broken(spark, put(3, "date", "yesterday")) == ["invalid dates"]
    assert any("outside its domain" in e for e in broken(spark, put(3, "Load_Type", "Huge")))
    assert any("uninterrupted" in e for e in broken(spark, lambda rows: rows.pop(50)))
    repeated = broken(spark, lambda rows: rows.append(rows[10]))
    assert {"duplicate rows", "duplicate timestamps"} <= set(repeated)
    two_bad = broken(spark, lambda rows: (put(3, "date", "x")(rows), put(4, "date", "y")(rows)))
    assert {"invalid dates", "duplicate timestamps"} <= set(two_bad)


def test_all_foreign_values_are_counted(spark):
    rows = [list(r) for r in meter_rows(100)]
    for i in range(40):
        rows[i][-1] = f"Odd_{i:02d}"
    frame = spark.createDataFrame([tuple(r) for r in rows], METER_SCHEMA)
    allowed = {"Load_Type": ["Light_Load"], "WeekStatus": ["Weekday", "Weekend"]}
    assert q.domain_violations(frame, allowed).count() == 40
    row = q.domain_summary(frame, allowed).first()
    assert (row["column"], row["values"], row["sample"][:2], len(row["sample"])) == ("Load_Type", 40, ["Odd_00", "Odd_01"], 20)
    chosen = q.SeriesRules(allowed=allowed)
    assert any("first 20 of 40" in e for e in q.validate_series(frame, chosen, raise_on_error=False))


def test_errors_raise_by_default(spark):
    rows = meter_rows(100)
    put(0, "Usage_kWh", -1.0)(rows)
    with pytest.raises(q.SeriesQualityError, match="cannot be negative"):
        q.validate_series(spark.createDataFrame(rows, METER_SCHEMA), RULES)
    with pytest.raises(q.SeriesQualityError, match="missing required"):
        q.validate_series(spark.createDataFrame([(1,)], "x int"), RULES)


@pytest.mark.parametrize(
    "text, parsed",
    [
        ("01/02/2018 00:15", datetime(2018, 2, 1, 0, 15)),
        ("13/02/2018 00:15", datetime(2018, 2, 13, 0, 15)),
        ("2018-02-03 04:05:06", datetime(2018, 2, 3, 4, 5, 6)),
        ("2018-02-03", datetime(2018, 2, 3)),
        ("2018-02-03T04:05", datetime(2018, 2, 3, 4, 5)),
        ("1/2/2018 0:15", datetime(2018, 2, 1, 0, 15)),
        ("02/13/2018 00:15", datetime(2018, 2, 13, 0, 15)),
        ("3.2.2018", datetime(2018, 2, 3)),
        ("2018/02/01 00:15", datetime(2018, 2, 1, 0, 15)),
        ("1 Feb 2018", datetime(2018, 2, 1)),
        ("February 1, 2018 7:05", datetime(2018, 2, 1, 7, 5)),
        ("01/02/18 00:15", datetime(2018, 2, 1, 0, 15)),
        ("02/13/18 00:15", datetime(2018, 2, 13, 0, 15)),
        ("01/02/2018 1:15 PM", datetime(2018, 2, 1, 13, 15)),
        ("01/02/2018 12:15 am", datetime(2018, 2, 1, 0, 15)),
        ("20180201", datetime(2018, 2, 1)),
        ("01/02/2018T00:15", datetime(2018, 2, 1, 0, 15)),
        ("01/02/2018 25:15", None),
        ("01/02/2018 13:15 PM", None),
        ("20181301", None),
        ("31/02/2018 00:15", None),
        ("2018-02-31", None),
        ("32/01/2018 00:00", None),
        ("soon", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, parsed):
    frame = spark.createDataFrame([(text,)], "x string").select(parse_timestamp(F.col("x")).alias("t"))
    assert frame.select(F.date_format("t", "yyyy-MM-dd HH:mm:ss")).first()[0] == (parsed and str(parsed))


def test_frequency_equals_differences(spark):
    for drop, step, regular in ((None, 900, True), (7, 900, False), (None, 1800, False)):
        rows = meter_rows(60)
        if drop is not None:
            rows.pop(drop)
        frame = spark.createDataFrame(rows, METER_SCHEMA)
        check = q.frequency_check(frame, q.timestamp_of(frame, "date"), step_seconds=step).first()
        assert check["regular"] is regular


def test_gaps_name_both_ends(spark):
    rows = [r for i, r in enumerate(meter_rows(60)) if i not in (20, 21)]
    frame = spark.createDataFrame(rows, METER_SCHEMA)
    found = q.gaps(frame, q.timestamp_of(frame, "date"), rows_per_block=7).collect()
    assert [r["gap_seconds"] for r in found] == [2700.0]


def test_features_look_back_only(spark):
    rows = build_features(meter_frame(spark, 700), rows_per_block=700).orderBy("date").collect()
    assert len(rows) == 28
    first = rows[0]
    assert first["usage_lag_1"] == usage_at(671) and first["usage_lag_672"] == usage_at(0)
    assert first["usage_rolling_mean_4"] == np.mean([usage_at(i) for i in range(668, 672)])
    assert np.isclose(first["usage_rolling_std_96"], np.std([usage_at(i) for i in range(576, 672)], ddof=1))
    assert np.isclose(first["hour_sin"], np.sin(2 * np.pi * first["hour"] / 24))


def test_features_equal_pandas(spark):
    pdf = pd.DataFrame(meter_rows(1500))[[0, 1]].set_axis(["date", "Usage_kWh"], axis=1)
    pdf["Usage_kWh"] += np.random.default_rng(7).normal(size=len(pdf))
    frame = spark.createDataFrame(pdf)
    got = build_features(frame, dropna=False, rows_per_block=300).orderBy("date").toPandas()
    shifted = pdf["Usage_kWh"].shift(1)
    for name, expected in {
        "usage_lag_96": pdf["Usage_kWh"].shift(96),
        "usage_rolling_mean_4": shifted.rolling(4, min_periods=4).mean(),
        "usage_rolling_mean_96": shifted.rolling(96, min_periods=96).mean(),
        "usage_rolling_std_96": shifted.rolling(96, min_periods=96).std(),
    }.items():
        np.testing.assert_allclose(got[name].astype(float), expected, rtol=1e-9, atol=1e-9)


def test_invalid_date_stops_features(spark):
    rows = meter_rows(10)
    put(3, "date", "soon")(rows)
    with pytest.raises(ValueError, match="invalid dates"):
        build_features(spark.createDataFrame(rows, METER_SCHEMA))


def skewed(spark):
    """One series holds a third of the rows, and most of those in one short period."""
    return spark.range(6000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("series"),
        F.when(F.col("id") % 3 == 0, F.lit(1_000_000) + F.col("id")).otherwise((F.col("id") * 7919) % 10_000_000).alias("t"),
        (F.col("id") * 31 % 97).cast("double").alias("y"),
    )


def test_blocks_equal_one_window_per_series_under_skew(spark):
    frame = skewed(spark)
    blocked = windowed_in_blocks(
        frame, F.col("t"), 96, lambda w: {"l": F.lag("y", 96).over(w), "s": F.sum("y").over(w.rowsBetween(-96, -1))},
        [F.col("id")], ["series"], 150,
    )
    w = Window.partitionBy("series").orderBy("t", "id")
    whole = frame.withColumns({"l": F.lag("y", 96).over(w), "s": F.sum("y").over(w.rowsBetween(-96, -1))})
    assert blocked.count() == 6000
    assert blocked.exceptAll(whole).count() == 0 and whole.exceptAll(blocked).count() == 0


def test_ordinals_are_dense_and_null_series_count_as_one(spark):
    frame = skewed(spark).withColumn("series", F.when(F.col("series") > 0, F.col("series")))
    numbered = with_ordinals(frame, F.col("t"), [F.col("id")], ["series"], "n", 200)
    checks = numbered.groupBy("series").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.min("n").alias("lo"), F.count_distinct("n").alias("d"))
    assert all(r["c"] == r["m"] == r["d"] and r["lo"] == 1 for r in checks.collect())


def test_no_unpartitioned_window_over_rows(spark):
    frame = meter_frame(spark, 700).withColumn("date", F.col("date").cast("timestamp"))
    plan = history_features(frame, F.col("date"), "Usage_kWh", rows_per_block=100)._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(single) <= 1  # only the per-block row counts are gathered
