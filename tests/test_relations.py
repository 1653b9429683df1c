"""As-of and interval joins, sessions, buckets, variants, versions, time frames: edge cases and plans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattshelf.operators import history
from wattshelf.operators.joins import asof_join, interval_bins, interval_join
from wattshelf.operators.series_features import rolling_time, spread_over_time
from wattshelf.operators.versions import dataset_diff
from wattshelf.sources.json_records import variant_records
from wattshelf.sources.tables import last_ids, write_bucketed, write_scored_batch
from wattshelf.streaming import streams

START = datetime(2024, 1, 1)


def minutes(n):
    return START + timedelta(minutes=n)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows_per_block", [7, 1_000_000])
def test_asof_join_equals_brute_force(spark, rows_per_block):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", None]), minutes(rng.randint(0, 90)) if i % 9 else None) for i in range(60)]
    right = [(rng.choice(["a", "a", "a", "b", None]), minutes(rng.randint(0, 90)), j) for j in range(25)] + [("a", None, 99)]
    frames = spark.createDataFrame(left, "id int, k string, at timestamp"), spark.createDataFrame(right, "k string, since timestamp, label int")
    for tolerance in (None, 5 * 60_000_000):
        got = asof_join(*frames, ["k"], "at", "since", ["label", "since"], ["label"], tolerance, rows_per_block=rows_per_block)
        assert got.columns == ["id", "k", "at", "label", "since"]
        want = []
        for i, k, at in left:
            fit = [(s, j) for rk, s, j in right if k is not None and rk == k and s and at and s <= at]
            best = max(fit, default=None)
            if best and tolerance and (at - best[0]).total_seconds() * 1e6 > tolerance:
                best = None
            want.append((i, k, at, best and best[1], best and best[0]))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    empty = asof_join(frames[0], frames[1].limit(0), ["k"], "at", "since", ["label"])
    assert empty.count() == 60 and empty.filter("label IS NOT NULL").count() == 0
    assert asof_join(frames[0].limit(0), frames[1], ["k"], "at", "since", ["label"]).count() == 0


def test_interval_join_equals_brute_force_without_nested_loop(spark):
    rng = random.Random(2)
    points = [(i, rng.choice([None, float("nan"), *[rng.uniform(0, 100) for _ in range(20)], 50.0])) for i in range(200)]
    bounds = [(j, rng.choice([None, rng.uniform(0, 100)]), rng.choice([None, rng.uniform(0, 100)])) for j in range(40)] + [(40, 50.0, 50.0)]
    left = spark.createDataFrame(points, "id int, v double")
    right = spark.createDataFrame(bounds, "rule int, lo double, hi double")
    joined = interval_join(left, right, "v", "lo", "hi", bins=16)
    want = {
        (i, j) for i, x in points for j, lo, hi in bounds
        if x is not None and x == x and (lo is None or lo <= x) and (hi is None or x <= hi) and not (lo is not None and hi is not None and lo > hi)
    }
    got = [(r["id"], r["rule"]) for r in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)
    assert interval_join(left.limit(0), right, "v", "lo", "hi").count() == 0 == interval_join(left, right.limit(0), "v", "lo", "hi").count()


def test_a_point_is_held_against_few_intervals(spark):
    assert interval_bins(600_000, 20_000) == 1250 and interval_bins(10**12, 10**9) == 16_384 and interval_bins(5, 3) == 256
    points = spark.range(20_000).select(F.col("id").alias("p"), F.col("id").cast("double").alias("v"))
    rules = spark.range(20_000).select(F.col("id").alias("r"), F.col("id").cast("double").alias("lo"), F.col("id").cast("double").alias("hi"))
    joined = interval_join(points, rules, "v", "lo", "hi")
    assert joined.filter("p = r").count() == joined.count() == 20_000


@pytest.mark.parametrize("rows_per_block", [9, 1_000_000])
def test_time_frames_over_gaps_and_cut_blocks(spark, rows_per_block):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), minutes(rng.choice([0, 1, 2, 500]) + rng.randint(0, 60)), rng.choice([None, *range(9)])) for i in range(80)]
    rows.append((80, "a", None, 4))
    frame = spark.createDataFrame(rows, "id int, s string, at timestamp, x int")
    span = 10 * 60_000_000
    got = {r["id"]: r for r in rolling_time(frame, F.col("at"), "x", {"w": span}, ["s"], rows_per_block).collect()}
    assert len(got) == len(rows)
    for i, s, at, _ in rows:
        seen = [x for _, s2, t, x in rows if s2 == s and at and t and x is not None and timedelta(0) < at - t <= timedelta(minutes=10)]
        assert got[i]["w_rows"] == len(seen)
        assert got[i]["w_mean"] == (pytest.approx(sum(seen) / len(seen)) if seen else None)


def test_dense_rows_reach_one_later_block_at_most(spark):
    keyed = spark.range(4000).select((F.col("id") * 10.0).alias("_at"))
    spread = spread_over_time(keyed, 6000, 50)
    own = spread.filter("_copy = _block")
    assert own.count() == 4000 and own.agg(F.count_distinct("_block")).first()[0] > 2
    assert spread.agg(F.max(F.col("_copy") - F.col("_block"))).first()[0] == 1


def test_differences_of_versions(spark):
    schema = "a int, b string, c double"
    old = spark.createDataFrame([(1, "x", 1.0)] * 3 + [(2, None, None), (None, "y", None), (4, "z", 2.0)], schema)
    new = spark.createDataFrame([(1, "x", 1.0), (2, None, None), (2, None, None), (None, None, None), (4, "z", 2.0)], schema)
    got = sorted((tuple(r) for r in dataset_diff(old, new).collect()), key=repr)
    want = [("removed", 1, "x", 1.0)] * 2 + [("removed", None, "y", None), ("added", 2, None, None), ("added", None, None, None)]
    assert got == sorted(want, key=repr)
    assert dataset_diff(old, old).count() == 0 and dataset_diff(old.limit(0), new).count() == 5
    with pytest.raises(ValueError, match="columns"):
        dataset_diff(old, new.drop("c"))


def test_variants_of_any_shape(spark):
    payloads = [
        '{"k": 1}', '[{"k": 2}, {"k": "x"}, 5]', '{"data": {"k": 3, "n": {"id": 7}}}', '{"data": [{"n": {"id": 8}}]}', "[]", '{"k": ', "3", '"s"', None,
        '{"data": null, "k": 4}', "{}",
    ]
    frame = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    rows = variant_records(frame, "payload", {"k": ("$.k", "bigint"), "nested": ("$.n.id", "bigint")}, ["id"])
    got = sorted((r["id"], r["position"], r["shape"], r["k"], r["nested"]) for r in rows.collect() if r["id"] not in (9,))
    want = [
        (0, 0, "object", 1, None), (1, 0, "list", 2, None), (1, 1, "list", None, None), (1, 2, "list", None, None), (2, 0, "object", 3, 7), (3, 0, "list", None, 8),
        (10, 0, "object", None, None),
    ]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_bucketed_tables_join_without_exchange_and_prune(spark, tmp_path):
    left = spark.range(200).selectExpr("id % 40 AS product_id", "id AS prediction", "id % 4 AS month")
    right = spark.range(40).selectExpr("id AS product_id", "concat('p', id) AS name")
    write_bucketed(left, "bucketed_left", str(tmp_path / "left"), "product_id", 4, ("month",))
    write_bucketed(right, "bucketed_right", str(tmp_path / "right"), "product_id", 4)
    try:
        joined = spark.table("bucketed_left").hint("merge").join(spark.table("bucketed_right"), "product_id")
        assert "Exchange" not in plan_of(joined) and joined.count() == 200
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        one = spark.table("bucketed_left").filter("product_id = 7")
        assert "SelectedBucketsCount: 1 out of 4" in plan_of(one) and one.count() == 5
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.range(4).selectExpr("id AS month", "concat('m', id) AS label").write.parquet(str(tmp_path / "months"))
        chosen = spark.read.parquet(str(tmp_path / "months")).filter("label = 'm2'")
        pruned = spark.table("bucketed_left").join(F.broadcast(chosen), "month")
        pruned.collect()
        assert "dynamicpruning" in plan_of(pruned) and pruned.count() == 50
    finally:
        for name in ("bucketed_left", "bucketed_right"):
            spark.sql(f"DROP TABLE {name}")


def test_a_cube_tells_totals_from_missing_values(spark):
    frame = spark.createDataFrame([("a", None, 1.0), ("a", "x", 2.0), (None, "x", 4.0)], "p string, q string, confidence double")
    rows = {(r["p"], r["q"], r["grouping_id"]): (r["rows"], r["total"]) for r in history.history_cube(frame, ["p", "q"]).collect()}
    assert rows[(None, None, 3)] == (3, 7.0) and rows[("a", None, 0)] == (1, 1.0) and rows[("a", None, 1)] == (2, 3.0) and rows[(None, "x", 0)] == (1, 4.0)


def test_ids_of_a_batch_come_from_one_row_per_batch(spark, tmp_path):
    paths = str(tmp_path / "products"), str(tmp_path / "predictions")
    for batch_id, n in ((0, 3), (1, 2), (1, 2), (2, 4)):
        batch = spark.range(n).selectExpr(
            "id AS n", "concat('p', id) AS product_name", "'d' AS description", "'b' AS brand", "1.0D AS price", "'c' AS predicted_category",
            "'s' AS predicted_sub_category", "0.5D AS confidence",
        )
        write_scored_batch(batch, batch_id, F.col("n"), *paths)
    assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == list(range(1, 10))
    assert last_ids(spark, 2, *paths) == (5, 5) and last_ids(spark, 3, *paths) == (9, 9) and last_ids(spark, 0, *paths) == (0, 0)
    assert spark.read.parquet(paths[1]).columns[-1] == "batch_id" and spark.read.parquet(paths[1]).count() == 9


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    schema = "id int, at timestamp"
    base = str(tmp_path)
    for part in ([(1, minutes(0)), (2, minutes(300))], [(3, minutes(239)), (4, minutes(241)), (5, None)], [(6, minutes(100))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        rows = streams.file_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema)
        streams.run_available(streams.late_split_stream(rows, "at", "1 HOUR", f"{base}/ok", f"{base}/late", f"{base}/marks"), f"{base}/cp")
    assert sorted(r["id"] for r in spark.read.parquet(f"{base}/ok").collect()) == [1, 2, 4]
    assert sorted(r["id"] for r in spark.read.parquet(f"{base}/late").collect()) == [3, 5, 6]
    marks = spark.read.parquet(f"{base}/marks").agg(F.sum("accepted"), F.sum("late"), F.max("latest")).first()
    assert tuple(marks) == (3, 3, minutes(300))


def test_waiting_rows_are_not_written_again(spark, tmp_path):
    """A long series waits; a small later trigger updates few state rows however many wait."""
    base = str(tmp_path)
    many = spark.range(200_000).selectExpr("1L AS s", "timestamp_micros(1704067200000000 + id * 1000) AS at", "id AS row_key", "double(id) AS x")
    few = spark.range(3).selectExpr("1L AS s", "timestamp_micros(1704067200000000 + (200000 + id) * 1000) AS at", "200000 + id AS row_key", "double(id) AS x")
    updated, size = [], []
    for part in (many, few):
        part.write.mode("append").parquet(f"{base}/in")
        rows = streams.file_stream(spark, f"{base}/in", many.schema)
        lagged = streams.lag_stream(rows, "s", "at", "row_key", "x", "1 day", lags=(1, 2), means=(2,), stds=(), slot_us=60_000_000)
        query = streams.start_to_table(lagged, f"{base}/out", f"{base}/cp")
        for progress in query.recentProgress:
            for operator in progress["stateOperators"]:
                if progress["numInputRows"]:
                    updated.append(operator["numRowsUpdated"])
                    size.append(operator["numRowsTotal"])
    assert len(updated) == 2 and updated[1] <= 4 and updated[0] <= 20 and size[1] <= 30
    assert spark.read.parquet(f"{base}/out").count() == 0  # all wait for the watermark
    spark.sql("SELECT 1L AS s, timestamp_micros(1704067200000000 + 200000000000) AS at, -1L AS row_key, 0D AS x").write.mode("append").parquet(f"{base}/in")
    rows = streams.file_stream(spark, f"{base}/in", many.schema)
    lagged = streams.lag_stream(rows, "s", "at", "row_key", "x", "1 day", lags=(1, 2), means=(2,), stds=(), slot_us=60_000_000)
    streams.start_to_table(lagged, f"{base}/out", f"{base}/cp")
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == 200_003
    assert out.filter("row_key BETWEEN 2 AND 199999 AND (usage_lag_1 <> value - 1 OR usage_lag_2 <> value - 2)").count() == 0
