"""Each stream must equal its batch twin on the same rows."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import DIRTY_PRODUCTS, PRODUCT_SCHEMA, class_frame
from wattshelf.operators import drift, history
from wattshelf.operators.product_quality import QualityRules, with_row_flags
from wattshelf.operators.series_features import history_features
from wattshelf.plans import classify
from wattshelf.plans.catalog.streams import table_stream
from wattshelf.streaming import streams

START = datetime(2024, 1, 1)
READINGS = "event_id long, series string, ts timestamp, value double"


def readings(n=120, minutes=10):
    return [(i, "ab"[i % 2], START + timedelta(minutes=minutes * i), float(i * 37 % 101)) for i in range(n)]


def batches(spark, tmp_path, rows, schema, order):
    """Files whose rows arrive in the given order, one file per micro-batch."""
    path = str(tmp_path / "source")
    for i, part in enumerate(order):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").parquet(path + f"/p{i:03d}")
    return path


def stream_of(spark, path, schema):
    return streams.file_stream(spark, path + "/*", spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_lags_equal_batch_with_disorder_and_late_rows(spark, tmp_path):
    rows = readings()
    order = [list(range(0, 40)), [41, 40, 43, 42] + list(range(44, 80)), list(range(119, 79, -1))]
    late = len(rows)
    rows.append((late, "a", START, -1.0))  # far behind the watermark when it arrives
    path = batches(spark, tmp_path, rows, READINGS, order + [[late]])
    stream = streams.lag_stream(
        stream_of(spark, path, READINGS), "series", "ts", "event_id", "value", "1 hour", lags=(1, 4), means=(4,), stds=(4,)
    )
    streams.start_to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    frame = spark.createDataFrame(rows[:-1], READINGS)
    batch = history_features(frame, F.col("ts"), "value", ["series"], [F.col("event_id")], (1, 4), (4,), (4,))
    passed = max(r[2] for r in rows) - timedelta(hours=1)
    names = ["usage_lag_1", "usage_lag_4", "usage_rolling_mean_4", "usage_rolling_std_4"]
    expected = batch.filter(F.col("ts") <= F.lit(passed)).select("event_id", *[F.round(n, 9).alias(n) for n in names])
    actual = got.select(F.col("row_key").alias("event_id"), *[F.round(n, 9).alias(n) for n in names])
    assert sorted(map(tuple, actual.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    assert actual.filter(F.col("event_id") == late).count() == 0


def test_quarantine_equals_batch_rules(spark, tmp_path):
    rules = QualityRules(row_id="id")
    path = batches(spark, tmp_path, DIRTY_PRODUCTS, PRODUCT_SCHEMA, [[0, 2], [1, 3]])
    extra = [(9, "Chair", "Oak chair", "Acme", "10", "Furniture")]
    spark.createDataFrame(extra, PRODUCT_SCHEMA).write.parquet(path + "/p900")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    writer = streams.quarantine_stream(stream_of(spark, path, PRODUCT_SCHEMA), rules, good, bad)
    streams.run_available(writer, str(tmp_path / "ck"))
    assert [r["id"] for r in spark.read.parquet(good).collect()] == [9]
    stored = spark.read.parquet(bad).drop("batch_id")
    batch = with_row_flags(spark.createDataFrame(DIRTY_PRODUCTS, PRODUCT_SCHEMA), rules)
    assert stored.exceptAll(batch).count() == 0 and stored.count() == 4


def test_scoring_equals_batch_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    chosen = classify.TrainingSettings(
        key="row_id", text_columns=("name",), category="main_category", min_df=1, max_df=1.0, test_share=0.25,
        logistic_iterations=20, forest_trees=None, boosted_rounds=None,
    )
    scorer = classify.train_and_select(class_frame(spark), chosen).scorer
    schema = "request_id long, text string, product_name string, description string, brand string, price double"
    rows = [(1, "running shoes", None, None, "B", 2.0), (2, None, "Phone", "android", None, None), (3, " ", None, "", None, None)]
    path = batches(spark, tmp_path, rows, schema, [[0], [1, 2]])
    where = {name: str(tmp_path / name) for name in ("products", "predictions", "rejected")}
    for checkpoint in ("ck1", "ck2"):  # the second run repeats both batches
        writer = streams.scoring_stream(
            stream_of(spark, path, schema), scorer, "request_id", where["products"], where["predictions"], where["rejected"]
        )
        streams.run_available(writer, str(tmp_path / checkpoint))
    stored = spark.read.parquet(where["products"]).drop("batch_id").orderBy("id").collect()
    assert [(r["id"], r["product_name"]) for r in stored] == [(1, "running shoes"), (2, "Phone")]
    made = spark.read.parquet(where["predictions"]).drop("batch_id").orderBy("prediction_id").collect()
    batch, _ = classify.score_products(scorer, spark.createDataFrame(rows, schema))
    expected = {r["request_id"]: r for r in batch.collect()}
    assert [r["predicted_category"] for r in made] == [expected[1]["predicted_category"], expected[2]["predicted_category"]]
    assert [float(r["confidence"]) for r in made] == pytest.approx([expected[i]["confidence"] for i in (1, 2)], abs=1e-5)
    assert [r["request_id"] for r in spark.read.parquet(where["rejected"]).collect()] == [3]


def test_window_counts_equal_closed_batch_windows(spark, tmp_path):
    rows = readings()
    path = batches(spark, tmp_path, rows, READINGS, [range(0, 60), range(60, 120)])
    named = lambda df: df.select(F.col("ts").alias("timestamp"), F.col("series").alias("predicted_category"), (F.col("value") / 101).alias("confidence"))
    stream = history.windowed_category_counts(named(stream_of(spark, path, READINGS)), watermark="1 hour")
    streams.start_to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    closed = max(r[2] for r in rows) - timedelta(hours=1)
    batch = history.windowed_category_counts(named(spark.createDataFrame(rows, READINGS))).filter(F.col("window_end") <= F.lit(closed))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() > 50


def test_windowed_drift_equals_batch(spark, tmp_path):
    rows = readings(400)
    frame = spark.createDataFrame(rows, READINGS)
    bins = drift.reference_bins(frame, ["value"])
    expected = drift.histogram(frame, bins, "expected")
    path = batches(spark, tmp_path, rows, READINGS, [range(0, 150), range(150, 400)])
    writer = streams.psi_stream(stream_of(spark, path, READINGS), "ts", bins, expected, "12 hours", "1 hour", str(tmp_path / "out"))
    streams.run_available(writer, str(tmp_path / "ck"))
    got = {(r["window_start"], r["column"]): round(r["psi"], 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = drift.windowed_psi(drift.windowed_counts(frame, "ts", bins, "12 hours"), expected)
    closed = max(r[2] for r in rows) - timedelta(hours=13)
    want = {(r["window_start"], r["column"]): round(r["psi"], 9) for r in batch.collect() if r["window_start"] <= closed}
    assert got == want and len(got) >= 4


def test_delayed_labels_and_unlabelled_predictions(spark, tmp_path):
    predictions = [(i, START + timedelta(minutes=i), float(i)) for i in range(200)]
    labels = [(i, START + timedelta(minutes=i + 30), float(i) + 1) for i in range(0, 200, 2)]
    p_schema, l_schema = "id long, predicted_at timestamp, prediction double", "id long, labelled_at timestamp, actual double"
    spark.createDataFrame(predictions, p_schema).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame(labels, l_schema).write.parquet(str(tmp_path / "l"))
    read = lambda name, schema: streams.file_stream(spark, str(tmp_path / name), spark.createDataFrame([], schema).schema)
    joined = streams.delayed_label_stream(
        read("p", p_schema), read("l", l_schema), "id", "predicted_at", "labelled_at", "40 MINUTES", "5 minutes"
    )
    streams.start_to_table(joined, str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out"))
    matched = out.filter("actual is not null")
    assert {r["id"] for r in matched.collect()} == set(range(0, 200, 2))
    unlabelled = {r["id"] for r in out.filter("actual is null").collect()}
    assert unlabelled and unlabelled <= set(range(1, 200, 2))
    assert streams.labelled_performance(out, "prediction", "actual").first()["mae"] == 1.0


def test_dedup(spark, tmp_path):
    rows = readings(20)
    path = batches(spark, tmp_path, rows, READINGS, [range(0, 12), range(8, 20)])
    kept = streams.dedup_stream(stream_of(spark, path, READINGS), ["series", "ts"], "ts", "1 hour")
    streams.start_to_table(kept, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


@pytest.mark.parametrize("files", [0, 3])
def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path, files):
    rows = readings(9)
    folder = tmp_path / "parts"
    spark.createDataFrame(rows, READINGS).repartition(files or 1).write.parquet(str(folder))
    if files:
        folder.rename(tmp_path / "events.parquet")
    else:
        next(folder.glob("*.parquet")).rename(tmp_path / "events.parquet")
    out = str(tmp_path / "out")
    streams.start_to_table(table_stream(spark, str(tmp_path), "events"), out, str(tmp_path / "ck"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == rows


class HeldInMemory:
    """State, map and timers of one series in memory; counts the writes to chunks."""

    def __init__(self):
        self.value, self.held, self.timers, self.writes = None, {}, set(), 0

    def getValueState(self, name, schema):
        return HeldInMemory()

    def getMapState(self, name, keys, schema):
        return HeldInMemory()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def keys(self):
        return iter(list(self.held))

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        del self.held[key]

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.value


def test_a_sparse_series_waits_in_few_chunks():
    hour, triggers = 3_600_000_000, 6
    rng = np.random.default_rng(5)
    at = np.sort(rng.choice(4000, 900, replace=False)) * hour // 2 + 7
    values = rng.random(900)
    trigger = rng.integers(0, triggers, 900)
    names = ["s", "at_us", "row_key", "value", "lag_1", "lag_3"]
    processor = streams.LagProcessor("s", names, 3, (1, 3), (), (), hour, 64)
    handle, mark = HeldInMemory(), HeldInMemory()
    processor.init(handle)
    out, late, passed = [], np.zeros(900, bool), -1
    for n in range(triggers + 1):
        now = (trigger == n) & (at > passed)
        late |= (trigger == n) & ~now
        if now.any():
            rows = pd.DataFrame({"at_us": at[now], "row_key": np.flatnonzero(now), "value": values[now]})
            assert list(processor.handleInputRows(("a",), iter([rows]), mark)) == []
        mark.value = int(at[-1]) // 1000 + 1 if n == triggers else int(at[150 * n]) // 1000 + 1
        passed = mark.value * 1000
        before = sum(map(len, out))
        while fired := sorted(t for t in handle.timers if t <= mark.value):
            handle.timers.discard(fired[0])
            out.extend(processor.handleExpiredTimer(("a",), mark, None))
        arrived = ~late & (trigger <= n) & (at <= passed)
        assert sum(map(len, out)) == arrived.sum() >= before  # nothing due is left waiting
    got = pd.concat(out)
    kept = np.flatnonzero(~late)
    assert got["row_key"].tolist() == kept.tolist()
    series = pd.Series(values[kept])
    for k in (1, 3):
        np.testing.assert_array_equal(got[f"lag_{k}"], series.shift(k))
    assert not processor.chunks.held and processor.chunks.writes < 80  # a chunk a slot is a write for almost every row
