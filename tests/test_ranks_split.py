import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattshelf.operators import split
from wattshelf.operators.projection import drop_incomplete, history_by_category, keep_labelled, lookup, sample_rows
from wattshelf.operators.ranks import bins_for, dense_index, exact_quantiles, values_at_ranks


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=4000), rng.integers(0, 5, 3000).astype(float), np.ones(50), np.array([1.0, 2, 3, 10]), np.r_[np.zeros(2000), rng.normal(size=1000)]):
        frame = spark.createDataFrame([(float(v),) for v in values], "x double")
        shares = [i / 10 for i in range(11)]
        got, _ = exact_quantiles(frame, ["x"], shares)
        np.testing.assert_allclose(got["x"], np.quantile(values, shares), rtol=1e-12, atol=1e-12)


def test_ranks_skip_missing_and_infinite(spark):
    frame = spark.createDataFrame([(x,) for x in (3.0, None, float("nan"), float("inf"), 1.0, 2.0)], "x double")
    assert values_at_ranks(frame, {"x": [0, 1, 2, 3]})["x"] == [1.0, 2.0, 3.0, None]


def test_sample_has_exact_size_and_is_stable(spark):
    frame = spark.range(5000)
    first = {r["id"] for r in sample_rows(frame, 700, "id").collect()}
    assert len(first) == 700
    assert first == {r["id"] for r in sample_rows(frame.repartition(13), 700, "id").collect()}
    assert first != {r["id"] for r in sample_rows(frame, 700, "id", seed=1).collect()}
    assert sample_rows(frame, 9000, "id").count() == 5000


def test_dense_index_follows_order(spark):
    frame = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("k"))
    rows = dense_index(frame, [F.col("k")], "i").orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(3000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers(1, 500), min_size=1, max_size=8), st.floats(0.05, 0.95))
def test_quotas_add_up(counts, share):
    total = sum(counts.values())
    test_rows = math.ceil(total * share)
    quotas = split.test_quotas(counts, test_rows)
    assert sum(quotas.values()) == test_rows
    assert all(0 <= quotas[label] <= counts[label] for label in counts)


def test_bucket_and_bin_numbers_follow_the_rows():
    assert split.hash_buckets(10) == 4096 and split.hash_buckets(10**12) == 1 << 20
    assert 10**9 / split.hash_buckets(10**9) <= split.ROWS_PER_BUCKET
    assert (bins_for(1000), bins_for(10**9), bins_for(10**12)) == (256, 2000, 16384)


def labelled(spark, sizes):
    rows = [(i * 1000 + j, label) for i, (label, n) in enumerate(sizes.items()) for j in range(n)]
    return spark.createDataFrame(rows, "id long, label string")


def test_stratified_sizes(spark):
    sizes = {"big": 900, "mid": 75, "rare": 10}
    rows = split.train_test_split(labelled(spark, sizes), "id", "label", 0.2)
    counts = {(r["label"], r["split"]): r["count"] for r in rows.groupBy("label", "split").count().collect()}
    assert sum(n for (_, part), n in counts.items() if part == "test") == math.ceil(985 * 0.2)
    assert counts["big", "test"] == 180 and counts["mid", "test"] == 15 and counts["rare", "test"] == 2
    assert "_label" not in rows.columns


def test_split_without_strata(spark):
    rows = split.train_test_split(labelled(spark, {"a": 7, "b": 1}), "id", "label", 0.25)
    assert rows.filter("split = 'test'").count() == 2 and rows.count() == 8
    assert rows.columns == ["id", "label", "split"]


def test_can_stratify(spark):
    assert split.can_stratify(labelled(spark, {"a": 6, "b": 2}), "label", 0.25).first()["stratify"]
    assert not split.can_stratify(labelled(spark, {"a": 6, "b": 1}), "label", 0.25).first()["stratify"]
    assert not split.can_stratify(labelled(spark, {"a": 6, "b": 2}), "label", 0.1).first()["stratify"]


def test_class_weights(spark):
    weights = {r["label"]: r["weight"] for r in split.class_weights(labelled(spark, {"a": 6, "b": 2}), "label").collect()}
    assert weights == {"a": 8 / 12, "b": 2.0}


def test_chronological_split_cuts_inside_ties(spark):
    frame = spark.range(1000).select("id", F.timestamp_seconds(F.floor(F.col("id") / 400)).alias("ts"))
    rows = split.chronological_split(frame, F.col("ts"), "id")
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert counts == {"train": 700, "validation": 150, "test": 150}
    bounds = rows.groupBy("split").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    at = {r["split"]: (r["lo"], r["hi"]) for r in bounds}
    assert at["train"][1] <= at["validation"][0] and at["validation"][1] <= at["test"][0]
    with pytest.raises(ValueError):
        split.chronological_split(frame.limit(1), F.col("ts"), "id")


def test_fingerprint(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    one = split.dataset_fingerprint(frame).first()
    assert one == split.dataset_fingerprint(frame.repartition(3)).first()
    other = spark.createDataFrame([(1, "b"), (1, "b"), (2, None)], "x int, y string")
    assert one["fingerprint"] != split.dataset_fingerprint(other).first()["fingerprint"]
    # Equal pairs do not cancel out.
    assert split.dataset_fingerprint(frame.filter("x = 1")).first() != split.dataset_fingerprint(other.filter("x = 1")).first()


def test_filters(spark):
    frame = spark.createDataFrame([(1, " a "), (2, ""), (3, None), (4, "b")], "id int, c string")
    assert [tuple(r) for r in keep_labelled(frame, ["c"]).collect()] == [(1, "a"), (4, "b")]
    assert lookup(frame, "id", 4).count() == 1
    assert history_by_category(frame, "All", "c").count() == 4
    assert history_by_category(frame, "b", "c").count() == 1
    assert drop_incomplete(frame).count() == 3
