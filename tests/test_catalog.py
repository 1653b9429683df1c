"""Every query with check SQL gives the rows that DuckDB gives, on the smallest data set."""

import os
from decimal import Decimal

import pytest

from wattshelf.plans.catalog import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, (int, float, Decimal)) else str(value)


#: Fits without a closed form: their predictions are checked by metrics below, their estimators in test_models.
WITHOUT_SQL = {"clf_logreg", "clf_rf", "clf_gbt", "model_comparison", "reg_rf", "reg_gbt", "regressor_comparison"}


def test_every_other_query_has_sql():
    assert set(QUERIES) == set(CHECKS) | WITHOUT_SQL and not set(CHECKS) & WITHOUT_SQL


@pytest.fixture(scope="module")
def compared(spark):
    from wattshelf.plans import classify, views
    from wattshelf.plans.catalog.models import SETTINGS

    frames = classify.training_frames(views.labelled(spark, SF_DIR), SETTINGS)
    return frames, classify.fit_candidates(frames, SETTINGS)[0]


def test_reported_metrics_equal_sql_over_stored_predictions(spark, connection, compared):
    """Every classifier of the comparison: accuracy and weighted rates recomputed by DuckDB from (key, label, prediction)."""
    frames, rows = compared
    held_out = {(r["doc_id"], r["label"]) for r in frames.test.collect()}
    trained = [row for row in rows if row["status"] == "trained"]
    assert [row["model_name"] for row in trained] == ["Logistic Regression", "Naive Bayes", "Random Forest", "Gradient Boosted Trees"]
    for row in trained:
        predictions = row["predictions"].toPandas()
        assert {(d, x) for d, x in zip(predictions["doc_id"], predictions["label"])} == held_out and len(predictions) == len(held_out)
        assert predictions["confidence"].between(1 / len(frames.indexer.labels), 1 + 1e-9).all()
        connection.register("predictions", predictions)
        got = connection.execute(
            """WITH l AS (SELECT label FROM predictions UNION SELECT predicted_label FROM predictions),
            c AS (SELECT l.label, sum((p.label = l.label)::INT) AS n, sum((p.label = l.label AND predicted_label = l.label)::INT) AS hit,
                         sum((predicted_label = l.label)::INT) AS said FROM l, predictions p GROUP BY l.label),
            r AS (SELECT n, hit, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN n > 0 THEN hit / n ELSE 0 END AS r FROM c)
            SELECT sum(hit) / sum(n), sum(n * p) / sum(n), sum(n * r) / sum(n), sum(n * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(n) FROM r"""
        ).fetchall()[0]
        assert got == pytest.approx([row[m] for m in ("accuracy", "precision", "recall", "f1_score")], abs=1e-9)


def test_boosted_trees_take_part_in_the_comparison(compared):
    """They beat the largest class on held-out rows."""
    frames, rows = compared
    boosted = next(row for row in rows if row["model_name"] == "Gradient Boosted Trees")
    shares = frames.test.groupBy("label").count().toPandas()["count"]
    assert boosted["accuracy"] > shares.max() / shares.sum()


@pytest.mark.parametrize("name, worst", [("reg_rf", 1.5), ("reg_gbt", 3.0)])
def test_regressors_predict_every_held_out_reading(spark, connection, name, worst):
    """Each validation and test reading once, with its own value; the readings are noise, so errors are only bounded."""
    found = QUERIES[name](spark, SF_DIR).toPandas()
    connection.register("found", found)
    rows, same, mae, of_mean = connection.execute(
        """SELECT count(*), count(*) FILTER (f."Usage_kWh" = e.value), avg(abs(f.prediction - e.value)), avg(abs((SELECT avg(value) FROM events) - e.value))
        FROM found f JOIN events e USING (event_id)"""
    ).fetchall()[0]
    total = connection.execute("SELECT count(*) - 672 FROM events").fetchall()[0][0]
    assert rows == same == len(found) == total - int(total * 0.7)
    assert mae < worst * of_mean


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, connection, name):
    frame = QUERIES[name](spark, SF_DIR)
    cursor = connection.execute(CHECKS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = [tuple(map(plain, row)) for row in cursor.fetchall()]
    actual = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    assert sorted(actual, key=repr) == sorted(expected, key=repr)
