"""Metrics, gates, drift and history analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions.fixed_values import CLASSIFIER_ROSTER
from wattshelf.functions.money import format_percent
from wattshelf.functions.series import micros
from wattshelf.operators import drift, history, metrics
from wattshelf.plans import views as v
from wattshelf.plans.catalog.registry import query

ROSTER = ", ".join(f"({i}, '{name}')" for i, name in enumerate(CLASSIFIER_ROSTER))
SCORES = f"""{v.CLASS_RUNS},
confusion_v AS (SELECT model_name, ordinal, actual, predicted, count(*) AS c FROM class_pred_v GROUP BY ALL),
class_v AS (SELECT model_name, ordinal, label, sum(s) AS support, sum(p) AS claimed, sum(h) AS hits FROM (
  SELECT model_name, ordinal, actual AS label, c AS s, 0 AS p, CASE WHEN actual = predicted THEN c ELSE 0 END AS h FROM confusion_v
  UNION ALL SELECT model_name, ordinal, predicted, 0, c, 0 FROM confusion_v) GROUP BY ALL),
scores_v AS (SELECT model_name, ordinal, CAST(sum(support) AS BIGINT) AS row_count, round(sum(hits) / sum(support), 6) AS accuracy,
  round(sum(support * coalesce(hits / nullif(claimed, 0), 0)) / sum(support), 6) AS precision,
  round(sum(support * coalesce(hits / nullif(support, 0), 0)) / sum(support), 6) AS recall,
  round(sum(support * coalesce(2 * hits / nullif(support + claimed, 0), 0)) / sum(support), 6) AS f1_score
  FROM class_v GROUP BY model_name, ordinal)"""


def class_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.classification_metrics(
        v.class_predictions(spark, sf_dir), "actual", "predicted", groups=["model_name", "ordinal"]
    )
    names = ["accuracy", "precision", "recall", "f1_score"]
    return scores.withColumns({name: F.round(name, 6) for name in names})


@query("class_metrics", f"WITH {SCORES} SELECT * FROM scores_v")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_runs(spark, sf_dir)


@query(
    "best_classifier",
    f"WITH {SCORES} SELECT model_name, f1_score, accuracy FROM scores_v ORDER BY f1_score DESC, accuracy DESC, ordinal LIMIT 1",
)
def best_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = class_runs(spark, sf_dir).withColumn("status", F.lit("trained"))
    return metrics.best_classifier(runs).select("model_name", "f1_score", "accuracy")


@query(
    "comparison_roster",
    f"""WITH {SCORES}, roster AS (SELECT * FROM (VALUES {ROSTER}) AS r(position, model_name))
        SELECT r.position, r.model_name, accuracy, precision, recall, f1_score,
          CASE WHEN s.model_name IS NULL THEN 'not run' ELSE 'trained' END AS status
        FROM roster r LEFT JOIN scores_v s ON r.model_name = s.model_name
        UNION ALL SELECT 4, model_name, accuracy, precision, recall, f1_score, 'trained' FROM scores_v
        WHERE model_name NOT IN (SELECT model_name FROM roster)""",
)
def comparison_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.comparison_roster(class_runs(spark, sf_dir).withColumn("status", F.lit("trained")))


PRICES = f"""{v.REGRESSION_RUNS},
price_scores_v AS (SELECT model_name, ordinal, count(*) AS row_count, avg(abs(actual - predicted)) AS mae,
  sqrt(avg((actual - predicted) ** 2)) AS rmse, 1 - avg((actual - predicted) ** 2) / var_pop(actual) AS r2
  FROM price_pred_v GROUP BY model_name, ordinal)"""


def price_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression_metrics(
        v.price_predictions(spark, sf_dir), "actual", "predicted", ["model_name", "ordinal"]
    )


@query(
    "regression_metrics",
    f"WITH {PRICES} SELECT model_name, ordinal, row_count, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2 FROM price_scores_v",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_runs(spark, sf_dir).withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6)})


@query(
    "best_regressor",
    f"WITH {PRICES} SELECT model_name, round(rmse, 4) AS validation_rmse FROM price_scores_v ORDER BY rmse, ordinal LIMIT 1",
)
def best_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = price_runs(spark, sf_dir).withColumnRenamed("rmse", "validation_rmse").withColumn("status", F.lit("trained"))
    return metrics.best_regressor(runs).select("model_name", F.round("validation_rmse", 4).alias("validation_rmse"))


@query(
    "quality_gate",
    f"""WITH {PRICES} SELECT model_name, concat_ws('; ', CASE WHEN mae > 13000.0 THEN 'validation_mae is above 13000.0' END,
          CASE WHEN r2 < 0.6 THEN 'validation_r2 is below 0.6' END) AS failures, mae <= 13000.0 AND r2 >= 0.6 AS passed
        FROM price_scores_v""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = price_runs(spark, sf_dir).withColumnsRenamed({"mae": "validation_mae", "r2": "validation_r2"})
    gated = metrics.quality_gate(runs, max_mae=13000.0, min_r2=0.6)
    return gated.select("model_name", F.array_join("failures", "; ").alias("failures"), "passed")


@query(
    "prediction_checks",
    """WITH p AS (SELECT CASE WHEN event_type = 'error' AND value < 1 THEN NULL ELSE value - 0.5 END AS x FROM events)
       SELECT bool_and(x IS NOT NULL AND NOT isinf(x)) AS finite_predictions, bool_and(coalesce(x >= 0, false)) AS non_negative_predictions,
         count(x) AS prediction_count, round(min(x), 6) AS prediction_min, round(max(x), 6) AS prediction_max,
         bool_and(coalesce(x <= 600, false)) AS within_range FROM p""",
)
def prediction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    odd = (F.col("event_type") == "error") & (value < 1)
    rows = v.load(spark, sf_dir, "events").select(F.when(odd, float("nan")).otherwise(value - 0.5).alias("x"))
    checks = metrics.prediction_checks(rows, "x", upper=600)
    return checks.withColumns({n: F.round(n, 6) for n in ("prediction_min", "prediction_max")})


RUNS = """runs_v AS (SELECT l_returnflag AS model_name, CAST(year(l_shipdate) AS VARCHAR) AS model_version,
  l_returnflag || '-' || CAST(year(l_shipdate) AS VARCHAR) AS run_id, round(avg(l_discount), 4) AS f1_score,
  min(l_shipdate) AS created_at FROM lineitem GROUP BY ALL)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per return flag and ship year, its score the mean discount."""
    year = F.year("l_shipdate").cast("string")
    grouped = (
        v.load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("model_name"), year.alias("model_version"))
        .agg(F.round(F.avg("l_discount"), 4).alias("score"), F.min("l_shipdate").cast("timestamp").alias("created_at"))
    )
    return grouped.select(
        F.concat_ws("-", "model_name", "model_version").alias("run_id"),
        "model_name",
        "model_version",
        F.create_map(F.lit("f1_score"), F.col("score")).alias("metrics"),
        "created_at",
    )


@query(
    "runs_best",
    f"""WITH {RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY f1_score DESC, created_at) AS k FROM runs_v)
        SELECT model_name, run_id, model_version, f1_score FROM b WHERE k = 1""",
)
def runs_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_run(runs(spark, sf_dir))


@query(
    "runs_latest",
    f"""WITH {RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, run_id DESC) AS k FROM runs_v)
        SELECT model_name, run_id, model_version FROM b WHERE k = 1""",
)
def runs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_run(runs(spark, sf_dir))


@query("next_version", "SELECT max(o_orderkey) + 1 AS version FROM orders WHERE o_orderpriority = '1-URGENT'")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities stand for model names, order keys for their versions."""
    registered = v.load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model_name"), F.col("o_orderkey").alias("version")
    )
    return metrics.next_version(registered, "1-URGENT")


# --- Drift --------------------------------------------------------------------------------


def psi_sql(reference: str, current: str) -> str:
    """PSI tables for two relations of ("column", x)."""
    shares = ", ".join(str(i / 10) for i in range(11))
    return f"""q_v AS (SELECT "column", list_sort(list_distinct(quantile_cont(x, [{shares}]))) AS q, min(x) AS lo, max(x) AS hi
      FROM {reference} GROUP BY "column"),
    br_v AS (SELECT "column", CASE WHEN len(q) >= 3 THEN q ELSE list_append(
      list_transform(range(0, 10), lambda i: lo + i * ((hi + 1e-6 - lo) / 10)), hi + 1e-6) END AS br FROM q_v),
    frame_v AS (SELECT "column", br, unnest(range(0, len(br) - 1)) AS bin FROM br_v),
    e_v AS (SELECT "column", least(len(list_filter(br, lambda b: b <= x)), len(br) - 1) - 1 AS bin, count(*) AS c
      FROM {reference} JOIN br_v USING ("column") WHERE x BETWEEN br[1] AND br[-1] GROUP BY ALL),
    a_v AS (SELECT "column", least(len(list_filter(br, lambda b: b <= x)), len(br) - 1) - 1 AS bin, count(*) AS c
      FROM {current} JOIN br_v USING ("column") WHERE x BETWEEN br[1] AND br[-1] GROUP BY ALL),
    hist_v AS (SELECT f."column", f.bin, coalesce(e.c, 0) AS expected, coalesce(a.c, 0) AS actual FROM frame_v f
      LEFT JOIN e_v e ON e."column" = f."column" AND e.bin = f.bin LEFT JOIN a_v a ON a."column" = f."column" AND a.bin = f.bin),
    share_v AS (SELECT "column", greatest(expected / greatest(sum(expected) OVER (PARTITION BY "column"), 1), 1e-6) AS e,
      greatest(actual / greatest(sum(actual) OVER (PARTITION BY "column"), 1), 1e-6) AS a FROM hist_v),
    psi_v AS (SELECT "column", sum((a - e) * ln(a / e)) AS psi FROM share_v GROUP BY "column")"""


def long_sql(view: str, columns: tuple[str, ...] = v.DRIFT_COLUMNS) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x FROM {view}" for c in columns)


LONG = f"{v.DRIFT}, ref_long_v AS ({long_sql('drift_ref_v')}), cur_long_v AS ({long_sql('drift_cur_v')})"
PSI = f"{LONG}, {psi_sql('ref_long_v', 'cur_long_v')}"


@query("psi_quantile", f"WITH {PSI} SELECT \"column\", round(psi, 6) AS psi FROM psi_v")
def psi_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, current = v.drift_sides(spark, sf_dir)
    report = drift.drift_report(reference, current, v.DRIFT_COLUMNS)
    return report.select("column", F.round("psi", 6).alias("psi"))


@query("psi_histogram", f"WITH {PSI} SELECT \"column\", CAST(bin AS INTEGER) AS bin, expected, actual FROM hist_v")
def psi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, current = v.drift_sides(spark, sf_dir)
    bins = drift.reference_bins(reference, v.DRIFT_COLUMNS)
    sides = drift.histogram(reference, bins, "expected").join(
        drift.histogram(current, bins, "actual").drop("low", "high"), ["column", "bin"]
    )
    return sides.select("column", "bin", "expected", "actual")


FLAGS = f"""{v.DRIFT}, ref_flag_v AS (SELECT 'is_open' AS "column", CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM drift_ref_v),
cur_flag_v AS (SELECT 'is_open' AS "column", CASE WHEN l_discount > 0.02 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM drift_cur_v)"""


@query("psi_fallback", f"WITH {FLAGS}, {psi_sql('ref_flag_v', 'cur_flag_v')} SELECT \"column\", round(psi, 6) AS psi FROM psi_v")
def psi_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values only: fewer than three break points, so equal bins are used."""
    reference, current = v.drift_sides(spark, sf_dir)
    before = reference.select((F.col("l_linestatus") == "O").cast("double").alias("is_open"))
    after = current.select((F.col("l_discount") > 0.02).cast("double").alias("is_open"))
    return drift.drift_report(before, after, ["is_open"]).select("column", F.round("psi", 6).alias("psi"))


@query(
    "drift_report",
    f"WITH {PSI} SELECT \"column\", round(psi, 6) AS psi, psi >= 0.2 AS drifted, 0.2::DOUBLE AS threshold FROM psi_v",
)
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, current = v.drift_sides(spark, sf_dir)
    return drift.drift_report(reference, current, v.DRIFT_COLUMNS).withColumn("psi", F.round("psi", 6))


@query(
    "prediction_summary",
    f"""WITH {v.REGRESSION_RUNS} SELECT model_name, count(predicted) AS "count", round(avg(predicted), 4) AS mean,
          round(stddev_pop(predicted), 4) AS std, min(predicted) AS min, max(predicted) AS max FROM price_pred_v GROUP BY model_name""",
)
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drift.prediction_summary(v.price_predictions(spark, sf_dir), "predicted", ["model_name"])
    return rows.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "delayed_label_perf",
    """WITH p AS (SELECT event_id, value * 1.1 + 2 AS prediction FROM events),
         l AS (SELECT event_id, value AS actual FROM events WHERE event_type IN ('purchase', 'click'))
       SELECT count(*) AS row_count, round(avg(abs(actual - prediction)), 6) AS mae,
         round(sqrt(avg((actual - prediction) ** 2)), 6) AS rmse,
         round(1 - avg((actual - prediction) ** 2) / var_pop(actual), 6) AS r2 FROM p JOIN l USING (event_id)""",
)
def delayed_label_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.load(spark, sf_dir, "events")
    predictions = events.select("event_id", (F.col("value") * 1.1 + 2).alias("prediction"))
    labels = events.filter(F.col("event_type").isin("purchase", "click")).select("event_id", F.col("value").alias("actual"))
    row = drift.delayed_label_performance(predictions, labels, "event_id", "prediction", "actual")
    return row.withColumns({n: F.round(n, 6) for n in ("mae", "rmse", "r2")})


SUMMARY_COLUMNS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "feature_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(1 - count(x) / count(*), 6) AS missing_rate, round(avg(x), 4) AS mean,
            round(stddev_pop(x), 4) AS std FROM (SELECT CASE WHEN l_returnflag = 'N' AND '{c}' = 'l_tax' THEN NULL ELSE {c} END AS x FROM lineitem)"""
        for c in SUMMARY_COLUMNS
    ),
)
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = v.load(spark, sf_dir, "lineitem").withColumn(
        "l_tax", F.when(F.col("l_returnflag") == "N", float("nan")).otherwise(F.col("l_tax"))
    )
    rows = drift.feature_summary(items.select(*SUMMARY_COLUMNS, "l_returnflag"))
    return rows.withColumns(
        {"missing_rate": F.round("missing_rate", 6), "mean": F.round("mean", 4), "std": F.round("std", 4)}
    )


# --- History ------------------------------------------------------------------------------

P = f"WITH {v.PREDICTIONS}"


@query(
    "history_kpis",
    f"""{P} SELECT count(*) AS total_predictions, count(DISTINCT predicted_category) AS categories,
          count(DISTINCT predicted_sub_category) AS sub_categories FROM preds_v""",
)
def history_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_kpis(v.predictions(spark, sf_dir))


@query(
    "top_category",
    f"""{P} SELECT predicted_category AS top_category FROM preds_v WHERE predicted_category <> '' GROUP BY 1
        ORDER BY count(*) DESC, min("timestamp") LIMIT 1""",
)
def top_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.top_category(v.predictions(spark, sf_dir))


@query(
    "recent_predictions",
    f"""{P} SELECT prediction_id, product_id, predicted_category, epoch_us("timestamp") AS at_us FROM preds_v
        ORDER BY "timestamp" DESC, prediction_id DESC LIMIT 10""",
)
def recent_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.recent_predictions(v.predictions(spark, sf_dir))
    return rows.select("prediction_id", "product_id", "predicted_category", micros(F.col("timestamp")).alias("at_us"))


@query("category_counts", f"{P} SELECT predicted_category, count(*) AS rows FROM preds_v GROUP BY 1 ORDER BY 2 DESC, 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.value_counts(v.predictions(spark, sf_dir), "predicted_category")


@query(
    "subcategory_counts",
    f"""{P} SELECT predicted_sub_category, count(*) AS rows FROM preds_v WHERE predicted_sub_category IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def subcategory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.value_counts(v.predictions(spark, sf_dir), "predicted_sub_category")


ENRICHED = f"{P}, {v.CUSTOMER_PRODUCTS}"


@query(
    "brand_mix",
    f"""{ENRICHED} SELECT coalesce(nullif(brand, ''), 'Unknown') AS brand, count(*) AS rows FROM preds_v
        JOIN product_table_v ON product_id = id GROUP BY 1""",
)
def brand_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.enriched_predictions(v.predictions(spark, sf_dir), v.product_table(spark, sf_dir))
    return history.brand_mix(rows)


@query(
    "prediction_enriched",
    f"""{ENRICHED} SELECT prediction_id, product_id, predicted_category, confidence, product_name, description, brand, price
        FROM preds_v JOIN product_table_v ON product_id = id""",
)
def prediction_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.enriched_predictions(v.predictions(spark, sf_dir), v.product_table(spark, sf_dir))
    return rows.drop("timestamp", "predicted_sub_category")


@query("confidence_series", f'{P} SELECT epoch_us("timestamp") AS at_us, prediction_id, confidence FROM preds_v ORDER BY at_us, prediction_id')
def confidence_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.confidence_series(v.predictions(spark, sf_dir))
    return rows.select(micros(F.col("timestamp")).alias("at_us"), "prediction_id", "confidence")


@query("category_values", f"{P} SELECT DISTINCT predicted_category FROM preds_v ORDER BY 1")
def category_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.category_values(v.predictions(spark, sf_dir))


@query(
    "models_list",
    f"WITH {RUNS} SELECT run_id AS version, f1_score AS accuracy, strftime(created_at, '%Y-%m-%d') AS created_at FROM runs_v",
)
def models_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = runs(spark, sf_dir).select(
        F.col("run_id").alias("version"), F.col("metrics")["f1_score"].alias("accuracy"), "created_at"
    )
    return history.models_list(versions).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query(
    "format_percent",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'N/A' ELSE printf('%.1f%%', user_id / 1000.0 * 100) END AS share FROM events""",
)
def percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("event_type") != "error", F.col("user_id") / 1000.0)
    return v.load(spark, sf_dir, "events").select("event_id", format_percent(share).alias("share"))


@query(
    "windowed_category_counts",
    f"""{P} SELECT epoch_us(time_bucket(INTERVAL '15 minutes', "timestamp")) AS window_start, predicted_category,
          count(*) AS rows, round(avg(confidence), 10) AS mean_confidence FROM preds_v GROUP BY 1, 2""",
)
def windowed_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.windowed_category_counts(v.predictions(spark, sf_dir))
    return rows.select(
        micros(F.col("window_start")).alias("window_start"),
        "predicted_category",
        "rows",
        F.round("mean_confidence", 10).alias("mean_confidence"),
    )


WINDOWED_PSI = """ref_v AS (SELECT value AS x FROM events WHERE event_type = 'view'),
cur_v AS (SELECT time_bucket(INTERVAL '1 day', ts) AS w, value AS x FROM events WHERE event_type <> 'view'),
br_v AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS br FROM ref_v),
e_v AS (SELECT least(len(list_filter(br, lambda b: b <= x)), len(br) - 1) - 1 AS bin, count(*) AS c FROM ref_v, br_v
  WHERE x BETWEEN br[1] AND br[-1] GROUP BY ALL),
a_v AS (SELECT w, least(len(list_filter(br, lambda b: b <= x)), len(br) - 1) - 1 AS bin, count(*) AS c FROM cur_v, br_v
  WHERE x BETWEEN br[1] AND br[-1] GROUP BY ALL),
frame_v AS (SELECT w, bin FROM (SELECT DISTINCT w FROM a_v), (SELECT unnest(range(0, len(br) - 1)) AS bin FROM br_v)),
hist_v AS (SELECT f.w, f.bin, coalesce(e.c, 0) AS e, coalesce(a.c, 0) AS a FROM frame_v f LEFT JOIN e_v e ON e.bin = f.bin
  LEFT JOIN a_v a ON a.w = f.w AND a.bin = f.bin),
share_v AS (SELECT w, greatest(e / sum(e) OVER (PARTITION BY w), 1e-6) AS e, greatest(a / sum(a) OVER (PARTITION BY w), 1e-6) AS a FROM hist_v),
wpsi_v AS (SELECT epoch_us(w) AS window_start, 'value' AS "column", round(sum((a - e) * ln(a / e)), 6) AS psi FROM share_v GROUP BY w)"""


@query("windowed_psi", f"WITH {WINDOWED_PSI} SELECT * FROM wpsi_v")
def windowed_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as reference; the other events per day against their deciles."""
    events = v.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    reference, current = events.filter("event_type = 'view'"), events.filter("event_type <> 'view'")
    bins = drift.reference_bins(reference, ["value"])
    counts = drift.windowed_counts(current, "ts", bins, "1 day")
    psi = drift.windowed_psi(counts, drift.histogram(reference, bins, "expected"))
    return psi.select(micros(F.col("window_start")).alias("window_start"), "column", F.round("psi", 6).alias("psi"))
