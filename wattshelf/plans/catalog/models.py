"""Estimators, preprocessing, comparison and batch scoring."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted
from wattshelf.functions.fixed_values import (
    LABEL_SEPARATOR,
    MODEL_CATEGORICAL,
    MODEL_NUMERIC,
    SERIES_NUMERIC,
)
from wattshelf.functions.series import calendar_columns
from wattshelf.operators import tfidf
from wattshelf.operators.series_features import history_features
from wattshelf.operators.split import chronological_split
from wattshelf.plans import classify, forecast
from wattshelf.plans import views as v
from wattshelf.plans.catalog.registry import query
from wattshelf.session import materialise, scratch_path


@query("label_index", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_index FROM (SELECT DISTINCT lang AS label FROM documents)")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = v.load(spark, sf_dir, "documents").select(F.col("lang").alias("label"))
    model = StringIndexer(
        inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(labels)
    return model.transform(labels.distinct())


# --- Classifiers --------------------------------------------------------------------------

#: Default features, iterations, trees and rounds on all labelled rows.
SETTINGS = classify.TrainingSettings(key="doc_id", text_columns=("description",))
NAMES = {
    "clf_logreg": classify.LOGISTIC,
    "clf_nb": classify.BAYES,
    "clf_rf": classify.FOREST,
    "clf_gbt": classify.BOOSTED,
}

#: Labelled documents, their split, the vocabulary of the train part, and naive Bayes on its TF-IDF rows: ``theta_v``
#: holds the log-probability of every (label, term) that occurs, ``class_v`` prior and log-probability of the others.
BAYES_MODEL = f"""labelled_v AS MATERIALIZED (
  SELECT d.doc_id, d.lang || '{LABEL_SEPARATOR}' || CAST(l.toxic AS VARCHAR) AS label, {v.sql_clean('d.text')} AS corpus
  FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IS NOT NULL AND l.toxic IS NOT NULL),
count_v AS (SELECT label, count(*) AS n FROM labelled_v GROUP BY label),
size_v AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS want, count(*) AS k, min(n) AS least FROM count_v),
rest_v AS (SELECT label, (n * want) // total AS base, row_number() OVER (ORDER BY (n * want) % total DESC, label) AS place FROM count_v, size_v),
quota_v AS (SELECT label, base + CASE WHEN place <= want - (SELECT sum(base) FROM rest_v) THEN 1 ELSE 0 END AS quota FROM rest_v, size_v),
place_v AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY h) AS inside, row_number() OVER (ORDER BY h) AS overall
  FROM (SELECT *, substr(md5(CAST(doc_id AS VARCHAR) || '#42'), 1, 13) AS h FROM labelled_v)),
split_v AS MATERIALIZED (
  SELECT doc_id, label, CASE WHEN least >= 2 AND want >= k AND total - want >= k THEN inside <= quota ELSE overall <= want END AS is_test
  FROM place_v JOIN quota_v USING (label), size_v),
token_v AS (SELECT doc_id, {v.sql_tokens('corpus')} AS t FROM labelled_v),
counted_v AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM token_v) GROUP BY ALL),
train_v AS (SELECT count(*) AS n FROM split_v WHERE NOT is_test),
known_v AS MATERIALIZED (
  SELECT term, ln((1.0 + (SELECT n FROM train_v)) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS cf FROM counted_v JOIN split_v USING (doc_id) WHERE NOT is_test GROUP BY term
    HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM train_v) ORDER BY cf DESC, term LIMIT 50000)),
weighed_v AS MATERIALIZED (
  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM (SELECT doc_id, term, tf * idf AS w FROM counted_v JOIN known_v USING (term))),
sum_v AS MATERIALIZED (SELECT label, term, sum(w) AS s FROM weighed_v JOIN split_v USING (doc_id) WHERE NOT is_test GROUP BY ALL),
class_v AS MATERIALIZED (
  SELECT label, ln(n / (SELECT n FROM train_v)) AS prior, coalesce(cs, 0) + (SELECT count(*) FROM known_v) AS mass
  FROM (SELECT label, count(*) AS n FROM split_v WHERE NOT is_test GROUP BY label) LEFT JOIN (SELECT label, sum(s) AS cs FROM sum_v GROUP BY label) USING (label)),
theta_v AS MATERIALIZED (SELECT label, term, ln((s + 1.0) / mass) - ln(1.0 / mass) AS above FROM sum_v JOIN class_v USING (label))"""


def bayes_scores(cells: str, keys: str) -> str:
    """SQL for (keys, label, confidence) by the model above, from ``cells`` (keys, term, w) and ``asked_v`` (keys)."""
    return f"""base_v AS (SELECT {keys}, sum(w) AS total FROM {cells} GROUP BY ALL),
above_v AS (SELECT {keys}, label, sum(w * above) AS above FROM {cells} JOIN theta_v USING (term) GROUP BY ALL),
score_v AS (
  SELECT {keys}, label, prior + coalesce(total, 0) * ln(1.0 / mass) + coalesce(above, 0) AS score
  FROM asked_v CROSS JOIN class_v LEFT JOIN base_v USING ({keys}) LEFT JOIN above_v USING ({keys}, label)),
best_v AS (SELECT {keys}, arg_max(label, score) AS predicted_label, max(score) AS top FROM score_v GROUP BY ALL),
scored_v AS (SELECT {keys}, predicted_label, 1.0 / sum(exp(score - top)) AS confidence FROM score_v JOIN best_v USING ({keys}) GROUP BY ALL)"""


TESTED_ROWS = f"""WITH {BAYES_MODEL}, asked_v AS (SELECT doc_id FROM split_v WHERE is_test),
{bayes_scores('(SELECT w.* FROM weighed_v w JOIN asked_v USING (doc_id))', 'doc_id')}"""

#: A request is text and role joined by a space, as far as they are not blank.
REQUESTS = f"""request_v AS (
  SELECT conv_id, turn, {v.sql_tokens(v.sql_clean("trim(concat_ws(' ', nullif(" + v.sql_strip('text') + ", ''), nullif(" + v.sql_strip('role') + ", '')))"))} AS t
  FROM conversations),
asked_v AS (SELECT conv_id, turn FROM request_v),
request_tf_v AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(list_concat(t,
  list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM request_v) GROUP BY ALL),
request_w_v AS MATERIALIZED (SELECT conv_id, turn, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS w
  FROM (SELECT conv_id, turn, term, tf * idf AS w FROM request_tf_v JOIN known_v USING (term)))"""
SCORED_REQUESTS = f"WITH {BAYES_MODEL}, {REQUESTS}, {bayes_scores('request_w_v', 'conv_id, turn')}"
PREDICTED = f"""split_part(predicted_label, '{LABEL_SEPARATOR}', 1) AS predicted_category,
  split_part(predicted_label, '{LABEL_SEPARATOR}', 2) AS predicted_sub_category, round(confidence, {{digits}}) AS confidence"""


def _fit_one(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = classify.training_frames(v.labelled(spark, sf_dir), SETTINGS)
        roster = classify.candidates(SETTINGS, float(frames.counts["train"]))
        chosen = [candidate for candidate in roster if candidate.name == name]
        rows, _ = classify.fit_candidates(frames, SETTINGS, chosen)
        return rows[0]["predictions"].withColumn("confidence", F.round("confidence", 6))

    return run


for _key, _name in NAMES.items():
    # Only naive Bayes has a closed form; the tests recompute the others' metrics from their predictions.
    _sql = f"{TESTED_ROWS} SELECT doc_id, label, predicted_label, round(confidence, 6) AS confidence FROM scored_v JOIN split_v USING (doc_id)"
    query(_key, _sql if _name == classify.BAYES else None)(_fit_one(_name))


@query("model_comparison")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roster and boosted trees on all labelled rows, the best one marked."""
    return classify.train_and_select(v.labelled(spark, sf_dir), SETTINGS).runs


@query(
    "comparison_bayes",
    f"""{TESTED_ROWS}, pair_v AS (SELECT label, predicted_label AS p FROM scored_v JOIN split_v USING (doc_id)),
    label_v AS (SELECT label FROM pair_v UNION SELECT p FROM pair_v),
    per_v AS (
      SELECT l.label, count(*) FILTER (x.label = l.label) AS support, count(*) FILTER (x.label = l.label AND p = l.label) AS hits,
             count(*) FILTER (p = l.label) AS said FROM label_v l CROSS JOIN pair_v x GROUP BY l.label),
    rate_v AS (SELECT *, CASE WHEN said > 0 THEN hits / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rc FROM per_v)
    SELECT '{classify.BAYES}' AS model_name, 'trained' AS status, round(sum(hits) / sum(support), 6) AS accuracy, round(sum(support * pr) / sum(support), 6) AS precision,
           round(sum(support * rc) / sum(support), 6) AS recall,
           round(sum(support * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) / sum(support), 6) AS f1_score FROM rate_v""",
)
def comparison_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the comparison that SQL can compute: naive Bayes and its metrics."""
    frames = classify.training_frames(v.labelled(spark, sf_dir), SETTINGS)
    roster = [c for c in classify.candidates(SETTINGS, float(frames.counts["train"])) if c.name == classify.BAYES]
    runs = classify.run_frame(spark, classify.fit_candidates(frames, SETTINGS, roster)[0])
    return runs.select("model_name", "status", *[F.round(n, 6).alias(n) for n in ("accuracy", "precision", "recall", "f1_score")])


@query("score_products", f"{SCORED_REQUESTS} SELECT conv_id, turn, {PREDICTED.format(digits=6)} FROM scored_v")
def score_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model trained on labelled documents, applied to every conversation turn."""
    scored, _ = classify.score_products(trained_scorer(spark, sf_dir), requests(spark, sf_dir))
    return scored.select("conv_id", "turn", "predicted_category", "predicted_sub_category", F.round("confidence", 6).alias("confidence"))


@query("scorer_reload", "SELECT conv_id, turn, true AS same FROM conversations")
def scorer_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved and reloaded scorer gives each request the category and confidence of the one in memory."""
    scorer, path = trained_scorer(spark, sf_dir), scratch_path(spark, "scorer")
    scorer.save(path)
    asked = requests(spark, sf_dir)
    first, again = (
        classify.score_products(s, asked)[0].select("conv_id", "turn", F.struct("predicted_category", "confidence").alias(name))
        for s, name in ((scorer, "first"), (classify.ProductScorer.load(path), "again"))
    )
    return first.join(again, ["conv_id", "turn"]).select("conv_id", "turn", F.col("first").eqNullSafe(F.col("again")).alias("same"))


#: A least-squares fit of one feature, the previous reading, on the train part of the chronological split.
LINEAR_ROWS = """lagged_v AS (
  SELECT event_id, ts, value, lag(value, 1) OVER (ORDER BY ts, event_id) AS x, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
ordered_v AS (
  SELECT event_id, value, x, row_number() OVER (ORDER BY ts, substr(md5(CAST(event_id AS VARCHAR) || '#0'), 1, 13)) AS k, count(*) OVER () AS n
  FROM lagged_v WHERE k > 672),
parted_v AS (
  SELECT *, CASE WHEN k <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train' WHEN k <= CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM ordered_v),
line_v AS (SELECT regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept FROM parted_v WHERE split = 'train'),
predicted_v AS (SELECT event_id, split, value, intercept + slope * x AS prediction FROM parted_v, line_v)"""
LAG = ("usage_lag_1",)


def linear_fit(rows: DataFrame) -> forecast.ForecastResult:
    linear = {forecast.LINEAR: forecast.candidate_regressors()[forecast.LINEAR]}
    return forecast.fit_and_compare(rows, "Usage_kWh", LAG, (), linear, (), key="event_id")


@query("score_payload", f"WITH {LINEAR_ROWS} SELECT event_id, 0 AS position, round(prediction, 6) AS prediction FROM predicted_v")
def score_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows as JSON payloads, unwrapped, checked, scored and checked again."""
    rows = forecast_rows(spark, sf_dir)
    record = F.to_json(F.struct(*[quoted(name) for name in (*NUMERIC, *CATEGORICAL)]))
    asked = rows.select("event_id", F.concat(F.lit('{"data": ['), record, F.lit("]}")).alias("payload"))
    scored = forecast.score_payloads(asked, "payload", linear_fit(rows).model, ["event_id"], LAG, ())
    return scored.select("event_id", "position", F.round("prediction", 6).alias("prediction"))


def trained_scorer(spark: SparkSession, sf_dir: str) -> classify.ProductScorer:
    frames = classify.training_frames(v.labelled(spark, sf_dir), SETTINGS)
    roster = [c for c in classify.candidates(SETTINGS, float(frames.counts["train"])) if c.name == classify.BAYES]
    _, models = classify.fit_candidates(frames, SETTINGS, roster)
    return classify.ProductScorer(frames.vectorizer, models[classify.BAYES], SETTINGS.tfidf)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.load_texts(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.lit(None).cast("string").alias("product_name"), F.col("role").alias("description")
    )


NB_TERMS = f"""WITH {v.VOCAB}, s AS (SELECT lang AS label, term, sum(tf) AS term_sum FROM tf_v JOIN vocab_v USING (term)
    JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL),
  c AS (SELECT label, sum(term_sum) AS class_sum FROM s GROUP BY label)
  SELECT c.label, t.term, round(ln((coalesce(s.term_sum, 0) + 1.0) / (c.class_sum + 1.0 * (SELECT count(*) FROM vocab_v))), 6) AS log_probability
  FROM vocab_v t CROSS JOIN c LEFT JOIN s ON s.label = c.label AND s.term = t.term"""


@query("nb_parameters", NB_TERMS)
def nb_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = tfidf.TfidfSettings()
    docs = materialise(v.corpus(spark, sf_dir).select(F.col("lang").alias("label"), "corpus"))
    counted = materialise(tfidf.term_statistics(docs, "corpus", settings, by=["label"]))
    terms = materialise(tfidf.fit_vocabulary(docs, "corpus", settings, counted))
    parameters = classify.naive_bayes_parameters(counted.select("label", "term", F.col("cf").alias("term_sum")), terms)
    return parameters.withColumn("log_probability", F.round("log_probability", 6))


# --- Preprocessing ------------------------------------------------------------------------

GAPPY = """gappy_v AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS a,
  CASE WHEN value < 20 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS b, 7.5 AS fixed,
  CASE WHEN value < 20 THEN NULL ELSE event_type END AS kind FROM events)"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return v.load(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", float("nan")).otherwise(value).alias("a"),
        F.when(value >= 20, F.col("user_id").cast("double")).alias("b"),
        F.lit(7.5).alias("fixed"),
        F.when(value >= 20, F.col("event_type")).alias("kind"),
    )


@query(
    "impute_scale",
    f"""WITH {GAPPY}, m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM gappy_v),
        f AS (SELECT event_id, coalesce(a, ma) AS a, coalesce(b, mb) AS b FROM gappy_v, m)
        SELECT event_id, round((a - (SELECT avg(a) FROM f)) / (SELECT stddev_pop(a) FROM f), 6) AS a,
          round((b - (SELECT avg(b) FROM f)) / (SELECT stddev_pop(b) FROM f), 6) AS b, 0.0::DOUBLE AS fixed FROM f""",
)
def impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gappy(spark, sf_dir)
    names = ["a", "b", "fixed"]
    filled = forecast.filled_numeric(rows, forecast.fit_numeric(rows, names))
    return filled.select("event_id", *[F.round(name, 6).alias(name) for name in names])


@query(
    "impute_onehot",
    f"""WITH {GAPPY}, seen AS (SELECT * FROM gappy_v WHERE kind IS DISTINCT FROM 'click'),
        mode_v AS (SELECT kind AS m FROM seen WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
        codes AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS position FROM
          (SELECT DISTINCT coalesce(kind, m) AS k FROM seen, mode_v))
        SELECT event_id, CAST(position AS INTEGER) AS position, CASE WHEN position IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS total
        FROM gappy_v CROSS JOIN mode_v LEFT JOIN codes ON k = coalesce(kind, m)""",
)
def impute_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted without clicks, so that a click is an unseen value with no position."""
    rows = gappy(spark, sf_dir)
    seen = rows.filter(~F.col("kind").eqNullSafe(F.lit("click")))
    model = forecast.fit_preprocessor(seen, numeric=["fixed"], categorical=["kind"])
    hot = F.unwrap_udt("_c0_hot")
    return model.transform(rows).select(
        "event_id",
        F.when(F.size(hot["indices"]) > 0, hot["indices"][0]).alias("position"),
        F.aggregate(hot["values"], F.lit(0.0), lambda total, x: total + x).alias("total"),
    )


#: The model's own 20 numeric and 3 categorical columns, those without a source made from the reading, its user and time.
SOURCES = {
    "Lagging_Current_Reactive.Power_kVarh": ("CASE WHEN event_type <> 'error' THEN value * 0.3 END", lambda: F.when(F.col("event_type") != "error", F.col("value") * 0.3)),
    "Leading_Current_Reactive_Power_kVarh": ("CAST(user_id AS DOUBLE)", lambda: F.col("user_id").cast("double")),
    "CO2(tCO2)": ("value / 1000", lambda: F.col("value") / 1000),
    "Lagging_Current_Power_Factor": ("CASE WHEN value >= 1 THEN least(100.0, value) END", lambda: F.when(F.col("value") >= 1, F.least(F.lit(100.0), F.col("value")))),
    "Leading_Current_Power_Factor": ("100.0 - least(100.0, value)", lambda: F.lit(100.0) - F.least(F.lit(100.0), F.col("value"))),
    "NSM": (
        "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE)",
        lambda: (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double"),
    ),
}
CALENDAR_SQL = {
    "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "day_of_year": "dayofyear(ts)", "hour": "hour(ts)",
    "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
}


def _history_sql(name: str) -> str:
    over, n = "ORDER BY ts, event_id", int(name.rsplit("_", 1)[1])
    if "_lag_" in name:
        return f"lag(value, {n}) OVER ({over})"
    function = "avg" if "_mean_" in name else "stddev_samp"
    frame = f"OVER ({over} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(value) {frame} = {n} THEN {function}(value) {frame} END"


MODEL_SQL = [SOURCES[n][0] if n in SOURCES else CALENDAR_SQL[n] if n in CALENDAR_SQL else _history_sql(n) for n in MODEL_NUMERIC]
CODES_SQL = ("CASE WHEN dayofweek(ts) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END", "dayname(ts)", "CASE WHEN value >= 5 THEN event_type END")


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading with all columns of the model; rows without a full history keep nulls for the preprocessor."""
    events = v.load(spark, sf_dir, "events")
    weekend = F.when(F.dayofweek("ts").isin(1, 7), "Weekend").otherwise("Weekday")
    made = events.withColumns({name: column() for name, (_, column) in SOURCES.items()}).withColumns(calendar_columns(F.col("ts")))
    coded = made.withColumns(dict(zip(MODEL_CATEGORICAL, (weekend, F.date_format("ts", "EEEE"), F.when(F.col("value") >= 5, F.col("event_type"))), strict=True)))
    return history_features(coded, F.col("ts"), "value", (), [F.col("event_id")])


def _scaled(i: int) -> str:
    return f"round((x{i} - (SELECT avg(x{i}) FROM filled_v)) / (SELECT coalesce(nullif(stddev_pop(x{i}), 0), 1) FROM filled_v), 5) + 0.0 AS n{i}"


@query(
    "preprocessed_features",
    f"""WITH raw_v AS (SELECT event_id, {', '.join(f'CAST({e} AS DOUBLE) AS x{i}' for i, e in enumerate(MODEL_SQL))},
          {', '.join(f'{e} AS c{i}' for i, e in enumerate(CODES_SQL))} FROM events),
        middle_v AS (SELECT {', '.join(f'quantile_cont(x{i}, 0.5) AS m{i}' for i in range(len(MODEL_SQL)))} FROM raw_v),
        filled_v AS (SELECT event_id, {', '.join(f'coalesce(x{i}, m{i}) AS x{i}' for i in range(len(MODEL_SQL)))},
          {', '.join(f"coalesce(c{i}, (SELECT c{i} FROM raw_v WHERE c{i} IS NOT NULL GROUP BY c{i} ORDER BY count(*) DESC, c{i} LIMIT 1)) AS c{i}" for i in range(len(CODES_SQL)))}
          FROM raw_v, middle_v)
        SELECT event_id, {', '.join(_scaled(i) for i in range(len(MODEL_SQL)))},
          {', '.join(f'CAST(dense_rank() OVER (ORDER BY c{i}) - 1 AS INTEGER) AS c{i}' for i in range(len(CODES_SQL)))} FROM filled_v""",
)
def preprocessed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature vector of the default model: 20 scaled numbers, and the positions of three one-hot codes."""
    rows = materialise(model_rows(spark, sf_dir).select("event_id", *[quoted(n) for n in (*MODEL_NUMERIC, *MODEL_CATEGORICAL)]))
    vectors = forecast.fit_preprocessor(rows).transform(rows)
    numbers = vector_to_array("features")
    hot = [F.unwrap_udt(f"_c{i}_hot")["indices"][0].alias(f"c{i}") for i in range(len(MODEL_CATEGORICAL))]
    return vectors.select("event_id", *[(F.round(numbers[i], 5) + 0.0).alias(f"n{i}") for i in range(len(MODEL_NUMERIC))], *hot)


# --- Regressors ---------------------------------------------------------------------------


@query(
    "reg_linear",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
         round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem""",
)
def reg_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = v.load(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(items)
    model = LinearRegression(solver="normal", labelCol="l_extendedprice").fit(rows)
    fitted = [(float(model.coefficients[0]), float(model.intercept))]
    return spark.createDataFrame(fitted, "slope double, intercept double").select(
        F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept")
    )


#: The model's own features as far as events have their sources: time, lags and rolling values.
NUMERIC = [name for name in MODEL_NUMERIC if name not in SERIES_NUMERIC]
CATEGORICAL = ["Load_Type"]


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading as one series with calendar, lag and rolling features, split by time."""
    events = v.load(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("value").alias("Usage_kWh"), F.col("event_type").alias("Load_Type")
    )
    calendar = events.withColumns(calendar_columns(F.col("ts")))
    featured = history_features(calendar, F.col("ts"), "Usage_kWh", (), [F.col("event_id")])
    complete = materialise(featured.na.drop("any"))
    return chronological_split(complete, F.col("ts"), "event_id")


def _fit_regressor(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        roster = forecast.candidate_regressors()
        result = forecast.fit_and_compare(
            forecast_rows(spark, sf_dir), "Usage_kWh", NUMERIC, CATEGORICAL, {name: roster[name]}, (), key="event_id"
        )
        return result.predictions[name].withColumn("prediction", F.round("prediction", 6))

    return run


query("reg_rf")(_fit_regressor(forecast.FOREST))
query("reg_gbt")(_fit_regressor(forecast.BOOSTED))


@query("regressor_comparison")
def regressor_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecast_rows(spark, sf_dir)
    return forecast.fit_and_compare(rows, "Usage_kWh", NUMERIC, CATEGORICAL).runs


def _errors(part: str) -> str:
    of = f"FILTER (split = '{part}')"
    squares = f"avg((value - prediction) ** 2) {of}"
    return f"""round(avg(abs(value - prediction)) {of}, 6) AS {part}_mae, round(sqrt({squares}), 6) AS {part}_rmse,
      round(1 - ({squares}) / (var_pop(value) {of}), 6) AS {part}_r2"""


@query(
    "comparison_linear",
    f"WITH {LINEAR_ROWS} SELECT '{forecast.LINEAR}' AS model_name, 'trained' AS status, {_errors('validation')}, {_errors('test')} FROM predicted_v",
)
def comparison_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of a one-feature linear fit on the validation and test parts."""
    runs = linear_fit(forecast_rows(spark, sf_dir)).runs
    errors = [F.round(f"{part}_{name}", 6).alias(f"{part}_{name}") for part in ("validation", "test") for name in ("mae", "rmse", "r2")]
    return runs.select("model_name", "status", *errors)


@query("score_energy", f"WITH {LINEAR_ROWS} SELECT event_id, round(prediction, 6) AS prediction FROM predicted_v")
def score_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecast_rows(spark, sf_dir)
    scored = forecast.score_energy(rows, linear_fit(rows).model, LAG, ())
    return scored.select("event_id", F.round("prediction", 6).alias("prediction"))
