"""Streaming queries, run over the whole table as a finite stream and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions.fixed_values import LAGS, ROLLING_MEANS, ROLLING_STDS
from wattshelf.functions.series import micros
from wattshelf.operators import drift, history
from wattshelf.plans import views as v
from wattshelf.plans.catalog.models import PREDICTED, SCORED_REQUESTS, trained_scorer
from wattshelf.plans.catalog.monitoring import WINDOWED_PSI
from wattshelf.plans.catalog.products import DIRTY, INVALID, PRICE, RULES, blank
from wattshelf.plans.catalog.registry import query
from wattshelf.session import scratch_path
from wattshelf.streaming import streams


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, one file or a folder of files, as a stream; the path is a pattern, as a stream refuses a plain file."""
    schema = v.load(spark, sf_dir, name).schema
    return streams.file_stream(spark, f"{sf_dir.rstrip('/')}/{name}.parque[t]", schema, "*")


def event_stream(spark: SparkSession, sf_dir: str, closing: str) -> DataFrame:
    """The events as a stream that ends: one event two days after the last moves the watermark past all others.

    That event is above the watermark itself, so no window, feature row or unmatched row of it comes out.
    ``closing`` is the folder it is written to.
    """
    events = v.load(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last")).filter("last IS NOT NULL")
    values = {"ts": F.col("last") + F.expr("INTERVAL 2 DAYS"), "event_type": F.lit("click"), "value": F.lit(0.0)}
    row = last.select(*[values.get(f.name, F.lit(-1)).cast(f.dataType).alias(f.name) for f in events.schema])
    row.write.parquet(closing)
    both = table_stream(spark, sf_dir, "events").unionByName(streams.file_stream(spark, closing, events.schema))
    return both.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_score",
    f"{SCORED_REQUESTS} SELECT row_number() OVER (ORDER BY conv_id, turn) AS prediction_id, {PREDICTED.format(digits=5)} FROM scored_v",
)
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns scored as they arrive; products and predictions stored per batch."""
    scorer = trained_scorer(spark, sf_dir)
    turns = table_stream(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("request_id"),
        "text",
        F.lit(None).cast("string").alias("product_name"),
        F.col("role").alias("description"),
        F.lit(None).cast("string").alias("brand"),
        F.lit(None).cast("double").alias("price"),
    )
    base = scratch_path(spark, "stream-score")
    writer = streams.scoring_stream(
        turns, scorer, "request_id", f"{base}/products", f"{base}/predictions", f"{base}/rejected"
    )
    streams.run_available(writer, f"{base}/checkpoint")
    stored = spark.read.parquet(f"{base}/predictions")
    return stored.select("prediction_id", "predicted_category", "predicted_sub_category", F.round("confidence", 5).alias("confidence"))


@query(
    "stream_quarantine",
    f"""{DIRTY}, f AS (SELECT row_id, {blank('category')} OR {INVALID} OR {blank('description')}
          OR (price IS NOT NULL AND {PRICE} IS NULL) AS bad FROM products_dirty_v)
        SELECT row_id, CASE WHEN bad THEN 'quarantine' ELSE 'accepted' END AS sink FROM f""",
)
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged products as a stream: one sink for rows that pass, one for the others."""
    base = scratch_path(spark, "stream-quarantine")
    damaged = f"{base}/source"
    source = v.products_dirty(spark, sf_dir)
    source.write.parquet(damaged)
    stream = streams.file_stream(spark, damaged, source.schema)
    writer = streams.quarantine_stream(stream, RULES, f"{base}/good", f"{base}/bad")
    streams.run_available(writer, f"{base}/checkpoint")
    good = spark.read.parquet(f"{base}/good").select("row_id", F.lit("accepted").alias("sink"))
    return good.unionByName(spark.read.parquet(f"{base}/bad").select("row_id", F.lit("quarantine").alias("sink")))


@query(
    "stream_lags",
    """SELECT user_id, event_id, epoch_us(ts) AS at_us, lag(value, 1) OVER w AS usage_lag_1, lag(value, 4) OVER w AS usage_lag_4,
          lag(value, 96) OVER w AS usage_lag_96, lag(value, 672) OVER w AS usage_lag_672,
          CASE WHEN count(value) OVER r = 4 THEN round(avg(value) OVER r, 8) END AS usage_rolling_mean_4,
          CASE WHEN count(value) OVER d = 96 THEN round(avg(value) OVER d, 8) END AS usage_rolling_mean_96,
          CASE WHEN count(value) OVER d = 96 THEN round(stddev_samp(value) OVER d, 8) END AS usage_rolling_std_96
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
          r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
          d AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)""",
)
def stream_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream-lags")
    features = streams.lag_stream(
        event_stream(spark, sf_dir, f"{base}/closing"), "user_id", "ts", "event_id", "value", "1 hour",
        lags=LAGS, means=ROLLING_MEANS, stds=ROLLING_STDS,
    )
    streams.start_to_table(features, f"{base}/out", f"{base}/checkpoint")
    rolled = ["usage_rolling_mean_4", "usage_rolling_mean_96", "usage_rolling_std_96"]
    return spark.read.parquet(f"{base}/out").select(
        "user_id",
        F.col("row_key").alias("event_id"),
        "at_us",
        *[f"usage_lag_{n}" for n in LAGS],
        *[F.round(name, 8).alias(name) for name in rolled],
    )


@query(
    "stream_dedup",
    "SELECT DISTINCT event_type, epoch_us(date_trunc('minute', ts)) AS minute FROM events",
)
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event type and minute within the watermark."""
    base = scratch_path(spark, "stream-dedup")
    rows = table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("minute", F.date_trunc("minute", "ts"))
    kept = streams.dedup_stream(rows, ["event_type", "minute"], "ts", "1 hour")
    streams.start_to_table(kept, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("event_type", micros(F.col("minute")).alias("minute"))


@query(
    "stream_window_counts",
    """SELECT epoch_us(time_bucket(INTERVAL '15 minutes', ts)) AS window_start, event_type AS predicted_category,
          count(*) AS rows, round(avg(least(1.0, value / 500)), 10) AS mean_confidence FROM events GROUP BY 1, 2""",
)
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream-windows")
    predictions = event_stream(spark, sf_dir, f"{base}/closing").select(
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("predicted_category"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"),
    )
    counts = history.windowed_category_counts(predictions, watermark="1 hour")
    streams.start_to_table(counts, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(
        micros(F.col("window_start")).alias("window_start"),
        "predicted_category",
        "rows",
        F.round("mean_confidence", 10).alias("mean_confidence"),
    )


@query(
    "stream_psi",
    f"WITH {WINDOWED_PSI} SELECT * FROM wpsi_v",
)
def stream_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed drift check as a stream: a day is measured once it has closed."""
    base = scratch_path(spark, "stream-psi")
    reference = v.load(spark, sf_dir, "events").filter("event_type = 'view'")
    bins = drift.reference_bins(reference, ["value"])
    expected = drift.histogram(reference, bins, "expected")
    current = event_stream(spark, sf_dir, f"{base}/closing").filter("event_type <> 'view'")
    writer = streams.psi_stream(current, "ts", bins, expected, "1 day", "1 hour", f"{base}/out")
    streams.run_available(writer, f"{base}/checkpoint")
    rows = spark.read.parquet(f"{base}/out")
    return rows.select(micros(F.col("window_start")).alias("window_start"), "column", F.round("psi", 6).alias("psi"))


@query(
    "stream_delayed_labels",
    """SELECT event_id, value * 1.1 AS prediction, CASE WHEN event_type IN ('purchase', 'click') THEN value END AS actual FROM events""",
)
def stream_delayed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and the labels that follow ten minutes later, joined as two streams; some never get one."""
    base = scratch_path(spark, "stream-labels")
    events = event_stream(spark, sf_dir, f"{base}/closing")
    predictions = events.select(
        "event_id", F.col("ts").alias("predicted_at"), (F.col("value") * 1.1).alias("prediction")
    )
    labels = (
        events.filter(F.col("event_type").isin("purchase", "click"))
        .select("event_id", (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("labelled_at"), F.col("value").alias("actual"))
    )
    joined = streams.delayed_label_stream(predictions, labels, "event_id", "predicted_at", "labelled_at", "1 HOUR")
    streams.start_to_table(joined, f"{base}/out", f"{base}/checkpoint")
    # The closing event has a label of its own, and so may come out as a match.
    rows = spark.read.parquet(f"{base}/out").filter(F.col("event_id") >= 0)
    return rows.select("event_id", "prediction", "actual")


# --- Sessions and late rows ---------------------------------------------------------------

#: Errors come in a second batch: those at or before an hour behind the latest other event are late.
ARRIVALS = """mark_v AS (SELECT max(ts) - INTERVAL 1 HOUR AS bound FROM events WHERE event_type <> 'error'),
arrival_v AS (SELECT e.*, event_type <> 'error' OR ts > bound AS accepted FROM events e, mark_v)"""


def arrivals(spark: SparkSession, sf_dir: str, base: str) -> None:
    """Two batches of events through the split of late rows, into ``accepted`` and ``late`` below ``base``."""
    events = v.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.col("event_type") == "error"
    for part in (events.filter(~late), events.filter(late)):
        part.write.mode("append").parquet(f"{base}/source")
        stream = streams.file_stream(spark, f"{base}/source", events.schema)
        writer = streams.late_split_stream(stream, "ts", "1 HOUR", f"{base}/accepted", f"{base}/late", f"{base}/marks")
        streams.run_available(writer, f"{base}/split-checkpoint")


@query(
    "stream_late_rows",
    f"WITH {ARRIVALS} SELECT event_id, CASE WHEN accepted THEN 'accepted' ELSE 'late' END AS sink FROM arrival_v",
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream-late")
    arrivals(spark, sf_dir, base)
    sinks = [spark.read.parquet(f"{base}/{sink}").select("event_id", F.lit(sink).alias("sink")) for sink in ("accepted", "late")]
    return sinks[0].unionByName(sinks[1])


@query(
    "stream_sessions",
    f"""WITH {ARRIVALS}, gap_v AS (
      SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM arrival_v WHERE accepted
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    island_v AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS n FROM gap_v)
    SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS session_end, count(*) AS rows, round(sum(value), 6) AS total
    FROM island_v GROUP BY user_id, n""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per user of the rows that came in time."""
    base = scratch_path(spark, "stream-sessions")
    arrivals(spark, sf_dir, base)
    accepted = spark.read.parquet(f"{base}/accepted").drop("batch_id")
    last = accepted.agg(F.max("ts").alias("last")).filter("last IS NOT NULL")
    values = {"ts": F.col("last") + F.expr("INTERVAL 2 DAYS"), "value": F.lit(0.0)}
    last.select(*[values.get(f.name, F.lit(-1)).cast(f.dataType).alias(f.name) for f in accepted.schema]).write.parquet(f"{base}/closing")
    stream = streams.file_stream(spark, f"{base}/accepted", accepted.schema).drop("batch_id").unionByName(
        streams.file_stream(spark, f"{base}/closing", accepted.schema)
    )
    sessions = streams.session_stream(stream, ["user_id"], "ts", "30 minutes", "1 hour", "value")
    streams.start_to_table(sessions, f"{base}/out", f"{base}/checkpoint")
    rows = spark.read.parquet(f"{base}/out")
    return rows.select(
        "user_id", micros(F.col("session_start")).alias("session_start"), micros(F.col("session_end")).alias("session_end"), "rows", F.round("total", 6).alias("total")
    )
