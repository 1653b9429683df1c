"""Meter-series quality, features and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted
from wattshelf.functions.series import calendar_columns, micros, parse_timestamp
from wattshelf.operators import series_quality as quality
from wattshelf.operators import split
from wattshelf.operators.series_features import build_features, history_features
from wattshelf.plans import views as v
from wattshelf.plans.catalog.registry import query

PARSED = "coalesce(try_strptime(date, '%d/%m/%Y %H:%M'), try_strptime(date, '%Y-%m-%d %H:%M:%S'))"
RULES = quality.SeriesRules(
    numeric=("Usage_kWh",),
    categorical=("Load_Type",),
    series=(),
    allowed={"Load_Type": ["view", "click", "purchase"]},
)


#: Spellings of a timestamp, by event_id: a pattern, and the unit it is cut to.
SPELLINGS = (
    ("yyyy-MM-dd HH:mm:ss", "second"),
    ("dd/MM/yyyy HH:mm", "minute"),
    ("d.M.yyyy H:mm:ss", "second"),
    ("yyyy/MM/dd HH:mm", "minute"),
    ("d MMM yyyy", "day"),
    ("MMMM d, yyyy HH:mm", "minute"),
    ("dd/MM/yy HH:mm", "minute"),
    ("dd/MM/yyyy h:mm a", "minute"),
    ("yyyyMMdd", "day"),
    ("dd/MM/yyyy'T'HH:mm", "minute"),
    ("'soon'", None),
)


@query(
    "parse_ts_mixed",
    "SELECT event_id, CASE event_id % " + str(len(SPELLINGS)) + " "
    + " ".join(f"WHEN {i} THEN epoch_us(date_trunc('{unit}', ts))" for i, (_, unit) in enumerate(SPELLINGS) if unit)
    + " END AS at_us FROM events",
)
def parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's time in one of eleven spellings, read back."""
    spelled = F.lit(None).cast("string")
    for i, (pattern, _) in enumerate(SPELLINGS):
        spelled = F.when(F.col("event_id") % len(SPELLINGS) == i, F.date_format("ts", pattern)).otherwise(spelled)
    events = v.load(spark, sf_dir, "events").select("event_id", spelled.alias("date"))
    return events.select("event_id", micros(parse_timestamp(F.col("date"))).alias("at_us"))


@query(
    "ts_duplicates",
    f"""WITH {v.METER}, at_v AS (SELECT epoch_us({PARSED}) AS at_us, user_id FROM meter_v),
        slot_v AS (SELECT user_id, at_us, count(*) AS n FROM at_v GROUP BY ALL)
        SELECT user_id, CAST(coalesce(sum(n) FILTER (at_us IS NULL), 0) AS BIGINT) AS invalid_dates,
          CAST(sum(n - 1) AS BIGINT) AS duplicate_timestamps FROM slot_v GROUP BY user_id""",
)
def ts_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.meter(spark, sf_dir)
    return quality.duplicate_timestamps(rows, quality.timestamp_of(rows, "date"), ["user_id"])


@query(
    "ts_numeric_check",
    f"""WITH {v.METER} SELECT 'Usage_kWh' AS "column", count(*) FILTER (TRY_CAST("Usage_kWh" AS DOUBLE) IS NULL) AS non_numeric,
          count(*) FILTER (isinf(TRY_CAST("Usage_kWh" AS DOUBLE))) AS infinite FROM meter_v
        UNION ALL SELECT 'Load_Type', count(*) FILTER (TRY_CAST("Load_Type" AS DOUBLE) IS NULL), 0 FROM meter_v
        UNION ALL SELECT 'user_id', 0, 0 FROM (SELECT count(*) FROM meter_v)""",
)
def ts_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.numeric_check(v.meter(spark, sf_dir), ["Usage_kWh", "Load_Type", "user_id"])


@query(
    "ts_report",
    f"""WITH {v.METER}, x AS (SELECT *, epoch_us({PARSED}) AS at_us, TRY_CAST("Usage_kWh" AS DOUBLE) AS u FROM meter_v),
        slot_v AS (SELECT at_us, count(*) AS n FROM x GROUP BY at_us),
        step_v AS (SELECT at_us - lag(at_us) OVER (ORDER BY at_us) AS d FROM x WHERE at_us IS NOT NULL)
        SELECT count(*) AS row_count,
          count(*) FILTER (date IS NULL) + count(*) FILTER ("Usage_kWh" IS NULL) + count(*) FILTER ("Load_Type" IS NULL) AS missing_values,
          count(*) FILTER (at_us IS NULL) AS invalid_dates, count(*) FILTER (u < 0) AS negative_target,
          count(*) FILTER (u IS NULL) AS non_numeric, count(*) FILTER (isinf(u)) AS infinite,
          (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM meter_v GROUP BY date, "Usage_kWh", "Load_Type")) AS duplicate_rows,
          (SELECT CAST(sum(n - 1) AS BIGINT) FROM slot_v) AS duplicate_timestamps,
          CAST(max(at_us) <= min(at_us) AS BIGINT) AS single_timestamp_series,
          (SELECT CAST(count(*) FILTER (d <> 900000000) > 0 AS BIGINT) FROM step_v) AS irregular_series FROM x""",
)
def ts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.series_report(v.meter(spark, sf_dir), RULES)


@query(
    "domain_violations",
    f"""WITH {v.METER} SELECT DISTINCT 'Load_Type' AS "column", "Load_Type" AS value FROM meter_v
        WHERE "Load_Type" NOT IN ('view', 'click', 'purchase')""",
)
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.domain_violations(v.meter(spark, sf_dir), RULES.allowed)


def frequency_sql(view: str, step: int) -> str:
    return f"""SELECT '{view}' AS grain, count(*) AS row_count, count(DISTINCT date) AS slot_count,
      epoch_us(min(date)) AS first_at, epoch_us(max(date)) AS last_at, (SELECT count(*) FILTER (d <> {step}) = 0 FROM
      (SELECT date_diff('second', lag(date) OVER (ORDER BY date), date) AS d FROM {view})) AS regular FROM {view}"""


@query(
    "ts_frequency",
    f"WITH {v.ENERGY}, {v.ENERGY_15M} {frequency_sql('energy_v', 3600)} UNION ALL {frequency_sql('energy_15m_v', 900)}",
)
def ts_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = quality.frequency_check(v.energy(spark, sf_dir), F.col("date"), step_seconds=3600)
    quarter = quality.frequency_check(v.energy_15m(spark, sf_dir), F.col("date"), step_seconds=900)
    return hourly.withColumn("grain", F.lit("energy_v")).unionByName(quarter.withColumn("grain", F.lit("energy_15m_v")))


@query(
    "ts_gaps",
    """WITH x AS (SELECT user_id, epoch_us(ts) AS at_us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_us FROM events)
       SELECT user_id, at_us, previous_us, round((at_us - previous_us) / 1000000.0, 6) AS gap_seconds FROM x
       WHERE at_us - previous_us <> 900000000""",
)
def ts_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings of each user against a 15-minute step."""
    found = quality.gaps(v.load(spark, sf_dir, "events"), F.col("ts"), ["user_id"])
    return found.withColumn("gap_seconds", F.round("gap_seconds", 6))


@query(
    "ts_gaps_15m",
    f"""WITH {v.ENERGY_15M}, x AS (SELECT epoch_us(date) AS at_us, lag(epoch_us(date)) OVER (ORDER BY date) AS previous_us FROM energy_15m_v)
        SELECT at_us, previous_us, (at_us - previous_us) / 1000000.0 AS gap_seconds FROM x WHERE at_us - previous_us <> 900000000""",
)
def ts_gaps_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gaps(v.energy_15m(spark, sf_dir), F.col("date"))


# --- Features -----------------------------------------------------------------------------


@query(
    "calendar_features",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
         CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(hour(ts) AS INTEGER) AS hour,
         round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos FROM events""",
)
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.load(spark, sf_dir, "events")
    rows = events.select("event_id", *[c.alias(name) for name, c in calendar_columns(F.col("ts")).items()])
    # Adding zero turns a rounded -0.0 into 0.0.
    return rows.withColumns({name: F.round(name, 6) + F.lit(0.0) for name in ("hour_sin", "hour_cos")})


def lag_sql(over: str) -> str:
    return ", ".join(f"lag(value, {k}) OVER ({over}) AS usage_lag_{k}" for k in (1, 4, 96, 672))


def rolling_sql(over: str) -> str:
    def one(name: str, function: str, n: int) -> str:
        frame = f"OVER ({over} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        return f"CASE WHEN count(value) {frame} = {n} THEN round({function}(value) {frame}, 8) END AS usage_rolling_{name}_{n}"

    return ", ".join([one("mean", "avg", 4), one("mean", "avg", 96), one("std", "stddev_samp", 96)])


def history(df: DataFrame, series: list[str], **options: object) -> DataFrame:
    rows = history_features(df, F.col("ts"), "value", series, [F.col("event_id")], **options)
    rolled = [name for name in rows.columns if "_rolling_" in name]
    lagged = [name for name in rows.columns if "_lag_" in name]
    return rows.select("event_id", *lagged, *[F.round(name, 8).alias(name) for name in rolled])


@query("lag_features", f"SELECT event_id, {lag_sql('PARTITION BY user_id ORDER BY ts, event_id')} FROM events")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history_features(
        v.load(spark, sf_dir, "events"), F.col("ts"), "value", ["user_id"], [F.col("event_id")], means=(), stds=()
    )
    return rows.drop("ts", "user_id", "event_type", "value", "props")


@query(
    "rolling_features",
    f"SELECT event_id, {rolling_sql('PARTITION BY event_type ORDER BY ts, event_id')} FROM events",
)
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(v.load(spark, sf_dir, "events"), ["event_type"], lags=())


@query(
    "lag_features_halo",
    f"SELECT event_id, {lag_sql('ORDER BY ts, event_id')}, {rolling_sql('ORDER BY ts, event_id')} FROM events",
)
def lag_features_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings as one series, cut into blocks small enough that this table needs several."""
    return history(v.load(spark, sf_dir, "events"), [], rows_per_block=2000)


FEATURED = f"""featured_v AS (SELECT date, "Usage_kWh" AS value FROM energy_v),
f_v AS (SELECT date, value, {lag_sql('ORDER BY date')}, {rolling_sql('ORDER BY date')} FROM featured_v)"""


@query(
    "features_dropna",
    f"""WITH {v.ENERGY}, {FEATURED} SELECT epoch_us(date) AS at_us, value AS "Usage_kWh", CAST(hour(date) AS INTEGER) AS hour, * EXCLUDE (date, value)
        FROM f_v WHERE usage_lag_672 IS NOT NULL""",
)
def features_dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build_features(v.energy(spark, sf_dir))
    rolled = [name for name in rows.columns if "_rolling_" in name]
    lagged = [name for name in rows.columns if "_lag_" in name]
    return rows.select(
        micros(quoted("date")).alias("at_us"), "Usage_kWh", "hour", *lagged, *[F.round(n, 8).alias(n) for n in rolled]
    )


# --- Splits and labels --------------------------------------------------------------------


@query(
    "label_profile",
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
       SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS class_count, min(n) AS smallest_class, count(*) >= 2 AS trainable FROM c""",
)
def label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.label_profile(v.load(spark, sf_dir, "documents"), "lang")


STRATIFY = """SELECT '{0}' AS label, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS class_count, min(n) AS smallest_class,
  CAST(ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS test_rows, CAST(sum(n) - ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS train_rows,
  min(n) >= 2 AND ceil(sum(n) * 0.2::DOUBLE) >= count(*) AND sum(n) - ceil(sum(n) * 0.2::DOUBLE) >= count(*) AS stratify
  FROM (SELECT count(*) AS n FROM {1} GROUP BY {2})"""


@query(
    "can_stratify",
    STRATIFY.format("lang", "documents", "lang")
    + " UNION ALL "
    + STRATIFY.format("lang_quality_toxic", "documents JOIN labels USING (doc_id)", "lang, quality, toxic"),
)
def can_stratify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.load(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = docs.join(v.load(spark, sf_dir, "labels"), "doc_id").select(
        F.concat_ws("|", "lang", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("l")
    )
    plain = split.can_stratify(docs, "lang", 0.2).withColumn("label", F.lit("lang"))
    return plain.unionByName(split.can_stratify(joined, "l", 0.2).withColumn("label", F.lit("lang_quality_toxic")))


@query(
    "stratified_split",
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
       t AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS want FROM c),
       q AS (SELECT lang, (n * want) // total AS base, (n * want) % total AS rest, want FROM c, t),
       r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang) AS k, CAST(sum(base) OVER () AS BIGINT) AS given FROM q),
       quota AS (SELECT lang, base + CASE WHEN k <= want - given THEN 1 ELSE 0 END AS quota FROM r),
       o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
         ORDER BY substr(md5(CAST(doc_id AS VARCHAR) || '#42'), 1, 13)) AS k FROM documents)
       SELECT doc_id, lang, CASE WHEN k <= quota THEN 'test' ELSE 'train' END AS split FROM o JOIN quota USING (lang)""",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.load(spark, sf_dir, "documents").select("doc_id", "lang")
    return split.train_test_split(docs, "doc_id", "lang", 0.2, 42)


@query(
    "class_weights",
    """WITH c AS (SELECT lang AS label, count(*) AS rows FROM documents GROUP BY lang)
       SELECT label, rows, round((SELECT sum(rows) FROM c) / ((SELECT count(*) FROM c) * rows), 6) AS weight FROM c""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.class_weights(v.load(spark, sf_dir, "documents"), "lang")
    return rows.withColumn("weight", F.round("weight", 6))


@query(
    "chrono_split",
    """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, substr(md5(CAST(event_id AS VARCHAR) || '#0'), 1, 13)) AS k,
         count(*) OVER () AS n FROM events)
       SELECT event_id, CASE WHEN k <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
         WHEN k <= CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM o""",
)
def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.chronological_split(v.load(spark, sf_dir, "events"), F.col("ts"), "event_id")
    return rows.select("event_id", "split")


@query(
    "chrono_split_ties",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, substr(md5(CAST(o_orderkey AS VARCHAR) || '#0'), 1, 13)) AS k,
         count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, CASE WHEN k <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
         WHEN k <= CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM o""",
)
def chrono_split_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders share their dates, so both cuts fall inside a day."""
    rows = split.chronological_split(v.load(spark, sf_dir, "orders"), F.col("o_orderdate"), "o_orderkey")
    return rows.select("o_orderkey", "split")


DIGEST = """md5(concat_ws('|', {}))""".format(
    ", ".join(
        f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '-')"
        for c in ("CAST(doc_id AS VARCHAR)", "text", "lang", "source", "CAST(n_chars AS VARCHAR)")
    )
)


@query(
    "dataset_fingerprint",
    f"""WITH d AS (SELECT {DIGEST} AS digest FROM documents)
        SELECT count(*) AS row_count, sha256(concat_ws(':', CAST(count(*) AS VARCHAR),
          CAST(sum(CAST('0x' || substr(digest, 1, 15) AS BIGINT)) AS VARCHAR),
          CAST(sum(CAST('0x' || substr(digest, 16, 15) AS BIGINT)) AS VARCHAR))) AS fingerprint FROM d""",
)
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.dataset_fingerprint(v.load(spark, sf_dir, "documents"))
