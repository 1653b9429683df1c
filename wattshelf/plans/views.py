"""Input views over the star-schema tables, as Spark frames and as the same SQL for the checks.

Damage to product and meter rows follows natural attributes (part size, event type, value), so
every view covers its whole table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions.fixed_values import STOP_WORDS
from wattshelf.functions.text import clean_text


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table. The session runs in UTC, as the timestamps are stored without a zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table for per-row work. A table with fewer file splits than the cluster has cores
    (only ever a small one) is spread over them; a large one is read as it is."""
    df = load(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- Products -----------------------------------------------------------------------------

PRODUCTS = """products_v AS (
  SELECT p_partkey AS row_id, p_name AS product_name, p_name AS description, p_brand AS brand,
         p_retailprice AS price, p_type AS category FROM part)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_name").alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("category"),
    )


PRODUCTS_DIRTY = """products_dirty_v AS (
  SELECT p_partkey * 2 + copy AS row_id, p_name AS product_name,
         CASE p_size WHEN 7 THEN NULL WHEN 8 THEN '  ' ELSE p_name END AS description,
         CASE p_size WHEN 9 THEN NULL ELSE p_brand END AS brand,
         CASE p_size WHEN 10 THEN '₹1,999' WHEN 11 THEN 'not-a-price' WHEN 12 THEN '1-2' WHEN 13 THEN NULL
              ELSE CAST(p_retailprice AS VARCHAR) END AS price,
         CASE p_size WHEN 1 THEN NULL WHEN 2 THEN 'unknown' WHEN 3 THEN ' N/A ' WHEN 4 THEN '12345'
              WHEN 5 THEN repeat('x', 130) WHEN 6 THEN '   ' WHEN 15 THEN ' ' || p_type || ' ' ELSE p_type END AS category
  FROM (SELECT *, unnest(CASE WHEN p_size = 14 THEN [0, 1] ELSE [0] END) AS copy FROM part))"""


def products_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    copies = F.when(size == 14, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return load(spark, sf_dir, "part").withColumn("copy", F.explode(copies)).select(
        (F.col("p_partkey") * 2 + F.col("copy")).alias("row_id"),
        F.col("p_name").alias("product_name"),
        F.when(size == 7, None).when(size == 8, "  ").otherwise(F.col("p_name")).alias("description"),
        F.when(size != 9, F.col("p_brand")).alias("brand"),
        F.when(size == 10, "₹1,999")
        .when(size == 11, "not-a-price")
        .when(size == 12, "1-2")
        .when(size == 13, None)
        .otherwise(F.col("p_retailprice").cast("string"))
        .alias("price"),
        F.when(size == 1, None)
        .when(size == 2, "unknown")
        .when(size == 3, " N/A ")
        .when(size == 4, "12345")
        .when(size == 5, "x" * 130)
        .when(size == 6, "   ")
        .when(size == 15, F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")))
        .otherwise(F.col("p_type"))
        .alias("category"),
    )


# --- Documents ----------------------------------------------------------------------------



def sql_list(values: Iterable[str]) -> str:
    """A list of SQL text literals."""
    return ",".join("'" + value.replace("'", "''") + "'" for value in values)


STOP = sql_list(STOP_WORDS)


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def sql_words(text: str) -> str:
    """Tags, URLs, case, punctuation, white space (texts without entities)."""
    untagged = f"regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')"
    plain = f"regexp_replace({untagged}, 'https?://[^\\s\\p{{Z}}]+|www\\.[^\\s\\p{{Z}}]+', ' ', 'g')"
    bare = f"regexp_replace(lower({plain}), '[!-/:-@\\[-`{{-~]', ' ', 'g')"
    return f"trim(regexp_replace({bare}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def sql_clean(text: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({sql_words(text)}, ' '), lambda w: w NOT IN ({STOP})), ' ')"
    )


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def sql_decode(text: str) -> str:
    """The entities that occur in the pages, the ampersand last. HTML decodes these four without
    their semicolon too, as happens where a page cuts one short."""
    steps = text
    for entity, character in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        steps = f"regexp_replace({steps}, '&{entity};?', '{character}', 'g')"
    return steps


CORPUS = f"corpus_v AS MATERIALIZED (SELECT doc_id, lang, source, {sql_clean('text')} AS corpus FROM documents)"
TOKENS = f"""{CORPUS},
tokens_v AS MATERIALIZED (SELECT doc_id, {sql_tokens('corpus')} AS t FROM corpus_v)"""
GRAMS = f"""{TOKENS},
grams_v AS MATERIALIZED (
  SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM tokens_v),
tf_v AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM grams_v GROUP BY ALL)"""
VOCAB = f"""{GRAMS},
n_v AS (SELECT count(*) AS n FROM documents),
vocab_all_v AS MATERIALIZED (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf_v GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n_v)),
vocab_v AS MATERIALIZED (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx, df, cf,
         ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT * FROM vocab_all_v ORDER BY cf DESC, term LIMIT 50000), n_v)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents. Their texts hold no entities, which the cleaning step sees by itself."""
    return load_texts(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", clean_text(F.col("text")).alias("corpus")
    )


LABELLED = f"""labelled_v AS (
  SELECT d.doc_id, d.lang AS category, CAST(l.toxic AS VARCHAR) AS sub_category, d.text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    return load_texts(spark, sf_dir, "documents").join(labels, "doc_id").select(
        "doc_id",
        F.col("lang").alias("category"),
        F.col("toxic").cast("string").alias("sub_category"),
        F.col("text").alias("description"),
    )


# --- Meter series -------------------------------------------------------------------------

CENTS = "CAST(round(value * 100) AS BIGINT)"

ENERGY = f"""energy_v AS (
  SELECT date_trunc('hour', ts) AS date, CAST(sum({CENTS}) AS BIGINT) / 100.0 AS "Usage_kWh", count(*) AS readings
  FROM events GROUP BY 1)"""
ENERGY_15M = f"""energy_15m_v AS (
  SELECT time_bucket(INTERVAL '15 minutes', ts) AS date, CAST(sum({CENTS}) AS BIGINT) / 100.0 AS "Usage_kWh"
  FROM events GROUP BY 1)"""


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("bigint")


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "events")
        .groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("date"))
        .agg((F.sum(cents(F.col("value"))) / F.lit(100.0)).alias("Usage_kWh"), F.count(F.lit(1)).alias("readings"))
    )


def energy_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.window(F.col("ts").cast("timestamp"), "15 minutes").getField("start")
    return (
        load(spark, sf_dir, "events")
        .groupBy(slot.alias("date"))
        .agg((F.sum(cents(F.col("value"))) / F.lit(100.0)).alias("Usage_kWh"))
    )


METER = """meter_v AS (
  SELECT event_id, user_id, event_type AS "Load_Type",
         CASE event_type WHEN 'view' THEN strftime(ts, '%d/%m/%Y %H:%M')
              WHEN 'error' THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date,
         CASE WHEN value < 1 AND event_type = 'error' THEN '-1.5' WHEN value < 1 AND event_type = 'view' THEN 'inf'
              WHEN value < 1 AND event_type = 'click' THEN 'abc' WHEN value < 1 AND event_type = 'signup' THEN NULL
              ELSE CAST(value AS VARCHAR) END AS "Usage_kWh"
  FROM events)"""


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings as text: three date spellings, and values that are negative, infinite or no number."""
    kind, value, ts = F.col("event_type"), F.col("value"), F.col("ts")
    small = value < 1
    return load(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        kind.alias("Load_Type"),
        F.when(kind == "view", F.date_format(ts, "dd/MM/yyyy HH:mm"))
        .when(kind == "error", "not a date")
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .alias("date"),
        F.when(small & (kind == "error"), "-1.5")
        .when(small & (kind == "view"), "inf")
        .when(small & (kind == "click"), "abc")
        .when(small & (kind == "signup"), None)
        .otherwise(value.cast("string"))
        .alias("Usage_kWh"),
    )


# --- Predictions --------------------------------------------------------------------------

PREDICTIONS = """preds_v AS (
  SELECT event_id AS prediction_id, user_id AS product_id, event_type AS predicted_category,
         CASE WHEN value < 20 THEN NULL WHEN value < 100 THEN 'low' ELSE 'high' END AS predicted_sub_category,
         least(1.0, value / 500) AS confidence, ts AS "timestamp" FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("prediction_id"),
        F.col("user_id").alias("product_id"),
        F.col("event_type").alias("predicted_category"),
        F.when(value < 20, None).when(value < 100, "low").otherwise("high").alias("predicted_sub_category"),
        F.least(F.lit(1.0), value / 500).alias("confidence"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


CUSTOMER_PRODUCTS = """product_table_v AS (
  SELECT c_custkey AS id, c_name AS product_name, c_mktsegment AS description,
         CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 1000 THEN NULL ELSE c_mktsegment END AS brand,
         c_acctbal AS price FROM customer)"""


def product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that predictions refer to: one per customer, the users of the events among them."""
    balance = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("product_name"),
        F.col("c_mktsegment").alias("description"),
        F.when(balance < 0, "").when(balance < 1000, None).otherwise(F.col("c_mktsegment")).alias("brand"),
        balance.alias("price"),
    )


# Two rules that guess the return flag stand for classifiers, three for regressors of a price.
CLASS_RUNS = """class_pred_v AS (
  SELECT 'Logistic Regression' AS model_name, 0 AS ordinal, l_returnflag AS actual,
         CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS predicted FROM lineitem
  UNION ALL
  SELECT 'Naive Bayes', 1, l_returnflag, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END FROM lineitem
  UNION ALL
  SELECT 'Rule List', 2, l_returnflag, CASE WHEN l_discount > 0.05 THEN 'R' ELSE l_returnflag END FROM lineitem)"""


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity")
    rules = [
        ("Logistic Regression", F.when(quantity < 15, "A").when(quantity < 35, "N").otherwise("R")),
        ("Naive Bayes", F.when(F.col("l_linestatus") == "F", "A").otherwise("N")),
        ("Rule List", F.when(F.col("l_discount") > 0.05, "R").otherwise(F.col("l_returnflag"))),
    ]
    guesses = F.array(
        *[
            F.struct(F.lit(name).alias("model_name"), F.lit(i).alias("ordinal"), rule.alias("predicted"))
            for i, (name, rule) in enumerate(rules)
        ]
    )
    return items.select(F.col("l_returnflag").alias("actual"), F.explode(guesses).alias("g")).select("actual", "g.*")


REGRESSION_RUNS = """price_pred_v AS (
  SELECT 'linear_regression' AS model_name, 0 AS ordinal, l_extendedprice AS actual, 2100.0 * l_quantity AS predicted FROM lineitem
  UNION ALL SELECT 'random_forest', 1, l_extendedprice, 1000.0 * l_quantity + 27000.0 FROM lineitem
  UNION ALL SELECT 'gradient_boosting', 2, l_extendedprice, 2000.0 * l_quantity + 1500.0 FROM lineitem)"""


def price_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    lines = [("linear_regression", 2100.0, 0.0), ("random_forest", 1000.0, 27000.0), ("gradient_boosting", 2000.0, 1500.0)]
    guesses = F.array(
        *[
            F.struct(
                F.lit(name).alias("model_name"),
                F.lit(i).alias("ordinal"),
                (F.lit(a) * F.col("l_quantity") + F.lit(b)).alias("predicted"),
            )
            for i, (name, a, b) in enumerate(lines)
        ]
    )
    return items.select(F.col("l_extendedprice").alias("actual"), F.explode(guesses).alias("g")).select("actual", "g.*")


DRIFT_DATE = "1998-06-01"
DRIFT_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")
DRIFT = f"""drift_ref_v AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{DRIFT_DATE}'),
drift_cur_v AS (SELECT l_orderkey, l_quantity * 0.8 AS l_quantity, l_extendedprice, l_discount, l_shipdate FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '{DRIFT_DATE}')"""


def drift_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items before and from a date on; the later quantities are shrunk, so that they drift."""
    items = load(spark, sf_dir, "lineitem")
    later = F.lit(DRIFT_DATE).cast("timestamp_ntz")
    reference = items.filter(F.col("l_shipdate") < later)
    current = items.filter(F.col("l_shipdate") >= later).withColumn("l_quantity", F.col("l_quantity") * 0.8)
    return reference, current
