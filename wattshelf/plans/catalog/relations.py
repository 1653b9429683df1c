"""Joins on order, cubes, sketches, time frames, buckets, variants and differences of versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions.series import micros
from wattshelf.operators import history
from wattshelf.operators.joins import asof_join, interval_join
from wattshelf.operators.series_features import rolling_time
from wattshelf.operators.versions import dataset_diff
from wattshelf.plans import views as v
from wattshelf.plans.catalog.registry import query
from wattshelf.session import materialise, scratch_path
from wattshelf.sources.json_records import variant_records
from wattshelf.sources.tables import write_bucketed

P = f"WITH {v.PREDICTIONS}"


@query(
    "asof_labels",
    """SELECT p.event_id, epoch_us(l.ts) AS labelled_at, l.label FROM events p ASOF LEFT JOIN
         (SELECT user_id, ts, max(event_id) AS label FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) l
       ON p.user_id = l.user_id AND p.ts >= l.ts""",
)
def asof_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's latest purchase so far, in blocks small enough that this table needs several."""
    events = v.load(spark, sf_dir, "events")
    labels = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("labelled"), F.col("event_id").alias("label"))
    joined = asof_join(
        events.select("event_id", "user_id", "ts"), labels, ["user_id"], "ts", "labelled", ["labelled", "label"], ["label"], rows_per_block=2000
    )
    return joined.select("event_id", micros(F.col("labelled")).alias("labelled_at"), "label")


@query(
    "interval_rules",
    """SELECT l_orderkey, l_linenumber, p_partkey AS rule FROM lineitem JOIN part
       ON CAST(l_extendedprice AS DOUBLE) BETWEEN CAST(p_retailprice AS DOUBLE) * 20 AND CAST(p_retailprice AS DOUBLE) * 20 + p_size / 25.0""",
)
def interval_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the price rules that they fall under: a rule per part, of its own width."""
    items = v.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    rules = v.load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rule"), (F.col("p_retailprice").cast("double") * 20).alias("low"),
        (F.col("p_retailprice").cast("double") * 20 + F.col("p_size") / 25.0).alias("high"),
    )
    return interval_join(items, rules, "l_extendedprice", "low", "high").select("l_orderkey", "l_linenumber", "rule")


@query(
    "history_cube",
    f"""{P}, {v.CUSTOMER_PRODUCTS}, h AS (
      SELECT predicted_category, predicted_sub_category, brand, CAST("timestamp" AS DATE) AS day, confidence
      FROM preds_v JOIN product_table_v ON product_id = id)
    SELECT predicted_category, predicted_sub_category, brand, epoch_us(day) AS day, CAST(GROUPING(predicted_category, predicted_sub_category, brand, day) AS BIGINT) AS grouping_id,
      count(*) AS rows, round(sum(confidence), 6) AS total FROM h GROUP BY CUBE (predicted_category, predicted_sub_category, brand, day)""",
)
def history_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and summed confidence over every combination of category, sub-category, brand and day."""
    joined = history.enriched_predictions(v.predictions(spark, sf_dir), v.product_table(spark, sf_dir))
    dated = joined.withColumn("day", F.to_date("timestamp"))
    cube = history.history_cube(dated, ["predicted_category", "predicted_sub_category", "brand", "day"])
    return cube.withColumns({"day": micros(F.col("day").cast("timestamp")), "total": F.round("total", 6)})


@query(
    "sketch_kpis",
    f"""{P} SELECT count(DISTINCT CAST("timestamp" AS DATE)) AS days, count(*) AS rows, count(DISTINCT product_id) AS exact_keys, true AS keys_in_bounds,
      round(quantile_cont(confidence, 0.5), 6) AS exact_median, true AS deciles_in_bounds FROM preds_v""",
)
def sketch_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches stored per day and merged, next to the exact values; ranks of the estimated deciles are counted."""
    predictions = v.predictions(spark, sf_dir)
    sketches = materialise(history.daily_sketches(predictions, "product_id", "confidence"), "sketches")
    shares = [i / 10 for i in range(1, 10)]
    merged = history.merged_kpis(sketches, shares).first()  # one row: counts and nine quantiles
    value, ranks, good = F.col("confidence"), [], F.lit(True)
    for i, (share, quantile) in enumerate(zip(shares, merged["quantiles"], strict=True)):
        ranks += [F.count_if(value < quantile).alias(f"below{i}"), F.count_if(value <= quantile).alias(f"upto{i}")]
        good = good & (F.col(f"below{i}") <= (share + 0.02) * F.col("rows")) & (F.col(f"upto{i}") >= (share - 0.02) * F.col("rows"))
    exact = predictions.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("product_id").alias("exact_keys"),
        F.round(F.percentile("confidence", 0.5), 6).alias("exact_median"), *ranks,
    )
    near = F.abs(F.lit(merged["distinct_keys"]) - F.col("exact_keys")) <= F.greatest(F.lit(1), 0.03 * F.col("exact_keys"))
    return exact.select(
        F.lit(merged["days"]).cast("bigint").alias("days"), F.lit(merged["rows"]).cast("bigint").alias("rows"), "exact_keys",
        near.alias("keys_in_bounds"), "exact_median", good.alias("deciles_in_bounds"),
    )


def _frame(name: str, span: str) -> str:
    over = f"OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {span} PRECEDING AND 1 PRECEDING)"
    return f"count(value) {over} AS {name}_rows, round(avg(value) {over}, 8) AS {name}_mean, round(stddev_samp(value) {over}, 6) AS {name}_std"


@query("rolling_time", f"SELECT event_id, {_frame('hour', '3600000000')}, {_frame('day', '86400000000')} FROM events")
def rolling_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each user's last hour and day, in blocks of time that this table has several of."""
    spans = {"hour": 3_600_000_000, "day": 86_400_000_000}
    rows = rolling_time(v.load(spark, sf_dir, "events"), F.col("ts"), "value", spans, ["user_id"], rows_per_block=2000)
    rounded = [F.round(f"{n}_{m}", digits).alias(f"{n}_{m}") for n in spans for m, digits in (("mean", 8), ("std", 6))]
    return rows.select("event_id", "hour_rows", "day_rows", *rounded)


def bucketed(spark: SparkSession, sf_dir: str, buckets: int = 8) -> tuple[str, str]:
    """Predictions by month and product, and products, as tables with buckets on the product."""
    names = [f"{name}_{uuid.uuid4().hex}" for name in ("predictions", "products")]
    dated = v.predictions(spark, sf_dir).withColumn("month", F.date_trunc("month", "timestamp").cast("date"))
    write_bucketed(dated, names[0], scratch_path(spark, "bucketed-predictions"), "product_id", buckets, ("month",))
    products = v.product_table(spark, sf_dir).withColumnRenamed("id", "product_id")
    write_bucketed(products, names[1], scratch_path(spark, "bucketed-products"), "product_id", buckets)
    return names[0], names[1]


def enriched_from_buckets(spark: SparkSession, predictions: str, products: str) -> DataFrame:
    """Each prediction with its product, joined bucket by bucket: no broadcast, no shuffle."""
    return spark.table(predictions).hint("merge").join(spark.table(products), "product_id")


@query(
    "enriched_bucketed",
    f"""{P}, {v.CUSTOMER_PRODUCTS} SELECT prediction_id, product_id, product_name, brand, round(confidence, 10) AS confidence
        FROM preds_v JOIN product_table_v ON product_id = id""",
)
def enriched_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = enriched_from_buckets(spark, *bucketed(spark, sf_dir))
    return joined.select("prediction_id", "product_id", "product_name", "brand", F.round("confidence", 10).alias("confidence"))


#: Event properties as an object, a list, wrapped, nested in a wrapped list, broken, and as a plain string.
SHAPES = """shaped_v AS (SELECT event_id, CASE event_type WHEN 'view' THEN '{"data": [' || props || ', {"k": "x", "n": {"id": ' || user_id || '}}]}'
  WHEN 'signup' THEN '{"data": ' || props || '}' WHEN 'click' THEN '[' || props || ', ' || props || ']'
  WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '{"k": ' ELSE '"' || user_id || '"' END ELSE props END AS payload FROM events)"""


@query(
    "payload_variant",
    f"""WITH {SHAPES}, parsed_v AS (SELECT event_id, TRY_CAST(payload AS JSON) AS j FROM shaped_v WHERE json_valid(payload)),
    body_v AS (SELECT event_id, coalesce(json_extract(j, '$.data'), j) AS b FROM parsed_v),
    record_v AS (
      SELECT event_id, 'list' AS shape, i AS position, json_extract(b, '$[' || i || ']') AS r FROM (
        SELECT event_id, b, unnest(range(0, CAST(json_array_length(b) AS BIGINT))) AS i FROM body_v WHERE json_type(b) = 'ARRAY')
      UNION ALL SELECT event_id, 'object', 0, b FROM body_v WHERE json_type(b) = 'OBJECT')
    SELECT event_id, CAST(position AS INTEGER) AS position, shape, TRY_CAST(json_extract_string(r, '$.k') AS BIGINT) AS k, CAST(json_extract_string(r, '$.n.id') AS BIGINT) AS nested FROM record_v""",
)
def payload_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, props, user = F.col("event_type"), F.col("props"), F.col("user_id").cast("string")
    payload = (
        F.when(kind == "view", F.concat(F.lit('{"data": ['), props, F.lit(', {"k": "x", "n": {"id": '), user, F.lit("}}]}")))
        .when(kind == "signup", F.concat(F.lit('{"data": '), props, F.lit("}")))
        .when(kind == "click", F.concat(F.lit("["), props, F.lit(", "), props, F.lit("]")))
        .when(kind == "error", F.when(F.col("event_id") % 2 == 0, F.lit('{"k": ')).otherwise(F.concat(F.lit('"'), user, F.lit('"'))))
        .otherwise(props)
    )
    events = v.load(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return variant_records(events, "payload", {"k": ("$.k", "bigint"), "nested": ("$.n.id", "bigint")}, ["event_id"])


#: A second version: some customers gone, some changed, some twice.
VERSIONS = """old_v AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer),
new_v AS (
  SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, nation
  FROM (SELECT *, unnest(range(CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 1 END)) FROM old_v) WHERE c_custkey % 13 <> 0)"""


@query(
    "dataset_diff",
    f"""WITH {VERSIONS} SELECT 'added' AS change, * FROM (SELECT * FROM new_v EXCEPT ALL SELECT * FROM old_v)
        UNION ALL SELECT 'removed', * FROM (SELECT * FROM old_v EXCEPT ALL SELECT * FROM new_v)""",
)
def version_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = v.load(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("nation")
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("c_custkey") % 5 == 0, 3).otherwise(1))).alias("copy")
    segment = F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    new = old.filter("c_custkey % 13 <> 0").select("c_custkey", "c_name", segment, "nation", copies).drop("copy")
    return dataset_diff(old, new)
