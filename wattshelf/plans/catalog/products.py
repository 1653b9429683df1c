"""Projections, product quality, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import quoted
from wattshelf.functions.fixed_values import PLACEHOLDER_CATEGORIES
from wattshelf.functions.money import parse_price
from wattshelf.functions.text import composite_label, split_label
from wattshelf.operators import product_quality as quality
from wattshelf.operators.projection import (
    blank_rows,
    canonical_projection,
    clean_columns,
    combine_text,
    history_by_category,
    keep_labelled,
    lookup,
    resolve_request_text,
    sample_rows,
)
from wattshelf.plans import views as v
from wattshelf.plans.catalog.registry import query
from wattshelf.session import scratch_path
from wattshelf.sources.csv_files import read_csv, write_csv
from wattshelf.sources.json_records import latest_report, payload_rows, read_reports, rejected_payloads, write_report
from wattshelf.sources.tables import (
    append,
    confidence_violations,
    missing_products,
    new_products,
    read_table,
    upsert_models,
    write_scored_batch,
    PRODUCTS_SCHEMA,
)

RULES = quality.QualityRules(row_id="row_id")
ALLOWED = ("Economy", "STANDARD ", "promo")
WHITELIST = quality.QualityRules(row_id="row_id", allowed_categories=ALLOWED)
S = v.sql_strip
PLACEHOLDERS = v.sql_list(PLACEHOLDER_CATEGORIES)
INVALID = (
    f"(category IS NULL OR lower({S('category')}) IN ({PLACEHOLDERS}) OR length({S('category')}) > 120 "
    f"OR NOT regexp_matches({S('category')}, '[A-Za-z]'))"
)
PRICE = "TRY_CAST(regexp_replace(price, '[^0-9.\\-]', '', 'g') AS DOUBLE)"
DIRTY = f"WITH {v.PRODUCTS_DIRTY}"


def blank(column: str) -> str:
    return f"({column} IS NULL OR {S(column)} = '')"


# --- Projections --------------------------------------------------------------------------


@query("canonical_products", f"WITH {v.PRODUCTS} SELECT * FROM products_v")
def canonical_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = v.products(spark, sf_dir).select(
        "row_id",
        F.col("product_name").alias("Name"),
        F.col("brand").alias(" Manufacturer "),
        F.col("price").alias("Discount-Price"),
        F.col("category").alias("main category"),
    )
    return canonical_projection(source, keep=["row_id"])


COMBINED = "coalesce(product_name, '') || ' ' || coalesce(description, '')"


@query("combine_text", f"{DIRTY} SELECT row_id, {S(COMBINED)} AS corpus FROM products_dirty_v")
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.products_dirty(spark, sf_dir)
    return rows.select("row_id", combine_text([F.col("product_name"), F.col("description")]).alias("corpus"))


@query(
    "resolve_text",
    f"""{DIRTY} SELECT row_id, nullif(concat_ws(' ', nullif({S('category')}, ''), nullif({S('product_name')}, ''),
        nullif({S('description')}, '')), '') AS request_text FROM products_dirty_v""",
)
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve_request_text(v.products_dirty(spark, sf_dir), ["category", "product_name", "description"])
    return rows.select("row_id", "request_text")


@query(
    "label_filter",
    f"{DIRTY} SELECT row_id, {S('category')} AS category FROM products_dirty_v WHERE NOT {blank('category')}",
)
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_labelled(v.products_dirty(spark, sf_dir), ["category"]).select("row_id", "category")


@query(
    "composite_label",
    """SELECT d.doc_id, d.lang || '|||' || CAST(l.toxic AS VARCHAR) AS label
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.load(spark, sf_dir, "documents").join(v.load(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", composite_label(F.col("lang"), F.col("toxic")).alias("label"))


@query(
    "split_label",
    """WITH named AS (SELECT doc_id, CASE source WHEN 'src0' THEN lang WHEN 'src1' THEN lang || '||| '
         ELSE lang || ' ||| ' || source || '|||x' END AS label FROM documents)
       SELECT doc_id, CASE WHEN strpos(label, '|||') = 0 THEN label ELSE trim(substr(label, 1, strpos(label, '|||') - 1)) END AS category,
         CASE WHEN strpos(label, '|||') > 0 THEN nullif(trim(substr(label, strpos(label, '|||') + 3)), '') END AS sub_category
       FROM named""",
)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    label = (
        F.when(source == "src0", lang)
        .when(source == "src1", F.concat(lang, F.lit("||| ")))
        .otherwise(F.concat(lang, F.lit(" ||| "), source, F.lit("|||x")))
    )
    parts = split_label(label)
    return v.load(spark, sf_dir, "documents").select(
        "doc_id", parts.getField("category").alias("category"), parts.getField("sub_category").alias("sub_category")
    )


@query("product_lookup", f"WITH {v.PRODUCTS} SELECT * FROM products_v WHERE row_id = 42")
def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(v.products(spark, sf_dir), "row_id", 42)


@query(
    "history_by_category",
    f"""WITH {v.PREDICTIONS} SELECT prediction_id, product_id, predicted_category, predicted_sub_category, confidence
        FROM preds_v WHERE predicted_category = 'purchase'""",
)
def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_by_category(v.predictions(spark, sf_dir), "purchase").drop("timestamp")


@query(
    "sample_n",
    """SELECT event_id, user_id FROM (SELECT * FROM events
         ORDER BY substr(md5(CAST(event_id AS VARCHAR) || '#42'), 1, 13) LIMIT 500)""",
)
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(v.load(spark, sf_dir, "events"), 500, "event_id", 42).select("event_id", "user_id")


# --- Quality ------------------------------------------------------------------------------


@query(
    "dq_missing_values",
    f"""{DIRTY} SELECT role, missing FROM (SELECT
          count(*) FILTER (product_name IS NULL) AS product_name, count(*) FILTER (description IS NULL) AS description,
          count(*) FILTER (brand IS NULL) AS brand, count(*) FILTER (price IS NULL) AS price,
          count(*) FILTER (category IS NULL) AS category FROM products_dirty_v)
        UNPIVOT (missing FOR role IN (product_name, description, brand, price, category))""",
)
def dq_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_values(v.products_dirty(spark, sf_dir), RULES)


DUPLICATES = """(SELECT count(*) - 1 AS extra FROM products_dirty_v
                 GROUP BY product_name, description, brand, price, category)"""


@query("dq_duplicate_count", f"{DIRTY} SELECT CAST(sum(extra) AS BIGINT) AS duplicate_row_count FROM {DUPLICATES}")
def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_count(v.products_dirty(spark, sf_dir), RULES)


@query(
    "dq_duplicate_rows",
    f"""{DIRTY} SELECT row_id, product_name, brand FROM (SELECT *, count(*) OVER (
          PARTITION BY product_name, description, brand, price, category) AS n FROM products_dirty_v)
        WHERE n > 1 ORDER BY row_id LIMIT 20""",
)
def dq_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.duplicate_rows(v.products_dirty(spark, sf_dir), RULES)
    return rows.select("row_id", "product_name", "brand")


@query("dq_blank_rows", f"{DIRTY} SELECT row_id FROM products_dirty_v WHERE {blank('description')}")
def dq_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blank_rows(v.products_dirty(spark, sf_dir), "description").select("row_id")


@query(
    "dq_sample_rows",
    f"{DIRTY} SELECT row_id FROM products_dirty_v WHERE {blank('category')} ORDER BY row_id LIMIT 20",
)
def dq_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.offending_rows(v.products_dirty(spark, sf_dir), RULES, "blank_category")


@query(
    "dq_invalid_category",
    f"""{DIRTY} SELECT row_id, category IS NULL OR lower({S('category')}) IN ({PLACEHOLDERS}) AS placeholder,
          coalesce(length({S('category')}) > 120 OR NOT regexp_matches({S('category')}, '[A-Za-z]'), true) AS misshapen,
          {INVALID} AS invalid FROM products_dirty_v""",
)
def dq_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.col("category")
    return v.products_dirty(spark, sf_dir).select(
        "row_id",
        quality.is_placeholder(category).alias("placeholder"),
        F.coalesce(quality.looks_wrong(category), F.lit(True)).alias("misshapen"),
        quality.invalid_category(category, RULES).alias("invalid"),
    )


@query(
    "dq_whitelist",
    f"""{DIRTY} SELECT row_id, category FROM products_dirty_v WHERE category IS NULL
        OR lower({S('category')}) NOT IN ('economy', 'standard', 'promo')""",
)
def dq_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.products_dirty(spark, sf_dir)
    return rows.filter(quality.invalid_category(F.col("category"), WHITELIST)).select("row_id", "category")


@query(
    "dq_invalid_values",
    f"""{DIRTY} SELECT DISTINCT {S('category')} AS value FROM products_dirty_v
        WHERE category IS NOT NULL AND {INVALID} ORDER BY value LIMIT 20""",
)
def dq_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.invalid_values(v.products_dirty(spark, sf_dir), RULES)


@query("parse_price", f"{DIRTY} SELECT row_id, {PRICE} AS parsed_price FROM products_dirty_v")
def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.products_dirty(spark, sf_dir).select("row_id", parse_price(F.col("price")).alias("parsed_price"))


@query(
    "dq_price_unparseable",
    f"""{DIRTY} SELECT count(*) FILTER (price IS NOT NULL AND {PRICE} IS NULL) AS unparseable_price_count
        FROM products_dirty_v""",
)
def dq_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_checks(v.products_dirty(spark, sf_dir), RULES).select("unparseable_price_count")


COUNTS = f"""counts_v AS (SELECT count(*) AS row_count,
  count(*) FILTER (product_name IS NULL) AS missing_product_name, count(*) FILTER (description IS NULL) AS missing_description,
  count(*) FILTER (brand IS NULL) AS missing_brand, count(*) FILTER (price IS NULL) AS missing_price,
  count(*) FILTER (category IS NULL) AS missing_category,
  count(*) FILTER ({blank('category')}) AS null_category_count, count(*) FILTER ({INVALID}) AS invalid_category_count,
  count(*) FILTER ({blank('description')}) AS empty_description_count,
  count(*) FILTER (price IS NOT NULL AND {PRICE} IS NULL) AS unparseable_price_count FROM products_dirty_v)"""
ERRORS = """concat_ws('; ', CASE WHEN null_category_count > 0 THEN 'null or empty categories' END,
  CASE WHEN invalid_category_count > 0 THEN 'invalid categories' END,
  CASE WHEN empty_description_count > 0 THEN 'empty descriptions' END,
  CASE WHEN unparseable_price_count > 0 THEN 'incorrect data types' END) AS errors,
  null_category_count + invalid_category_count + empty_description_count + unparseable_price_count = 0 AS is_valid"""


@query("dq_verdict", f"{DIRTY}, {COUNTS} SELECT *, {ERRORS} FROM counts_v")
def dq_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = quality.verdict(v.products_dirty(spark, sf_dir), RULES)
    return row.withColumn("errors", F.array_join("errors", "; "))


def sample_sql(condition: str) -> str:
    return f"""(SELECT coalesce(string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id), '') FROM
      (SELECT row_id FROM products_dirty_v WHERE {condition} ORDER BY row_id LIMIT 20))"""


@query(
    "dq_report",
    f"""{DIRTY}, {COUNTS} SELECT *, {ERRORS}, 5 AS column_count,
      (SELECT CAST(sum(extra) AS BIGINT) FROM {DUPLICATES}) AS duplicate_row_count,
      (SELECT string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) FROM (SELECT row_id FROM (SELECT *, count(*) OVER (
        PARTITION BY product_name, description, brand, price, category) AS n FROM products_dirty_v)
        WHERE n > 1 ORDER BY row_id LIMIT 20)) AS duplicate_rows,
      {sample_sql(blank('category'))} AS null_category_rows, {sample_sql(INVALID)} AS invalid_category_rows,
      {sample_sql(blank('description'))} AS empty_description_rows,
      (SELECT string_agg(value, ',' ORDER BY value) FROM (SELECT DISTINCT {S('category')} AS value FROM products_dirty_v
        WHERE category IS NOT NULL AND {INVALID} ORDER BY value LIMIT 20)) AS invalid_category_values
      FROM counts_v""",
)
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report; lists as text, without the fields that hold the time or only the schema."""
    report = quality.quality_report(v.products_dirty(spark, sf_dir), RULES)
    lists = [
        "duplicate_rows",
        "null_category_rows",
        "invalid_category_rows",
        "empty_description_rows",
        "invalid_category_values",
    ]
    return report.withColumns(
        {name: F.array_join(quoted(name).cast("array<string>"), ",") for name in lists}
        | {"errors": F.array_join("errors", "; ")}
    ).drop(
        "dataset",
        "generated_at",
        "columns",
        "column_roles",
        "missing_required_columns",
        "missing_values",
        "incorrect_data_types",
        "warnings",
    )


# --- Sources and sinks --------------------------------------------------------------------

@query(
    "scan_csv_nulls",
    """SELECT p_partkey AS row_id, CASE p_size WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'none'
         WHEN 5 THEN 'say "hi", twice' WHEN 7 THEN 'two' || chr(10) || 'lines, "quoted"' ELSE p_type END AS category,
         CASE WHEN p_size = 6 THEN NULL ELSE p_retailprice END AS price FROM part""",
)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table written as CSV with several spellings of missing, and scanned again."""
    size = F.col("p_size")
    source = v.load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.when(size == 1, "N/A")
        .when(size == 2, "None")
        .when(size == 3, "#NA")
        .when(size == 4, "none")
        .when(size == 5, 'say "hi", twice')
        .when(size == 7, 'two\nlines, "quoted"')
        .otherwise(F.col("p_type"))
        .alias("category"),
        F.when(size == 6, "nan").otherwise(F.col("p_retailprice").cast("string")).alias("price"),
    )
    path = write_csv(source, scratch_path(spark, "scan-csv"))
    return read_csv(spark, path, "row_id bigint, category string, price double")


@query("scan_csv_folder", "SELECT s_suppkey AS row_id, s_name AS name, 'supplier' AS file FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer")
def scan_csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers written as files of one folder, and the folder scanned."""
    path = scratch_path(spark, "scan-folder")
    for name, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        rows = v.load(spark, sf_dir, name)
        write_csv(rows.select(F.col(key).alias("row_id"), F.col(f"{name[0]}_name").alias("name"), F.lit(name).alias("file")), path, "append")
    return read_csv(spark, path, "row_id bigint, name string, file string")


@query(
    "scored_batch_append",
    """WITH p AS (SELECT p_partkey, p_name, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY p_partkey) AS n,
           count(*) FILTER (p_partkey % 2 = 0) OVER () AS first_rows FROM part)
       SELECT n + CASE WHEN p_partkey % 2 = 1 THEN first_rows ELSE 0 END AS prediction_id, p_name AS product_name, p_brand AS predicted_category,
         round(p_retailprice, 2)::DOUBLE AS price FROM p""",
)
def scored_batch_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored batches stored, the second twice; predictions joined to their products."""
    parts = v.load(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("product_name"), F.lit(None).cast("string").alias("description"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"), F.col("p_brand").alias("predicted_category"),
        F.lit(None).cast("string").alias("predicted_sub_category"), F.lit(0.5).alias("confidence"),
    )
    base = scratch_path(spark, "scored-batches")
    for number in (0, 1, 1):
        batch = parts.filter(F.col("p_partkey") % 2 == number)
        write_scored_batch(batch, number, F.col("p_partkey"), f"{base}/products", f"{base}/predictions")
    products = spark.read.parquet(f"{base}/products").select("id", "product_name", F.col("price").cast("double").alias("price"))
    predictions = spark.read.parquet(f"{base}/predictions").select("prediction_id", "product_id", "predicted_category")
    joined = predictions.join(products, F.col("product_id") == F.col("id"))
    return joined.select("prediction_id", "product_name", "predicted_category", "price")


@query(
    "sink_roundtrip",
    f"SELECT p_partkey AS row_id, p_name AS product_name, {v.sql_clean('p_name')} AS product_name_cleaned FROM part",
)
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned product names through the CSV sink and back."""
    rows = v.products(spark, sf_dir).select("row_id", "product_name")
    path = write_csv(clean_columns(rows, ["product_name"]), scratch_path(spark, "cleaned-csv"))
    return read_csv(spark, path, "row_id bigint, product_name string, product_name_cleaned string")


@query("report_roundtrip", f"{DIRTY}, {COUNTS} SELECT row_count, invalid_category_count, is_valid FROM (SELECT *, {ERRORS} FROM counts_v)")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports appended as JSON; the newest one is read back."""
    path = scratch_path(spark, "reports")
    first = quality.verdict(v.products(spark, sf_dir), RULES).withColumn("generated_at", F.lit("2024-01-01").cast("timestamp"))
    second = quality.verdict(v.products_dirty(spark, sf_dir), RULES).withColumn(
        "generated_at", F.lit("2024-01-02").cast("timestamp")
    )
    write_report(first, path)
    write_report(second, path)
    schema = T.StructType.fromDDL(
        "row_count bigint, invalid_category_count bigint, is_valid boolean, generated_at timestamp"
    )
    return latest_report(read_reports(spark, path, schema)).drop("generated_at")


@query(
    "json_payload_rows",
    """SELECT event_id, 0 AS position, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
         WHERE event_type <> 'error'
       UNION ALL SELECT event_id, 1, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'click'""",
)
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = T.StructType([T.StructField("k", T.LongType())])
    return payload_rows(payloads(spark, sf_dir), "payload", record, ["event_id"])


@query("rejected_payloads", "SELECT event_id, '\"' || user_id || '\"' AS payload FROM events WHERE event_type = 'error'")
def refused_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = T.StructType([T.StructField("k", T.LongType())])
    return rejected_payloads(payloads(spark, sf_dir), "payload", record)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as object, list and ``data`` payloads; errors carry a shape that is refused."""
    props, kind = F.col("props"), F.col("event_type")
    payload = (
        F.when(kind == "error", F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"')))
        .when(kind == "view", F.concat(F.lit('{"data": ['), props, F.lit("]}")))
        .when(kind == "signup", F.concat(F.lit('{"data": '), props, F.lit("}")))
        .when(kind == "click", F.concat(F.lit("["), props, F.lit(", "), props, F.lit("]")))
        .otherwise(props)
    )
    return v.load(spark, sf_dir, "events").select("event_id", payload.alias("payload"))


@query(
    "products_append",
    """WITH base AS (SELECT s_suppkey + 1 AS id, s_name AS product_name, CAST(NULL AS VARCHAR) AS description,
         CAST(NULL AS VARCHAR) AS brand, s_acctbal AS price FROM supplier),
       added AS (SELECT row_number() OVER (ORDER BY p_partkey) + (SELECT max(id) FROM base) AS id, p_name AS product_name,
         p_type AS description, p_brand AS brand, p_retailprice AS price FROM part)
       SELECT * FROM base UNION ALL SELECT * FROM added""",
)
def products_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for stored products; the parts are appended with the ids that follow."""
    path = scratch_path(spark, "products")
    base = v.load(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1).alias("id"),
        F.col("s_name").alias("product_name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("brand"),
        F.col("s_acctbal").cast("decimal(12,2)").alias("price"),
        F.current_timestamp().alias("created_at"),
    )
    append(base, path)
    stored = read_table(spark, path, PRODUCTS_SCHEMA)
    highest = stored.agg(F.max("id").alias("m")).first()["m"]
    parts = v.load(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
    )
    append(new_products(parts, F.col("p_partkey"), highest), path)
    return read_table(spark, path, PRODUCTS_SCHEMA).select(
        "id", "product_name", "description", "brand", F.col("price").cast("double").alias("price")
    )


@query(
    "predictions_fk_violations",
    f"""WITH {v.PREDICTIONS}, known AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0)
        SELECT prediction_id, product_id, 'product' AS violation FROM preds_v
          WHERE product_id NOT IN (SELECT id FROM known)
        UNION ALL SELECT event_id, user_id, 'confidence' FROM events WHERE value / 400 > 1""",
)
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of products that do not exist, and confidences outside 0..1."""
    known = v.product_table(spark, sf_dir).filter(F.col("price") >= 0)
    orphans = missing_products(v.predictions(spark, sf_dir), known)
    raw = v.load(spark, sf_dir, "events").select(
        F.col("event_id").alias("prediction_id"), F.col("user_id").alias("product_id"), (F.col("value") / 400).alias("c")
    )
    outside = confidence_violations(raw, "c")
    keys = ["prediction_id", "product_id"]
    return orphans.select(*keys, F.lit("product").alias("violation")).unionByName(
        outside.select(*keys, F.lit("confidence").alias("violation"))
    )


@query(
    "models_upsert",
    """WITH base AS (SELECT o_custkey AS c, max(o_totalprice) AS a, min(o_orderdate) AS t FROM orders
         WHERE o_orderstatus = 'F' GROUP BY o_custkey),
       upd AS (SELECT o_custkey AS c, max(o_totalprice) AS a, min(o_orderdate) AS t FROM orders
         WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
       SELECT CAST(coalesce(b.c, u.c) AS VARCHAR) AS version, CASE WHEN u.c IS NOT NULL THEN u.a ELSE b.a END AS accuracy,
         strftime(CASE WHEN b.c IS NOT NULL THEN b.t ELSE u.t END, '%Y-%m-%d') AS created_at
       FROM base b FULL JOIN upd u ON b.c = u.c""",
)
def models_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders stand for stored versions, all others for the update, one version per customer."""

    def versions(finished: bool) -> DataFrame:
        return (
            v.load(spark, sf_dir, "orders")
            .filter((F.col("o_orderstatus") == "F") == F.lit(finished))
            .groupBy(F.col("o_custkey").cast("string").alias("version"))
            .agg(F.max("o_totalprice").alias("accuracy"), F.min("o_orderdate").alias("created_at"))
        )

    merged = upsert_models(versions(True), versions(False))
    return merged.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))
