"""JSON request payloads and JSON reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import quoted


def payload_records(payload: Column, record: T.StructType) -> Column:
    """The records of an object, a list of objects or ``{"data": ...}``; null for other shapes."""
    text = F.trim(payload)
    body = F.coalesce(F.when(text.startswith("{"), F.get_json_object(text, "$.data")), text)
    listed = F.when(body.startswith("["), F.from_json(body, T.ArrayType(record)))
    single = F.when(body.startswith("{"), F.array(F.from_json(body, record)))
    return F.coalesce(listed, single)


def payload_rows(df: DataFrame, payload: str, record: T.StructType, keep: list[str]) -> DataFrame:
    """One row per record; payloads of another shape give no row (see ``rejected_payloads``)."""
    spread = df.select(*[quoted(name) for name in keep], F.posexplode_outer(payload_records(quoted(payload), record)))
    return spread.filter(F.col("col").isNotNull()).select(*keep, F.col("pos").alias("position"), "col.*")


def rejected_payloads(df: DataFrame, payload: str, record: T.StructType) -> DataFrame:
    return df.filter(payload_records(quoted(payload), record).isNull())


def require_payloads(df: DataFrame, payload: str, record: T.StructType) -> DataFrame:
    """Fail the job on a payload that is no object, list of objects or ``{"data": ...}``."""
    records = payload_records(quoted(payload), record)
    return df.withColumn(
        "records", F.when(records.isNotNull(), records).otherwise(F.raise_error(F.lit("unsupported payload shape")))
    )


def variant_records(df: DataFrame, payload: str, paths: Mapping[str, tuple[str, str]], keep: Sequence[str], wrappers: Sequence[str] = ("$.data",)) -> DataFrame:
    """One row per record of payloads of any shape: keep, position, shape, and a column per (path, type).

    A payload is parsed once into a variant. The records are what the first of ``wrappers`` that is there holds, else
    the payload; a list gives a row per element, an object one. Missing paths and values of another type are null; broken JSON,
    and payloads that are neither list nor object, give no row.
    """
    parsed = df.select(*[quoted(k) for k in keep], F.try_parse_json(quoted(payload)).alias("_v"))
    body = F.coalesce(*[F.try_variant_get("_v", wrapper, "variant") for wrapper in wrappers], F.col("_v"))
    opened = parsed.withColumn("_body", body).withColumn("_shape", F.schema_of_variant("_body"))
    is_list, is_object = F.col("_shape").startswith("ARRAY"), F.col("_shape").startswith("OBJECT")
    records = F.when(is_list, F.try_variant_get("_body", "$", "array<variant>")).when(is_object, F.array("_body"))
    rows = opened.select(*[quoted(k) for k in keep], F.when(is_list, "list").otherwise("object").alias("shape"), F.posexplode(records).alias("position", "_record"))
    return rows.select(
        *[quoted(k) for k in keep], "position", "shape", *[F.try_variant_get("_record", path, kind).alias(name) for name, (path, kind) in paths.items()]
    )


def write_report(report: DataFrame, path: str) -> str:
    """Append one-row reports as JSON lines."""
    report.write.mode("append").json(path)
    return path


def read_reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All readable reports; broken lines are left out."""
    with_marker = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    lines = spark.read.text(path).select(F.from_json("value", with_marker, options).alias("r"))
    return lines.filter(F.col("r").isNotNull() & F.col("r._broken").isNull()).select("r.*").drop("_broken")


def latest_report(reports: DataFrame, time: str = "generated_at") -> DataFrame:
    whole = F.struct(*[quoted(name) for name in reports.columns])
    return reports.agg(F.max_by(whole, quoted(time)).alias("r")).filter(F.col("r").isNotNull()).select("r.*")
