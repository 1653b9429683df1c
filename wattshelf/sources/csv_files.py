"""CSV files and folders: scans with missing-value spellings, cleaned output, export."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import null_tokens_to_null, quoted
from wattshelf.operators.projection import clean_columns


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    separator: str = ",",
    multi_line: bool = True,
    infer: bool = False,
) -> DataFrame:
    """A CSV file or a folder of them, header first, usual spellings of missing read as null.

    Without a schema every column is text, or typed by a scan with ``infer``. Line breaks inside quotes
    belong to their value; for that a file is read by one task, so large inputs should come as many files
    or as Parquet. ``multi_line=False`` splits files for data known to have a record on each line.
    """
    if PurePosixPath(path).suffix.lower() not in (".csv", ""):
        raise ValueError(f"not a CSV file or folder: {path}")
    reader = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("inferSchema", infer and schema is None)
    )
    if schema is not None:
        # Typed columns go through text, so that every spelling of missing is known.
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        texts = T.StructType([T.StructField(field.name, T.StringType()) for field in wanted.fields])
        cells = null_tokens_to_null(reader.schema(texts).csv(path))
        return cells.select(
            *[quoted(field.name).try_cast(field.dataType).alias(field.name) for field in wanted.fields]
        )
    return null_tokens_to_null(reader.csv(path))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Unique row ids that grow in file order, for files without a key of their own."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def processed_path(input_path: str, output_dir: str) -> str:
    return f"{output_dir.rstrip('/')}/{PurePosixPath(input_path).stem}_processed.csv"


def clean_csv(
    spark: SparkSession, input_path: str, output_dir: str, columns: list[str] | None = None, multi_line: bool = True
) -> str:
    """Read a CSV, add cleaned text columns, write ``<stem>_processed.csv``."""
    cleaned = clean_columns(read_csv(spark, input_path, multi_line=multi_line), columns)
    return write_csv(cleaned, processed_path(input_path, output_dir))
