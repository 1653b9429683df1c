"""Projections, filters and lookups on product and prediction rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import (
    hash_position,
    is_blank,
    null_if_nan,
    quoted,
    resolve_roles,
    resolve_text_columns,
    strip,
)
from wattshelf.functions.text import clean_text, composite_label, split_label
from wattshelf.operators.ranks import values_at_ranks


def canonical_projection(
    df: DataFrame,
    roles: Mapping[str, str | None] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One column per role under its canonical name; a role without a column is null."""
    roles = roles or resolve_roles(df.columns)
    picked = [
        (quoted(actual) if actual is not None else F.lit(None).cast("string")).alias(role)
        for role, actual in roles.items()
    ]
    return df.select(*[quoted(name) for name in keep], *picked)


def combine_text(columns: Sequence[Column]) -> Column:
    """Columns joined by a space, null as empty, outer space removed."""
    return strip(F.concat_ws(" ", *[F.coalesce(column, F.lit("")) for column in columns]))


def clean_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    suffix: str = "_cleaned",
    **options: object,
) -> DataFrame:
    """Add ``<column>_cleaned`` for the given or discovered text columns."""
    chosen = resolve_text_columns(df.columns, columns)
    return df.withColumns({name + suffix: clean_text(quoted(name), **options) for name in chosen})


def add_corpus(df: DataFrame, columns: Sequence[str] | None = None, corpus: str = "corpus") -> DataFrame:
    """Cleaned text columns combined into one corpus column."""
    chosen = resolve_text_columns(df.columns, columns)
    return df.withColumn(corpus, combine_text([clean_text(quoted(name)) for name in chosen]))


def resolve_request_text(
    df: DataFrame,
    parts: Sequence[str] = ("text", "product_name", "description"),
    output: str = "request_text",
) -> DataFrame:
    """Join the non-blank parts of a request; null where every part is blank."""
    trimmed = [strip(quoted(part)) for part in parts]
    joined = F.concat_ws(" ", *[F.when(part != "", part) for part in trimmed])
    return df.withColumn(output, F.when(joined != "", joined))


def keep_labelled(df: DataFrame, label_columns: Sequence[str]) -> DataFrame:
    """Trim the labels and drop rows where one is null or blank."""
    trimmed = df.withColumns({name: strip(quoted(name).cast("string")) for name in label_columns})
    for name in label_columns:
        trimmed = trimmed.filter(quoted(name).isNotNull() & (quoted(name) != ""))
    return trimmed


def add_composite_label(
    df: DataFrame, category: str, sub_category: str | None = None, output: str = "label"
) -> DataFrame:
    sub = quoted(sub_category) if sub_category else None
    return df.withColumn(output, composite_label(quoted(category), sub))


def add_label_parts(
    df: DataFrame,
    label: str,
    category: str = "category",
    sub_category: str = "sub_category",
) -> DataFrame:
    parts = split_label(quoted(label))
    return df.withColumns(
        {category: parts.getField("category"), sub_category: parts.getField("sub_category")}
    )


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows with one key value; the comparison reaches the scan."""
    return df.filter(quoted(key) == F.lit(value))


def history_by_category(df: DataFrame, category: str = "All", column: str = "predicted_category") -> DataFrame:
    return df if category == "All" else df.filter(quoted(column) == category)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in seeded hash order of a unique key; every row when there are no more.

    The cut position is found from histograms, so nothing is sorted, shuffled or collected.
    """
    placed = df.withColumn("_position", hash_position(quoted(key), seed))
    cut = values_at_ranks(placed, {"_position": [n]})["_position"][0]
    if cut is not None:
        placed = placed.filter(F.col("_position") < F.lit(cut))
    return placed.drop("_position")


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null or NaN in any (chosen) column."""
    whole = F.lit(True)
    for field in df.schema.fields:
        if columns is None or field.name in columns:
            value = quoted(field.name)
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                value = null_if_nan(value)
            whole = whole & value.isNotNull()
    return df.filter(whole)


def blank_rows(df: DataFrame, column: str | None) -> DataFrame:
    """Rows whose value is null or blank; all rows when the role has no column."""
    return df if column is None else df.filter(is_blank(quoted(column).cast("string")))
