"""Product data quality: row rules as columns, one aggregate pass, bounded samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import is_blank, normalise_name, quoted, resolve_roles, row_digest, strip
from wattshelf.functions.fixed_values import (
    MAX_CATEGORY_LENGTH,
    MAX_SAMPLE_ROWS,
    PLACEHOLDER_CATEGORIES,
    PRODUCT_ROLES,
    ROLE_ALIASES,
)
from wattshelf.functions.money import parse_price

TEXT_ROLES = ("product_name", "description", "brand", "category")


@dataclass(frozen=True)
class QualityRules:
    """What a product table must satisfy; ``row_id`` identifies rows and is not product data."""

    row_id: str
    roles: tuple[str, ...] = PRODUCT_ROLES
    aliases: Mapping[str, Sequence[str]] = field(default_factory=lambda: ROLE_ALIASES)
    allowed_categories: tuple[str, ...] | None = None
    placeholders: tuple[str, ...] = PLACEHOLDER_CATEGORIES
    max_sample_rows: int = MAX_SAMPLE_ROWS


def physical_columns(df: DataFrame, rules: QualityRules) -> list[str]:
    return [name for name in df.columns if name != rules.row_id]


def role_columns(df: DataFrame, rules: QualityRules) -> dict[str, str | None]:
    return resolve_roles(physical_columns(df, rules), rules.roles, rules.aliases)


def is_placeholder(category: Column, placeholders: Sequence[str] = PLACEHOLDER_CATEGORIES) -> Column:
    """A missing category, or one of the texts that stand for missing."""
    return category.isNull() | F.lower(strip(category)).isin(*placeholders)


def outside_whitelist(category: Column, allowed: Sequence[str]) -> Column:
    names = sorted({name.casefold().strip() for name in allowed})
    return category.isNull() | ~F.lower(strip(category)).isin(*names)


def looks_wrong(category: Column) -> Column:
    """No letter at all, or longer than a category can be."""
    trimmed = strip(category)
    return (F.length(trimmed) > MAX_CATEGORY_LENGTH) | ~trimmed.rlike("[A-Za-z]")


def invalid_category(category: Column, rules: QualityRules) -> Column:
    bad = is_placeholder(category, rules.placeholders)
    if rules.allowed_categories is not None:
        return bad | outside_whitelist(category, rules.allowed_categories)
    return bad | looks_wrong(category)


def row_flags(df: DataFrame, rules: QualityRules) -> dict[str, Column]:
    """Row-level rules as boolean columns, shared by the batch report and the stream."""
    roles = role_columns(df, rules)
    everywhere = F.lit(True)

    def text(role: str) -> Column | None:
        actual = roles.get(role)
        return quoted(actual).cast("string") if actual is not None else None

    category, description = text("category"), text("description")
    price = roles.get("price")
    return {
        "blank_category": everywhere if category is None else is_blank(category),
        "invalid_category": everywhere if category is None else invalid_category(category, rules),
        "blank_description": everywhere if description is None else is_blank(description),
        "bad_price": F.lit(False)
        if price is None or isinstance(df.schema[price].dataType, T.NumericType)
        else quoted(price).isNotNull() & parse_price(quoted(price).cast("string")).isNull(),
    }


def with_row_flags(df: DataFrame, rules: QualityRules) -> DataFrame:
    return df.withColumns(row_flags(df, rules))


def _missing_counts(df: DataFrame, rules: QualityRules) -> dict[str, Column]:
    every_row = F.count(F.lit(1))
    return {
        role: every_row if actual is None else F.count_if(quoted(actual).isNull())
        for role, actual in role_columns(df, rules).items()
    }


def missing_values(df: DataFrame, rules: QualityRules) -> DataFrame:
    """(role, missing) rows from one pass."""
    counts = _missing_counts(df, rules)
    one_row = df.agg(*[count.alias(role) for role, count in counts.items()])
    return one_row.select(
        F.explode(
            F.array(*[F.struct(F.lit(role).alias("role"), F.col(role).alias("missing")) for role in counts])
        ).alias("m")
    ).select("m.*")


def _duplicate_groups(df: DataFrame, rules: QualityRules) -> DataFrame:
    """Copies per distinct row. Null equals null; the digest keeps the shuffled key short,
    and counting before the shuffle keeps a much-copied row from landing in one task."""
    digest = row_digest([quoted(name) for name in physical_columns(df, rules)])
    return df.select(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))


def duplicate_count(df: DataFrame, rules: QualityRules) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    groups = _duplicate_groups(df, rules)
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_row_count"))


def duplicate_rows(df: DataFrame, rules: QualityRules) -> DataFrame:
    """The first rows (by row id) that have a copy, the original included."""
    digest = row_digest([quoted(name) for name in physical_columns(df, rules)])
    repeated = _duplicate_groups(df, rules).filter(F.col("copies") > 1).select("digest")
    members = df.withColumn("digest", digest).join(repeated, "digest", "left_semi").drop("digest")
    return members.orderBy(quoted(rules.row_id)).limit(rules.max_sample_rows)


def offending_rows(df: DataFrame, rules: QualityRules, flag: str) -> DataFrame:
    """The first rows (by row id) with one flag set."""
    return (
        df.filter(row_flags(df, rules)[flag])
        .select(quoted(rules.row_id))
        .orderBy(quoted(rules.row_id))
        .limit(rules.max_sample_rows)
    )


def invalid_values(df: DataFrame, rules: QualityRules) -> DataFrame:
    """Distinct invalid category texts, sorted, up to the sample size."""
    actual = role_columns(df, rules)["category"]
    if actual is None:
        return df.select(F.lit(None).cast("string").alias("value")).limit(0)
    category = quoted(actual).cast("string")
    return (
        df.filter(invalid_category(category, rules) & category.isNotNull())
        .select(strip(category).alias("value"))
        .distinct()
        .orderBy("value")
        .limit(rules.max_sample_rows)
    )


def wrong_text_types(df: DataFrame, rules: QualityRules) -> dict[str, str]:
    """Text roles held by a non-text column (schema only)."""
    roles = role_columns(df, rules)
    return {
        role: f"expected text, found {df.schema[actual].dataType.simpleString()}"
        for role in TEXT_ROLES
        if (actual := roles.get(role)) is not None
        and not isinstance(df.schema[actual].dataType, T.StringType)
    }


def alias_warnings(df: DataFrame, rules: QualityRules) -> list[str]:
    warnings = [
        f"column '{actual}' is used as '{role}'"
        for role, actual in role_columns(df, rules).items()
        if actual is not None and normalise_name(actual) != normalise_name(role)
    ]
    if rules.allowed_categories is None:
        warnings.append("no allowed categories given: categories are checked by placeholder and shape")
    return warnings


def count_checks(df: DataFrame, rules: QualityRules) -> DataFrame:
    """One row with every count of the report that needs no shuffle of rows."""
    flags = row_flags(df, rules)
    missing = _missing_counts(df, rules)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[count.alias(f"missing_{role}") for role, count in missing.items()],
        F.count_if(flags["blank_category"]).alias("null_category_count"),
        F.count_if(flags["invalid_category"]).alias("invalid_category_count"),
        F.count_if(flags["blank_description"]).alias("empty_description_count"),
        F.count_if(flags["bad_price"]).alias("unparseable_price_count"),
    )


def with_verdict(counts: DataFrame, missing_roles: Sequence[str], wrong_types: Mapping[str, str]) -> DataFrame:
    """Errors and validity from a row of counts. Duplicates are reported but never invalidate."""
    problems = [
        (F.lit(bool(missing_roles)), "missing required columns: " + ", ".join(missing_roles)),
        (F.col("null_category_count") > 0, "null or empty categories"),
        (F.col("invalid_category_count") > 0, "invalid categories"),
        (F.col("empty_description_count") > 0, "empty descriptions"),
        (F.lit(bool(wrong_types)) | (F.col("unparseable_price_count") > 0), "incorrect data types"),
    ]
    errors = F.filter(
        F.array(*[F.when(found, F.lit(message)) for found, message in problems]),
        lambda message: message.isNotNull(),
    )
    return counts.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def verdict(df: DataFrame, rules: QualityRules) -> DataFrame:
    absent = [role for role, actual in role_columns(df, rules).items() if actual is None]
    return with_verdict(count_checks(df, rules), absent, wrong_text_types(df, rules))


def offending_samples(df: DataFrame, rules: QualityRules) -> DataFrame:
    """One row with the first row ids of every check, from a single pass.

    The rank filter is applied inside each task before the shuffle, so a check that most rows
    fail still sends only its first few.
    """
    flags = row_flags(df, rules)
    failed = F.filter(
        F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]), lambda name: name.isNotNull()
    )
    row_id = quoted(rules.row_id).cast("bigint").alias("row_id")
    first = Window.partitionBy("check").orderBy("row_id")
    ranked = (
        df.select(row_id, F.explode(failed).alias("check"))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= rules.max_sample_rows)
    )
    return ranked.agg(
        *[F.sort_array(F.collect_list(F.when(F.col("check") == name, F.col("row_id")))).alias(name) for name in flags]
    )


def quality_report(df: DataFrame, rules: QualityRules, dataset: str | None = None) -> DataFrame:
    """The whole check as one row: counts, bounded samples, messages and the verdict.

    One pass for the counts, one for the samples; the parts meet as scalar subqueries.
    """
    roles = role_columns(df, rules)
    absent = [role for role, actual in roles.items() if actual is None]
    wrong = wrong_text_types(df, rules)
    samples = offending_samples(df, rules).select(
        F.struct(
            F.col("blank_category").alias("null_category_rows"),
            F.col("invalid_category").alias("invalid_category_rows"),
            F.col("blank_description").alias("empty_description_rows"),
        )
    )
    copies = duplicate_rows(df, rules).agg(F.sort_array(F.collect_list(quoted(rules.row_id).cast("bigint"))))
    values = invalid_values(df, rules).agg(F.sort_array(F.collect_list("value")))
    report = (
        verdict(df, rules)
        .select(
            "*",
            duplicate_count(df, rules).scalar().alias("duplicate_row_count"),
            copies.scalar().alias("duplicate_rows"),
            samples.scalar().alias("_samples"),
            values.scalar().alias("invalid_category_values"),
        )
        .select("*", "_samples.*")
        .drop("_samples")
    )
    types = [F.create_map(F.lit(role), F.lit(text)) for role, text in wrong.items()]
    price_issue = F.when(
        F.col("unparseable_price_count") > 0,
        F.create_map(
            F.lit("price"),
            F.concat(F.col("unparseable_price_count").cast("string"), F.lit(" values are not prices")),
        ),
    )
    empty = F.create_map().cast("map<string,string>")
    return report.withColumns(
        {
            "dataset": F.lit(dataset).cast("string"),
            "generated_at": F.current_timestamp(),
            "columns": F.array(*[F.lit(name) for name in physical_columns(df, rules)]),
            "column_count": F.lit(len(physical_columns(df, rules))),
            "column_roles": F.create_map(
                *[cell for role, actual in roles.items() for cell in (F.lit(role), F.lit(actual).cast("string"))]
            ),
            "missing_required_columns": F.array(*[F.lit(role) for role in absent]).cast("array<string>"),
            "missing_values": F.create_map(
                *[cell for role in roles for cell in (F.lit(role), F.col(f"missing_{role}"))]
            ),
            "incorrect_data_types": F.map_concat(empty, *types, F.coalesce(price_issue, empty)),
            "warnings": F.array(*[F.lit(text) for text in alias_warnings(df, rules)]).cast("array<string>"),
        }
    )
