"""Column names: normalising, finding roles, missing-value helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.fixed_values import (
    CATEGORY_CANDIDATES,
    CSV_NULL_TOKENS,
    PRODUCT_ROLES,
    ROLE_ALIASES,
    SUB_CATEGORY_CANDIDATES,
    TEXT_COLUMN_CANDIDATES,
)

# Unicode white space plus the four ASCII separators that Python also strips.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"


def normalise_name(name: object) -> str:
    """Lower-case words of ``[a-z0-9]`` joined by single underscores."""
    return "_".join(re.findall(r"[a-z0-9]+", str(name).casefold()))


def quoted(name: str) -> Column:
    """A column by its exact name, dots and brackets included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _by_normalised_name(columns: Iterable[str]) -> dict[str, str]:
    return {normalise_name(column): column for column in columns}


def resolve_roles(
    columns: Sequence[str],
    roles: Sequence[str] = PRODUCT_ROLES,
    aliases: Mapping[str, Sequence[str]] = ROLE_ALIASES,
) -> dict[str, str | None]:
    """Role -> first alias present among ``columns`` (metadata only); the same column may serve twice."""
    present = _by_normalised_name(columns)
    found: dict[str, str | None] = {}
    for role in roles:
        names = map(normalise_name, aliases.get(role, (role,)))
        found[role] = next((present[name] for name in names if name in present), None)
    return found


def resolve_text_columns(
    columns: Sequence[str],
    chosen: Sequence[str] | None = None,
    candidates: Sequence[str] = TEXT_COLUMN_CANDIDATES,
) -> tuple[str, ...]:
    """The named columns, or every candidate present; an error when there is none."""
    if chosen is not None:
        absent = [column for column in chosen if column not in columns]
        if absent:
            raise ValueError(f"text columns not in the frame: {absent}")
        return tuple(chosen)
    present = _by_normalised_name(columns)
    names = (normalise_name(candidate) for candidate in candidates)
    resolved = tuple(dict.fromkeys(present[name] for name in names if name in present))
    if not resolved:
        raise ValueError(f"no text column; expected one of {list(candidates)}")
    return resolved


def resolve_label_columns(
    columns: Sequence[str],
    category: str | None = None,
    sub_category: str | None = None,
) -> tuple[str, str | None]:
    """The category column (required) and the sub-category column (optional)."""
    present = _by_normalised_name(columns)

    def pick(named: str | None, candidates: Sequence[str]) -> str | None:
        if named is not None:
            if named not in columns:
                raise ValueError(f"label column not in the frame: {named}")
            return named
        return next((present[c] for c in map(normalise_name, candidates) if c in present), None)

    main = pick(category, CATEGORY_CANDIDATES)
    if main is None:
        raise ValueError(f"no category column; expected one of {list(CATEGORY_CANDIDATES)}")
    return main, pick(sub_category, SUB_CATEGORY_CANDIDATES)


def strip(column: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(column, f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(column: Column) -> Column:
    return column.isNull() | column.rlike(f"(?U)^{SPACE}*$")


def null_if_nan(column: Column) -> Column:
    """NaN counts as missing everywhere; Spark would order it above every number."""
    return F.when(~F.isnan(column), column)


def finite(column: Column) -> Column:
    """The value as double, or null when it is missing, NaN or infinite."""
    number = column.cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {
        field.name: null_if_nan(quoted(field.name))
        for field in df.schema.fields
        if isinstance(field.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def null_tokens_to_null(df: DataFrame, tokens: Sequence[str] = CSV_NULL_TOKENS) -> DataFrame:
    """Read the usual CSV spellings of "missing" as null in every string column."""
    texts = {
        field.name: F.when(~quoted(field.name).isin(*tokens), quoted(field.name))
        for field in df.schema.fields
        if isinstance(field.dataType, T.StringType)
    }
    return df.withColumns(texts) if texts else df


def row_digest(columns: Sequence[Column]) -> Column:
    """md5 of a row in a form where null, empty and separators stay distinct."""
    parts = [
        F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        for text in (column.cast("string") for column in columns)
    ]
    return F.md5(F.concat_ws("|", *parts))


def hash_position(key: Column, seed: int) -> Column:
    """A seeded, engine-neutral position in ``[0, 2**52)`` for a row key, exact as a double."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
