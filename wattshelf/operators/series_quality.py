"""Meter-series data quality: counts in one pass, grid checks without sorting."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import null_if_nan, quoted, row_digest
from wattshelf.functions.fixed_values import (
    MAX_SAMPLE_ROWS,
    SERIES_CATEGORICAL,
    SERIES_NUMERIC,
    SERIES_STEP_SECONDS,
    SERIES_TARGET,
    SERIES_TIME,
)
from wattshelf.functions.series import micros, parse_timestamp
from wattshelf.operators.ranks import windowed_in_blocks

MICROS = 1_000_000


class SeriesQualityError(ValueError):
    """The series breaks at least one rule."""


@dataclass(frozen=True)
class SeriesRules:
    """Required columns and allowed values of a meter series. With no ``series`` the table is one series."""

    time: str = SERIES_TIME
    target: str = SERIES_TARGET
    numeric: tuple[str, ...] = SERIES_NUMERIC
    categorical: tuple[str, ...] = SERIES_CATEGORICAL
    series: tuple[str, ...] = ()
    allowed: Mapping[str, Iterable[str]] = field(default_factory=dict)
    step_seconds: int = SERIES_STEP_SECONDS
    require_step: bool = True

    @property
    def required(self) -> list[str]:
        return list(dict.fromkeys([self.time, *self.numeric, *self.categorical, *self.series]))


def timestamp_of(df: DataFrame, column: str) -> Column:
    """The column as a timestamp: text goes through the day-first parser."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return parse_timestamp(quoted(column))
    return quoted(column)


def numeric_of(df: DataFrame, column: str) -> Column:
    """The column as double; text that is no number and NaN are null."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return null_if_nan(quoted(column).cast("double"))
    return null_if_nan(quoted(column).cast("string").try_cast("double"))


def numeric_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, non_numeric, infinite) counts, one pass for every column."""
    infinity = F.lit(float("inf"))
    aggregates = []
    for i, name in enumerate(columns):
        value = numeric_of(df, name)
        aggregates += [
            F.count_if(value.isNull()).alias(f"bad{i}"),
            F.count_if(F.abs(value) == infinity).alias(f"inf{i}"),
        ]
    return df.agg(*aggregates).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column"),
                        F.col(f"bad{i}").alias("non_numeric"),
                        F.col(f"inf{i}").alias("infinite"),
                    )
                    for i, name in enumerate(columns)
                ]
            )
        ).alias("c")
    ).select("c.*")


def slots(df: DataFrame, ts: Column, series: Sequence[str] = ()) -> DataFrame:
    """Rows per (series, timestamp); counted before the shuffle, so a repeated slot is cheap."""
    keys = [quoted(name).alias(name) for name in series]
    return df.select(*keys, micros(ts).alias("at_us")).groupBy(*series, "at_us").agg(F.count(F.lit(1)).alias("rows"))


def duplicate_timestamps(df: DataFrame, ts: Column, series: Sequence[str] = ()) -> DataFrame:
    """Invalid dates and repeated timestamps per series; unparseable dates repeat one another."""
    return (
        slots(df, ts, series)
        .groupBy(*series)
        .agg(
            F.coalesce(F.sum(F.when(F.col("at_us").isNull(), F.col("rows"))), F.lit(0)).alias("invalid_dates"),
            F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_timestamps"),
        )
    )


def frequency_check(
    df: DataFrame, ts: Column, series: Sequence[str] = (), step_seconds: int = SERIES_STEP_SECONDS
) -> DataFrame:
    """Per series: does every slot of an uninterrupted fixed step occur exactly once?

    No repeats, one phase within the step, and ``n - 1`` steps between the ends hold together
    exactly when every consecutive difference equals the step - with no ordering needed.
    """
    step = step_seconds * MICROS
    known = slots(df, ts, series).filter(F.col("at_us").isNotNull())
    phase = F.pmod(F.col("at_us"), F.lit(step))
    return (
        known.groupBy(*series)
        .agg(
            F.sum("rows").alias("row_count"),
            F.count(F.lit(1)).alias("slot_count"),
            F.min("at_us").alias("first_at"),
            F.max("at_us").alias("last_at"),
            F.min(phase).alias("phase_low"),
            F.max(phase).alias("phase_high"),
        )
        .withColumn(
            "regular",
            (F.col("row_count") == F.col("slot_count"))
            & (F.col("phase_low") == F.col("phase_high"))
            & (F.col("last_at") - F.col("first_at") == (F.col("slot_count") - 1) * F.lit(step)),
        )
        .drop("phase_low", "phase_high")
    )


def gaps(
    df: DataFrame,
    ts: Column,
    series: Sequence[str] = (),
    step_seconds: int = SERIES_STEP_SECONDS,
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Consecutive timestamps of a series that are not one step apart."""
    keys = [quoted(name).alias(name) for name in series]
    placed = df.select(*keys, micros(ts).alias("at_us")).filter(F.col("at_us").isNotNull())
    # Repeated timestamps stay: a zero difference breaks the rule as well.
    numbered = windowed_in_blocks(
        placed,
        F.col("at_us"),
        1,
        lambda window: {"previous_us": F.lag("at_us").over(window)},
        series=series,
        rows_per_block=rows_per_block,
    )
    difference = F.col("at_us") - F.col("previous_us")
    return numbered.filter(difference != F.lit(step_seconds * MICROS)).withColumn(
        "gap_seconds", difference / F.lit(float(MICROS))
    )


def domain_violations(df: DataFrame, allowed: Mapping[str, Iterable[str]]) -> DataFrame:
    """(column, value) pairs that occur but are not allowed; missing values are ignored."""
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("column"), quoted(name).cast("string").alias("value"))
                    for name in allowed
                ]
            )
        ).alias("c")
    ).select("c.*")
    observed = cells.filter(F.col("value").isNotNull()).distinct()
    pairs = [(name, str(value)) for name, values in allowed.items() for value in sorted(values)]
    permitted = df.sparkSession.createDataFrame(pairs, "column string, value string")
    return observed.join(permitted, ["column", "value"], "left_anti")


def domain_summary(df: DataFrame, allowed: Mapping[str, Iterable[str]], shown: int = MAX_SAMPLE_ROWS) -> DataFrame:
    """(column, values, sample) per column with foreign values: how many different ones, and the first few.

    All columns are read in one scan; ``domain_violations`` has the whole list as rows.
    """
    outside = domain_violations(df, allowed)
    order = Window.partitionBy("column").orderBy("value")
    counts = outside.groupBy("column").agg(F.count(F.lit(1)).alias("values"))
    first = (
        outside.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= shown)
        .groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("sample"))
    )
    return counts.join(first, "column")


def series_report(df: DataFrame, rules: SeriesRules) -> DataFrame:
    """One row of counts for every rule of the series (all columns required to be present)."""
    ts = timestamp_of(df, rules.time)
    required = [quoted(name) for name in rules.required]
    missing = [
        F.count_if(null_if_nan(quoted(name)).isNull())
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
        else F.count_if(quoted(name).isNull())
        for name in rules.required
    ]
    infinity = F.lit(float("inf"))
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        sum(missing[1:], missing[0]).alias("missing_values"),
        F.count_if(ts.isNull()).alias("invalid_dates"),
        F.count_if(numeric_of(df, rules.target) < 0).alias("negative_target"),
        sum([F.count_if(numeric_of(df, n).isNull()) for n in rules.numeric], F.lit(0)).alias("non_numeric"),
        sum([F.count_if(F.abs(numeric_of(df, n)) == infinity) for n in rules.numeric], F.lit(0)).alias("infinite"),
    )
    copies = (
        df.select(row_digest(required).alias("digest"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))
    )
    repeats = duplicate_timestamps(df, ts, rules.series).agg(
        F.coalesce(F.sum("duplicate_timestamps"), F.lit(0)).alias("duplicate_timestamps")
    )
    grid = frequency_check(df, ts, rules.series, rules.step_seconds).agg(
        F.count_if(F.col("last_at") <= F.col("first_at")).alias("single_timestamp_series"),
        F.count_if((F.col("row_count") > 1) & ~F.col("regular")).alias("irregular_series"),
    )
    ends = grid.select(F.struct("single_timestamp_series", "irregular_series"))
    return (
        counts.select(
            "*",
            copies.scalar().alias("duplicate_rows"),
            repeats.scalar().alias("duplicate_timestamps"),
            ends.scalar().alias("_ends"),
        )
        .select("*", "_ends.*")
        .drop("_ends")
    )


def validate_series(df: DataFrame, rules: SeriesRules | None = None, raise_on_error: bool = True) -> list[str]:
    """Messages for every broken rule, or an exception that carries them."""
    rules = rules or SeriesRules()
    absent = sorted(set(rules.required) - set(df.columns))
    errors: list[str] = []
    if absent:
        errors.append(f"missing required columns: {absent}")
    else:
        report = series_report(df, rules).first()
        bad_numbers = numeric_check(df, rules.numeric).filter("non_numeric > 0 or infinite > 0").collect()
        errors += [text for found, text in (
            (report["missing_values"], "missing values"),
            (report["duplicate_rows"], "duplicate rows"),
            (report["invalid_dates"], "invalid dates"),
            (report["duplicate_timestamps"], "duplicate timestamps"),
        ) if found]
        for row in bad_numbers:
            if row["non_numeric"]:
                errors.append(f"column {row['column']} must be numeric")
            if row["infinite"]:
                errors.append(f"column {row['column']} contains infinite values")
        if report["negative_target"]:
            errors.append(f"{rules.target} cannot be negative")
        if rules.allowed:
            found = {row["column"]: row for row in domain_summary(df, rules.allowed).collect()}
            for column in rules.allowed:
                if row := found.get(column):
                    shown = "" if row["values"] == len(row["sample"]) else f" (first {len(row['sample'])} of {row['values']})"
                    errors.append(f"column {column} has values outside its domain{shown}: {row['sample']}")
        if not report["invalid_dates"] and report["row_count"]:
            if report["single_timestamp_series"]:
                errors.append("dates must span more than one timestamp")
            if rules.require_step and report["irregular_series"]:
                errors.append(f"timestamps must follow an uninterrupted {rules.step_seconds}-second step")
    if errors and raise_on_error:
        raise SeriesQualityError("; ".join(errors))
    return errors
