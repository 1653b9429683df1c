"""Calendar, lag and rolling features that never look at the current or a later row."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshelf.functions.columns import nan_to_null, quoted
from wattshelf.functions.fixed_values import LAGS, ROLLING_MEANS, ROLLING_STDS, SERIES_TARGET, SERIES_TIME
from wattshelf.functions.series import calendar_columns, micros
from wattshelf.operators.projection import drop_incomplete
from wattshelf.operators.ranks import profile_columns, windowed_in_blocks, with_bin
from wattshelf.operators.series_quality import timestamp_of


def history_columns(
    target: str,
    window,
    lags: Sequence[int] = LAGS,
    means: Sequence[int] = ROLLING_MEANS,
    stds: Sequence[int] = ROLLING_STDS,
    prefix: str = "usage",
) -> dict[str, Column]:
    """Lags, and statistics of the previous N rows that are null until N rows exist."""
    value = quoted(target)

    def full(size: int, statistic: Column) -> Column:
        frame = window.rowsBetween(-size, -1)
        return F.when(F.count(value).over(frame) == size, statistic.over(frame))

    columns = {f"{prefix}_lag_{k}": F.lag(value, k).over(window) for k in lags}
    columns |= {f"{prefix}_rolling_mean_{n}": full(n, F.avg(value)) for n in means}
    columns |= {f"{prefix}_rolling_std_{n}": full(n, F.stddev_samp(value)) for n in stds}
    return columns


def history_features(
    df: DataFrame,
    ts: Column,
    target: str,
    series: Sequence[str] = (),
    tiebreak: Sequence[Column] = (),
    lags: Sequence[int] = LAGS,
    means: Sequence[int] = ROLLING_MEANS,
    stds: Sequence[int] = ROLLING_STDS,
    prefix: str = "usage",
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Row-based lags and rolling statistics per series, in bounded blocks."""
    halo = max([*lags, *means, *stds])
    return windowed_in_blocks(
        df,
        micros(ts),
        halo,
        lambda window: history_columns(target, window, lags, means, stds, prefix),
        tiebreak,
        series,
        rows_per_block,
    )


def build_features(
    df: DataFrame,
    time: str = SERIES_TIME,
    target: str = SERIES_TARGET,
    series: Sequence[str] = (),
    dropna: bool = True,
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """The model's feature table: parsed time, calendar parts, lags and rolling statistics."""
    parsed = nan_to_null(df).withColumn(time, timestamp_of(df, time))
    if parsed.filter(quoted(time).isNull()).limit(1).count():
        raise ValueError(f"column {time} contains invalid dates")
    calendar = parsed.withColumns(calendar_columns(quoted(time)))
    featured = history_features(calendar, quoted(time), target, series, rows_per_block=rows_per_block)
    return drop_incomplete(featured) if dropna else featured


def spread_over_time(keyed: DataFrame, span: int, rows_per_block: int) -> DataFrame:
    """Rows with a number ``_at`` once per block of time, ``_copy``, of their own ``_block`` and the later ones that ``span`` reaches.

    Blocks have about equal depth but for the first are no narrower than the span, so a row stands in two at most, however dense
    the rows are.
    """
    found = keyed.agg(F.count(F.lit(1)).alias("rows"), (F.max("_at") - F.min("_at")).alias("range")).first()
    blocks = max(1, min(math.ceil(found["rows"] / rows_per_block), int((found["range"] or 0) // span) + 1))
    edges: list[float] = []
    for edge in profile_columns(keyed, ["_at"], blocks)["_at"].edges if blocks > 1 else ():
        if not edges or edge - edges[-1] >= span:
            edges.append(edge)
    reach = with_bin(keyed, "_at", edges, "_block").withColumn("_until", F.col("_at") + F.lit(float(span)))
    return with_bin(reach, "_until", edges, "_to").withColumn("_copy", F.explode(F.sequence("_block", "_to")))


def rolling_time(
    df: DataFrame,
    ts: Column,
    target: str,
    spans_us: Mapping[str, int],
    series: Sequence[str] = (),
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Count, mean and deviation of the earlier readings inside a time span: <name>_rows, <name>_mean, <name>_std.

    For series with gaps, where a number of rows is no measure of time. A span looks back from just before a
    row's time. Rows are cut into blocks of time, and a row also goes to the next block where its longest span reaches it
    (``spread_over_time``) and is dropped there again after the window: the halo is measured in time. Null times have no span
    and empty statistics; readings at one time do not see each other; missing readings are not counted.
    """
    keyed = df.withColumns({"_at": micros(ts).cast("double")})
    spread = spread_over_time(keyed, max(spans_us.values()), rows_per_block)
    placed = Window.partitionBy(*[quoted(name) for name in series], "_copy").orderBy(F.col("_at").cast("bigint"))
    value, columns = quoted(target), {}
    for name, span in spans_us.items():
        frame = placed.rangeBetween(-span, -1)
        columns |= {f"{name}_rows": F.count(value).over(frame), f"{name}_mean": F.avg(value).over(frame), f"{name}_std": F.stddev_samp(value).over(frame)}
    featured = spread.withColumns(columns).filter("_copy = _block").drop("_at", "_block", "_until", "_to", "_copy")
    return featured.withColumns({n: F.when(ts.isNotNull(), F.col(n)) if not n.endswith("_rows") else F.when(ts.isNotNull(), F.col(n)).otherwise(0) for n in columns})
