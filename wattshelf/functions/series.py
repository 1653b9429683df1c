"""Time expressions for meter series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: date shapes with the patterns tried on each, in order; separators are slashes by then.
DATE_SHAPES = {
    r"\d{1,2}/\d{1,2}/\d{4}": ("d/M/yyyy", "M/d/yyyy"),
    r"\d{1,2}/\d{1,2}/\d{2}": ("d/M/yy", "M/d/yy"),
    r"\d{4}/\d{1,2}/\d{1,2}": ("yyyy/M/d",),
    r"\d{8}": ("yyyyMMdd",),
    r"\d{1,2} [A-Z][a-z]{2} \d{4}": ("d MMM yyyy",),
}
CLOCK = r"[ T]+(\d{1,2}):(\d{2})(?::(\d{2}))? ?([AaPp][Mm])?$"


def parse_timestamp(text: Column) -> Column:
    """Day-first text to a timestamp, month-first where only that is a date; ISO text stays year-first.

    Dates may have slashes, dashes or dots, years of two digits, month names before or after the day, or be eight
    digits; clocks may have seconds, AM or PM, and follow a space or a ``T``. Anything else is null.
    Date and clock are read apart, and a shape is tested before a format is tried, as a failed try costs
    far more than a match.
    """
    trimmed = F.trim(text)
    day = F.regexp_replace(F.regexp_replace(trimmed, CLOCK, ""), r"[-./]", "/")
    named = F.initcap(F.regexp_replace(day, r"^(\d{1,2})[ /]+([A-Za-z]{3})[a-z]*,?[ /]+(\d{4})$", "$1 $2 $3"))
    named = F.initcap(F.regexp_replace(named, r"^([A-Za-z]{3})[a-z]* +(\d{1,2}),? +(\d{4})$", "$2 $1 $3"))
    tries = []
    for shape, formats in DATE_SHAPES.items():
        tries += [F.when(named.rlike(f"^{shape}$"), F.try_to_timestamp(named, F.lit(f))) for f in formats]
    part = lambda i: F.regexp_extract(trimmed, CLOCK, i)
    hour, half = part(1).try_cast("int"), F.upper(part(4))
    right = F.when(half == "", hour.between(0, 23)).otherwise(hour.between(1, 12))
    right = right & (part(2).try_cast("int") < 60) & (F.coalesce(part(3).try_cast("int"), F.lit(0)) < 60)
    shifted = F.when(half == "PM", hour % 12 + 12).when(half == "AM", hour % 12).otherwise(hour)
    seconds = shifted * 3600 + part(2).try_cast("int") * 60 + F.coalesce(part(3).try_cast("int"), F.lit(0))
    clock = F.when(~trimmed.rlike(CLOCK), 0).when(right, seconds)
    read = F.timestamp_add("SECOND", clock, F.coalesce(*tries))
    iso = F.when(trimmed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), trimmed.try_cast("timestamp"))
    return F.coalesce(iso, read)


def calendar_columns(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    angle = F.lit(2.0) * F.pi() * hour / F.lit(24.0)
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_year": F.dayofyear(ts),
        "hour": hour,
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    }


def micros(ts: Column) -> Column:
    """Wall-clock microseconds since 1970, exact as a double until the year 2255.

    Takes timestamps with and without time zone; the session runs in UTC.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))
