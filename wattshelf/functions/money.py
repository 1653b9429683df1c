"""Price text to numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_price(text: Column) -> Column:
    """Keep digits, dots and minus signs of a price text, then cast; no number gives null.

    For text columns only: a numeric column is its own price and must not pass through text,
    where an exponent would lose its letter.
    """
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def format_percent(share: Column) -> Column:
    """``0.617`` as ``61.7%``, missing as ``N/A``."""
    text = F.format_string("%.1f%%", share * 100.0)
    return F.when(share.isNotNull(), text).otherwise("N/A")
