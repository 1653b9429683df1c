"""Differences of two versions of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted


def row_digest(columns: list[str]) -> Column:
    """MD5 of a row's JSON with nulls written out, so that rows are equal exactly if their digests are."""
    return F.md5(F.to_json(F.struct(*[quoted(c).alias(c) for c in columns]), {"ignoreNullFields": "false"}))


def dataset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of either version that the other lacks, as often as they are missing there: change, and the columns.

    Both versions are counted by digest in one aggregate with map-side sums; whole rows are fetched for the digests
    whose counts differ only. Rows repeat by their surplus; nulls equal nulls; column order does not matter, other column
    names are an error; empty versions are allowed.
    """
    columns = old.columns
    if sorted(columns) != sorted(new.columns):
        raise ValueError("the versions have different columns")
    sides = [
        df.select(*[quoted(c) for c in columns]).withColumn("_digest", row_digest(columns)).withColumn("_sign", F.lit(sign))
        for df, sign in ((old, -1), (new, 1))
    ]
    both = sides[0].unionByName(sides[1])
    surplus = both.groupBy(F.col("_digest").alias("_changed")).agg(F.sum("_sign").alias("_surplus")).filter("_surplus <> 0")
    changed = both.join(surplus, (F.col("_digest") == F.col("_changed")) & (F.col("_sign") == F.signum("_surplus")))
    one = changed.groupBy("_digest").agg(
        F.first(F.struct(*[quoted(c).alias(c) for c in columns])).alias("_row"), F.first("_surplus").alias("_surplus")
    )
    times = F.explode(F.sequence(F.lit(1), F.abs("_surplus").cast("int"))).alias("_time")
    named = F.when(F.col("_surplus") > 0, "added").otherwise("removed").alias("change")
    return one.select(named, "_row", times).select("change", "_row.*")
