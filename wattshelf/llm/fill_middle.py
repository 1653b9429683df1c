"""Fill-in-middle: one counted-quantifier match per text gives prefix, middle and suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a run of ASCII letters or any other single character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The same with a possessive run, so that a repeated group never splits a run or goes back.
OWNED = "(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90
SPM_BELOW = 20


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers from the sha256 of ``seed:doc_id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def split_pattern(first: Column, second: Column) -> Column:
    """A pattern for one row: ``first`` units, the units up to ``second``, and the rest.

    The counted groups are possessive, which Java's engine runs as a loop: no recursion and no way
    back, however many units a text has.
    """
    counted = lambda times: F.concat(F.lit(f"({OWNED}{{"), times.cast("string"), F.lit("}+)"))
    return F.concat(F.lit("(?s)\\A"), counted(first), counted(second - first), F.lit("(.*)\\z"))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """One row per document: doc_id, text, n, form, prefix_chars, middle_chars, output.

    ``n`` counts the units of the text. Two draws modulo n + 1 are the ends of prefix and middle. ``form``
    is ``plain`` (output is the text) for texts that are empty or hold a sentinel and where the third
    draw modulo 100 is ``plain_from`` or more; else ``spm`` (suffix, prefix, middle) where the fourth modulo 100 is
    below ``spm_below``, else ``psm``. Lengths are in code points, null for plain rows.

    The text is rearranged by one match: the row's pattern captures the three parts and the row's
    replacement puts them in order. No shuffle, no Python.

    Null and empty texts are plain with an empty output and n = 0; a null doc_id draws as an empty id; repeated
    rows give equal rows; other columns of any name are ignored; an empty table gives no rows.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    counted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.regexp_count("text", F.lit(UNIT)).cast("bigint").alias("n")
    )
    drawn = counted.select(
        "doc_id", "text", "n", (h1 % (F.col("n") + 1)).alias("_x"), (h2 % (F.col("n") + 1)).alias("_y"),
        (h3 % 100).alias("_plain"), (h4 % 100).alias("_spm"),
    )
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | marked | (F.col("_plain") >= plain_from), "plain").otherwise(
        F.when(F.col("_spm") < spm_below, "spm").otherwise("psm")
    )
    ordered = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    formed = drawn.select(
        "doc_id", "text", "n", form.alias("form"),
        split_pattern(F.least("_x", "_y"), F.greatest("_x", "_y")).alias("_pattern"),
    ).select(
        "doc_id", "text", "n", "form",
        F.when(F.col("form") == "plain", F.col("text"))
        .otherwise(F.regexp_replace(F.col("text"), F.col("_pattern"), ordered)).alias("output"),
    )
    prefix, _, middle = part_bounds(F.col("form"), F.col("output"))
    return formed.select(
        "doc_id", "text", "n", "form", prefix[1].cast("bigint").alias("prefix_chars"), middle[1].cast("bigint").alias("middle_chars"), "output"
    )


def part_bounds(form: Column, output: Column) -> tuple[tuple[Column, Column], ...]:
    """(1-based start, length) of prefix, suffix and middle in an output; null for plain ones.

    Texts with sentinels stay plain, so the first place of each sentinel is the one that was put in.
    """
    end = F.length(output) + 1
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    arranged = form != "plain"
    width = len(PREFIX)
    prefix_end, suffix_end = F.when(form == "spm", m).otherwise(s), F.when(form == "spm", p).otherwise(m)
    return tuple(
        (F.when(arranged, mark + width), F.when(arranged, stop - mark - width))
        for mark, stop in ((p, prefix_end), (s, suffix_end), (m, end))
    )


def restore(form: Column, output: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made from."""
    prefix, suffix, middle = part_bounds(form, output)
    parts = [F.substring(output, *bounds) for bounds in (prefix, middle, suffix)]
    return F.when(form == "plain", output).otherwise(F.concat(*parts))
