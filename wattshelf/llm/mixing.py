"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshelf.llm.common import fresh, parts_for
from wattshelf.session import materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
DOCS_PER_BUCKET = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, line feed, vertical tab, form feed, return."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    ends = F.regexp_replace(flat, "[^ ]+", "a")
    return (F.length(ends) - F.length(F.translate(ends, "a", ""))).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, source_size).

    Water-filling in closed form: in ascending order of cap/weight, a source stops at its cap while the
    level that the others would share (rest of the budget over rest of the weights) reaches that ratio.
    This is the fixed point of "clamp and reshare until none is above". The windows run over one row
    per source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("_rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int"))
    )
    capped = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_rank"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    marked = capped.withColumn("_full", level >= F.col("_cap") / F.col("weight"))
    whole = Window.partitionBy(F.lit(0))
    rest = F.sum("source_size").over(whole) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") / open_weight * rest)
    return marked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    split_words: bool = True,
    docs_per_bucket: int = DOCS_PER_BUCKET,
) -> DataFrame:
    """One row per document: doc_id, source, text_key, size, source_size, target, whole, extra, taken.

    Each document is taken ``whole`` = floor(target / source_size) times. The rest of the target is
    filled in a seeded hash order of the source's documents: those before the cut are taken once more.
    At the cut, ``split_words`` takes part of one document's words, so that the source's words are the
    whole part of its target; without it the document is taken if that comes nearer to the target.

    The cut is found without collecting a source: sizes are summed per (source, hash bucket), a running
    sum over buckets finds the bucket with the cut, and only its documents are ordered. The number of
    buckets follows the number of documents.

    Null texts have size 0; a null source is a source of its own, last in order; rows with equal
    doc_id and text are counted each and share a place in hash order, later ones following by size only
    (equal rows are interchangeable); empty tables give no rows; other columns are ignored.
    """
    sized = materialise(
        docs.select(
            "doc_id",
            F.col("source"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
            word_count(F.col("text")).alias("size"),
            F.md5(
                F.concat_ws(
                    "|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")))
                )
            ).alias("_order"),
        ),
        "mix-sizes",
    )
    n_buckets = parts_for(sized.count(), docs_per_bucket)
    # buckets follow the hash order, so their number does not change the result
    leading = F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint")
    sized = sized.withColumn("_bucket", F.shiftright(leading * F.lit(n_buckets), 32))
    buckets = materialise(
        sized.groupBy("source", "_bucket").agg(F.sum("size").cast("bigint").alias("_words")), "mix-buckets"
    )
    sources = buckets.groupBy("source").agg(F.sum("_words").cast("bigint").alias("source_size"))
    targets = (
        source_targets(sources, weights, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("_rest", F.floor(F.col("target") + F.lit(1e-6)).cast("bigint") - F.col("whole") * F.col("source_size"))
    )
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        buckets.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(
            F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "_words", "_before", "source_size", "target", "whole", "_rest",
        )
    )
    joined = sized.join(placed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cut = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest"))
    at_cut = joined.filter(cut).withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    room = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_at")))
    fraction = room if split_words else F.when(2 * room >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    clear = joined.filter(~cut).withColumn(
        "extra", F.when(F.col("_before") + F.col("_words") <= F.col("_rest"), F.col("size")).otherwise(F.lit(0))
    )
    both = at_cut.withColumn("extra", fraction).drop("_at").unionByName(clear)
    return both.select(
        "doc_id", "source", "text_key", "size", "source_size", "target", "whole",
        F.col("extra").cast("bigint").alias("extra"),
        (F.col("whole") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix(..., split_words=False)`` takes its document.

    Documents without words are not taken. Rows that repeat a document are taken as often as their sum says, dealt
    evenly and rounded up; null ids, texts and sources match themselves; an empty table stays empty; extra columns of any name
    pass through.
    """
    doc, key, source, times, rows, copy = fresh(docs.columns, "_mix_id", "_mix_key", "_mix_source", "_mix_copies", "_mix_rows", "_mix_copy")
    copies = (
        mixed.filter("size > 0 AND taken > 0")
        .groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("source").alias(source))
        .agg(F.sum(F.col("whole") + (F.col("extra") > 0).cast("bigint")).alias(times), F.count(F.lit(1)).alias(rows))
    )
    same = (
        docs["doc_id"].eqNullSafe(F.col(doc))
        & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(key))
        & docs["source"].eqNullSafe(F.col(source))
    )
    repeat = F.explode(F.array_repeat(F.lit(0), F.ceil(F.col(times) / F.col(rows)).cast("int"))).alias(copy)
    return docs.join(copies, same).select(*[docs[f"`{c}`"] for c in docs.columns], repeat).drop(copy)
