"""Structured Streaming forms of scoring, validation, features, monitoring."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wattshelf.functions.columns import quoted
from wattshelf.functions.fixed_values import LAGS, ROLLING_MEANS, ROLLING_STDS
from wattshelf.functions.series import micros
from wattshelf.operators.drift import windowed_counts, windowed_psi
from wattshelf.operators.metrics import regression_metrics
from wattshelf.operators.product_quality import QualityRules, with_row_flags
from wattshelf.plans.classify import ProductScorer, score_products
from wattshelf.sources.tables import read_table, write_scored_batch


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = np.dtype([("at", "<i8"), ("key", "<i8"), ("value", "<f8")])


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process what is there, then stop; the checkpoint lets a restart go on where it ended."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch to its own partition; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


@contextmanager
def held(batch: DataFrame) -> Iterator[DataFrame]:
    """Keep a micro-batch that is written more than once, so that its source is read once."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


# --- Scoring ------------------------------------------------------------------------------


def scoring_stream(
    requests: DataFrame, scorer: ProductScorer, order: str, products_path: str, predictions_path: str, rejected_path: str
) -> DataStreamWriter:
    """Score requests and store product and prediction rows, each batch at most once."""

    def store(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            scored, rejected = score_products(scorer, batch)
            named = scored.withColumn("product_name", F.coalesce("product_name", "request_text"))
            write_scored_batch(named, batch_id, quoted(order), products_path, predictions_path)
            replace_batch(rejected, rejected_path, batch_id)

    return requests.writeStream.foreachBatch(store)


# --- Validation ---------------------------------------------------------------------------


def quarantine_stream(products: DataFrame, rules: QualityRules, good_path: str, bad_path: str) -> DataStreamWriter:
    """Rows that pass every row rule go one way, the others with their flags another."""
    flags = ("blank_category", "invalid_category", "blank_description", "bad_price")

    def store(batch: DataFrame, batch_id: int) -> None:
        bad = F.lit(False)
        for flag in flags:
            bad = bad | F.coalesce(F.col(flag), F.lit(True))
        with held(batch):
            flagged = with_row_flags(batch, rules)
            replace_batch(flagged.filter(~bad).drop(*flags), good_path, batch_id)
            replace_batch(flagged.filter(bad), bad_path, batch_id)

    return products.writeStream.foreachBatch(store)


# --- Lag and rolling features -------------------------------------------------------------


def lag_schema(series: T.StructField, lags: Sequence[int], means: Sequence[int], stds: Sequence[int], prefix: str) -> T.StructType:
    names = [f"{prefix}_lag_{k}" for k in lags]
    names += [f"{prefix}_rolling_mean_{n}" for n in means] + [f"{prefix}_rolling_std_{n}" for n in stds]
    return T.StructType(
        [series, T.StructField("at_us", T.LongType()), T.StructField("row_key", T.LongType()), T.StructField("value", T.DoubleType())]
        + [T.StructField(name, T.DoubleType()) for name in names]
    )


def _packed_rows(at, keys, values) -> np.ndarray:
    out = np.empty(len(at), ROW)
    out["at"], out["key"], out["value"] = at, keys, values
    return out


def _chunk_bounds(slots: np.ndarray, least: int) -> list[int]:
    """Where chunks of sorted rows begin, and the end: whole slots, as many as it takes to hold ``least`` rows."""
    bounds = [0]
    for edge in [*(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]:
        if edge - bounds[-1] >= least or edge == len(slots):
            bounds.append(edge)
    return bounds


def _features_of(values: np.ndarray, start: int, lags, means, stds) -> dict[str, np.ndarray]:
    """Feature columns for ``values[start:]``, looking back into ``values[:start]``."""
    series = pd.Series(values)
    earlier = series.shift(1)
    columns = [series.shift(k) for k in lags]
    columns += [earlier.rolling(n, min_periods=n).mean() for n in means]
    columns += [earlier.rolling(n, min_periods=n).std() for n in stds]
    return [column.to_numpy()[start:] for column in columns]


def lag_stream(
    rows: DataFrame,
    series: str,
    ts: str,
    row_key: str,
    value: str,
    watermark: str,
    lags: Sequence[int] = LAGS,
    means: Sequence[int] = ROLLING_MEANS,
    stds: Sequence[int] = ROLLING_STDS,
    prefix: str = "usage",
    slot_us: int = 3_600_000_000,
    rows_per_chunk: int = 256,
) -> DataFrame:
    """Lag and rolling features per series, in event-time order.

    Rows wait until the watermark has passed them, so that order is final when they are
    emitted; later arrivals are dropped by Spark and counted in the query progress. State lives in the RocksDB
    store: per series the longest look-back of values, and the waiting rows in chunks, per trigger whole ``slot``s of
    ``rows_per_chunk`` rows or more, so that a sparse series has few. A trigger writes its new rows, removes what it emits and
    writes what is left of the chunks it opened; others are not written again. Timers wake a series when its first waiting row is due.
    """
    spark = rows.sparkSession
    spark.conf.set(STATE_STORE, ROCKS)
    depth = max([*lags, *means, *stds])
    field = T.StructField(series, rows.schema[series].dataType)
    output = lag_schema(field, lags, means, stds, prefix)
    processor = LagProcessor(series, output.names, depth, lags, means, stds, slot_us, rows_per_chunk)
    placed = rows.withWatermark(ts, watermark).select(
        quoted(series).alias(series),
        quoted(ts).alias(ts),
        micros(quoted(ts)).alias("at_us"),
        quoted(row_key).cast("bigint").alias("row_key"),
        quoted(value).cast("double").alias("value"),
    )
    return placed.groupBy(series).transformWithStateInPandas(processor, output, "append", "EventTime")


class LagProcessor(StatefulProcessor):
    """State and timers of one series: ``past`` values, ``chunks`` of waiting rows, when the next ones are ``due``."""

    def __init__(self, series, names, depth, lags, means, stds, slot_us, rows_per_chunk) -> None:
        self.series, self.names, self.depth, self.slot_us, self.rows_per_chunk = series, names, depth, slot_us, rows_per_chunk
        self.spans = (lags, means, stds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "packed binary")
        self.marks = handle.getValueState("marks", "due bigint, chunks bigint")
        self.chunks = handle.getMapState("chunks", "slot bigint, number bigint", "packed binary")

    def wake(self, at_us: int, number: int, due: int | None) -> None:
        """Set the timer to the millisecond after ``at_us`` unless it is set earlier already."""
        wanted = at_us // 1000 + 1
        if due is None or wanted < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(wanted)
            due = wanted
        self.marks.update((due, number))

    def hold(self, waiting: np.ndarray, number: int) -> None:
        """Store rows in time order as chunks, each named by its first slot."""
        slots = waiting["at"] // self.slot_us
        bounds = _chunk_bounds(slots, self.rows_per_chunk)
        for a, b in zip(bounds, bounds[1:]):
            self.chunks.updateValue((int(slots[a]), number), (waiting[a:b].tobytes(),))

    def handleInputRows(self, key, rows, timerValues):
        batches = list(rows)
        waiting = np.concatenate([_packed_rows(b["at_us"], b["row_key"], b["value"]) for b in batches])
        due, number = self.marks.get() if self.marks.exists() else (None, 0)
        waiting = waiting[np.argsort(waiting["at"], kind="stable")]
        self.hold(waiting, number)
        self.wake(int(waiting["at"][0]), number + 1, due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        _, number = self.marks.get()
        named = sorted(self.chunks.keys())
        open_ = [name for name in named if name[0] * self.slot_us <= passed]
        held = [np.frombuffer(self.chunks.getValue(name)[0], ROW) for name in open_]
        for name in open_:
            self.chunks.removeKey(name)
        rows = np.sort(np.concatenate([np.empty(0, ROW), *held]), order=("at", "key"), kind="stable")
        cut = int(np.searchsorted(rows["at"], passed, side="right"))
        rest = rows[cut:]
        next_due = [name[0] * self.slot_us for name in named[len(open_) : len(open_) + 1]]
        if len(rest):
            self.hold(rest, number)
            next_due.append(int(rest["at"][0]))
        if next_due:
            self.wake(min(next_due), number + 1, None)
        else:
            self.marks.update((None, number))
        if cut:
            past = np.frombuffer(self.past.get()[0], np.float64) if self.past.exists() else np.empty(0)
            known = np.concatenate([past, rows["value"][:cut]])
            self.past.update((known[-self.depth :].tobytes(),))
            columns = [rows["at"][:cut], rows["key"][:cut], rows["value"][:cut], *_features_of(known, len(past), *self.spans)]
            yield pd.DataFrame({self.series: [key[0]] * cut} | dict(zip(self.names[1:], columns, strict=True)))

    def close(self) -> None:
        pass


# --- Monitoring ---------------------------------------------------------------------------


def psi_stream(
    rows: DataFrame,
    ts: str,
    bins: Mapping[str, Sequence[float]],
    expected: DataFrame,
    window: str,
    watermark: str,
    path: str,
) -> DataStreamWriter:
    """Windowed drift against fixed reference bins; a window is written when it has closed."""
    counts = windowed_counts(rows.withWatermark(ts, watermark), ts, bins, window)

    def store(batch: DataFrame, batch_id: int) -> None:
        # All cells of a window close together, so a window is complete within its batch.
        replace_batch(windowed_psi(batch, expected), path, batch_id)

    return counts.writeStream.outputMode("append").foreachBatch(store)


def delayed_label_stream(
    predictions: DataFrame,
    labels: DataFrame,
    key: str,
    predicted_at: str,
    labelled_at: str,
    longest_delay: str,
    watermark: str = "1 hour",
) -> DataFrame:
    """Predictions joined with labels that arrive up to ``longest_delay`` later.

    Left outer: a prediction whose label never came appears once the delay has passed.
    """
    left = predictions.withWatermark(predicted_at, watermark).alias("p")
    right = labels.withWatermark(labelled_at, watermark).alias("l")
    in_time = (F.col(f"l.{labelled_at}") >= F.col(f"p.{predicted_at}")) & (
        F.col(f"l.{labelled_at}") <= F.col(f"p.{predicted_at}") + F.expr(f"INTERVAL {longest_delay}")
    )
    joined = left.join(right, (F.col(f"p.{key}") == F.col(f"l.{key}")) & in_time, "leftOuter")
    others = [F.col(f"l.{name}") for name in labels.columns if name != key]
    return joined.select(F.col(f"p.{key}"), *[F.col(f"p.{n}") for n in predictions.columns if n != key], *others)


def labelled_performance(joined: DataFrame, prediction: str, actual: str) -> DataFrame:
    """Regression metrics of the stored join output; unlabelled rows are not counted."""
    return regression_metrics(joined, actual, prediction)


def dedup_stream(rows: DataFrame, keys: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """The first row of each (series, timestamp) within the watermark."""
    return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


# --- Sessions and late rows ---------------------------------------------------------------

MARK_SCHEMA = "latest timestamp, accepted bigint, late bigint"


def session_stream(rows: DataFrame, keys: Sequence[str], ts: str, gap: str, watermark: str, value: str) -> DataFrame:
    """Sessions per key: keys, session_start, session_end (the last row's time plus the gap), rows, total of a value.

    A row belongs to a session if it comes less than ``gap`` after the row before; a session comes out once the
    watermark has passed its end.
    """
    session = F.session_window(quoted(ts), gap)
    counted = rows.withWatermark(ts, watermark).groupBy(*[quoted(k) for k in keys], session.alias("_session")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(quoted(value)).alias("total")
    )
    return counted.select(*[quoted(k) for k in keys], F.col("_session.start").alias("session_start"), F.col("_session.end").alias("session_end"), "rows", "total")


def late_split_stream(rows: DataFrame, ts: str, delay: str, accepted_path: str, late_path: str, marks_path: str) -> DataStreamWriter:
    """Rows no older than ``delay`` behind the latest time of earlier batches go one way, the others to a sink of their own.

    What a watermark would drop unseen is kept and counted: each batch leaves one row with the latest time and how many
    rows went where. Rows without a time are late. A repeated batch replaces its own parts.
    """
    spark = rows.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        earlier = read_table(spark, marks_path, f"{MARK_SCHEMA}, batch_id bigint").filter(F.col("batch_id") < batch_id)
        latest = earlier.agg(F.max("latest").alias("latest")).first()["latest"]
        bound = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        in_time = quoted(ts).isNotNull() & (F.lit(latest is None) | (quoted(ts) > bound))
        kept = F.coalesce(in_time, F.lit(False))
        with held(batch):
            replace_batch(batch.filter(kept), accepted_path, batch_id)
            replace_batch(batch.filter(~kept), late_path, batch_id)
            top = F.greatest(F.max(quoted(ts)).cast("timestamp"), F.lit(latest).cast("timestamp"))
            counts = batch.agg(top.alias("latest"), F.count_if(kept).alias("accepted"), F.count_if(~kept).alias("late"))
            replace_batch(counts, marks_path, batch_id)

    return rows.writeStream.foreachBatch(store)


def start_to_table(df: DataFrame, path: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """Append a stream to Parquet until its input is used up."""
    return run_available(df.writeStream.format("parquet").option("path", path).options(**options), checkpoint)


