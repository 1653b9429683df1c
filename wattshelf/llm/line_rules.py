"""Quality rules by cross-document line frequency, on top of per-document base counts."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted
from wattshelf.llm.common import fresh, map_rows, space_words
from wattshelf.session import materialise

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line is above the limit if it stands in more than this share of a host's different documents ...
LINE_SHARE = 0.10
#: ... and in at least so many of them.
LINE_DOCUMENTS = 20
#: A document is depleted if removed lines leave less than this share of its words.
KEPT_SHARE = 0.30
MIN_WORDS = 50
#: Frequent lines are few (a host has at most lines-per-document / LINE_SHARE); up to so many are broadcast.
BROADCAST_LINES = 200_000


def normal_line(line: str) -> str:
    """Lower case, white space collapsed, digits as 0."""
    return " ".join(line.lower().split()).translate({d: "0" for d in range(49, 58)})


def line_hash(line: str) -> int:
    """The leading 64 bits of the normalised line's MD5, shifted to a signed number of the same order."""
    return int.from_bytes(hashlib.md5(normal_line(line).encode("utf-8", "surrogatepass")).digest()[:8]) - (1 << 63)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, first one included."""
    if len(words) <= width:
        return 0
    vocabulary: dict[bytes, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.uint64, len(words))
    keys = ids[: len(ids) - width + 1]
    for i in range(1, width):  # numbered pairs of (window so far, next word): exact for any vocabulary
        keys = np.unique((keys << np.uint64(32)) | ids[i : i + len(keys)], return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    repeated = np.zeros(len(keys), bool)
    repeated[order[1:][equal]] = True
    repeated[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + len(keys)] |= repeated
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hash and words of each different line."""
    if not text:
        return 0, 0, 0, 0, 0, [], []
    words = space_words(text)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    held: dict[int, int] = {}
    for line in lines:
        h = line_hash(line)
        held[h] = held.get(h, 0) + len(space_words(line))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), list(held), list(held.values())


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def line_statistics(docs: DataFrame) -> DataFrame:
    """Per document: base counts, and hash and words of its different normalised lines. Written once."""

    def factory():
        def step(batch):
            rows = [base_counts(t) for t in batch["text"].to_pylist()]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words")
            out = {name: [r[i] for r in rows] for i, name in enumerate(names)}
            return {**out, "doc_id": batch["doc_id"], "source": batch["source"], "text_key": batch["text_key"]}

        return step

    kind = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    schema = (
        f"doc_id {kind['doc_id']},source {kind['source']},text_key bigint,n_words bigint,word_chars bigint,n_symbols bigint,"
        "n_dup_lines bigint,n_repeat_words bigint,lines array<bigint>,line_words array<int>"
    )
    keyed = docs.select("doc_id", "source", "text", text_key())
    found = map_rows(keyed, factory, schema, ["doc_id", "source", "text", "text_key"])
    return materialise(found.withColumn("_row", F.monotonically_increasing_id()), "line-statistics")


def frequent_lines(statistics: DataFrame, line_share: float = LINE_SHARE, line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """(source, line, documents) of the lines above a source's limit, by the number of its different documents.

    Rows with one text are one document of a source, for a line and for the source's size. Lines of a task's rows are
    counted before the shuffle, so a line that every document has costs a row per task.
    """
    different = statistics.filter(F.size("lines") > 0).groupBy("source", "text_key").agg(F.min("_row").alias("_first"))
    totals = different.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_documents"))
    lines = statistics.join(different.select(F.col("_first").alias("_r")), F.col("_row") == F.col("_r")).select("source", F.explode("lines").alias("line"))
    counted = lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= line_documents)
    return (
        counted.join(totals, F.col("source").eqNullSafe(F.col("_s")))
        .filter(F.col("documents") > F.lit(line_share) * F.col("_documents"))
        .select("source", "line", "documents")
    )


def judge_documents(
    docs: DataFrame,
    line_share: float = LINE_SHARE,
    line_documents: int = LINE_DOCUMENTS,
    kept_share: float = KEPT_SHARE,
    min_words: int = MIN_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts per document, and the frequent lines behind them.

    Verdict rows: doc_id, source, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    removed_words, base_failed, kept. The source stands for the host. A document fails the base rules with
    fewer than ``min_words`` words or if over half its words repeat in 3-word windows; it is depleted
    if less than ``kept_share`` of its words stand outside lines above the limit: those in more than ``line_share`` of the
    source's different documents and in ``line_documents`` of them at least. Copies of a text count once; near copies are
    documents of their own.

    Null and empty texts have zero counts and fail; a null source is a host of its own; repeated rows are
    judged each; empty tables give empty results; other columns are ignored.
    """
    statistics = line_statistics(docs)
    frequent = materialise(frequent_lines(statistics, line_share, line_documents), "frequent-lines")
    named = frequent.select(F.col("source").alias("_s"), F.col("line").alias("_l"))
    if frequent.count() <= BROADCAST_LINES:
        named = F.broadcast(named)
    zipped = F.explode(F.arrays_zip("lines", "line_words")).alias("_z")
    removed = (
        statistics.select("_row", "source", zipped)
        .join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_z.lines") == F.col("_l")))
        .groupBy("_row")
        .agg(F.sum("_z.line_words").cast("bigint").alias("_removed"))
        .withColumnRenamed("_row", "_r")
    )
    joined = statistics.drop("lines", "line_words").join(removed, F.col("_row") == F.col("_r"), "left")
    removed_words = F.coalesce("_removed", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - removed_words) < F.lit(kept_share) * F.col("n_words")
    verdicts = joined.select(
        "doc_id", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        removed_words.cast("bigint").alias("removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )
    return verdicts, frequent


def without_lines(text: str, bad) -> str:
    """The text without the lines whose hash is in ``bad``; lines without words stay."""
    rows = text.split("\n")
    left = [row for row in rows if not row.strip(SPACES) or line_hash(row) not in bad]
    return text if len(left) == len(rows) else "\n".join(left)


def apply_rules(docs: DataFrame, **settings) -> DataFrame:
    """The kept rows of ``docs`` with lines above the limit cut from their texts; same columns.

    ``n_chars`` is set anew where a text changed. Rows that repeat a document are kept as often as they come. Null
    and empty texts go, as they fail the base rules; a null source is a host of its own; an empty table stays
    empty; extra columns of any name pass through.
    """
    verdicts, frequent = judge_documents(docs, **settings)
    key, text, touched, source, lines, *own = fresh(docs.columns, "_text_key", "_text", "_touched", "_source", "_frequent", "_doc", "_of", "_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    passed = verdicts.filter("kept").select(
        F.col("doc_id").alias(own[0]), F.col("source").alias(own[1]), F.col("text_key").alias(own[2]), (F.col("removed_words") > 0).alias(touched)
    ).distinct()
    same = keyed["doc_id"].eqNullSafe(passed[own[0]]) & keyed["source"].eqNullSafe(passed[own[1]]) & (keyed[key] == passed[own[2]])
    kept = keyed.join(passed, same)
    if frequent.count() <= BROADCAST_LINES:  # few lines: sets per source go to the tasks once, not with every row
        held: dict[str | None, set] = {}
        for row in frequent.select(F.col("source").cast("string").alias("s"), "line").collect():
            held.setdefault(row["s"], set()).add(row["line"])
        shared = docs.sparkSession.sparkContext.broadcast(held)

        @F.pandas_udf("string")
        def cut(texts: pd.Series, sources: pd.Series) -> pd.Series:
            sets = shared.value
            out = [None if t is None else without_lines(t, sets.get(s, ())) for t, s in zip(texts, sources)]
            return pd.Series(out, dtype=object)

        changed = cut(F.when(F.col(touched), F.col("text")), F.col("source").cast("string"))
    else:
        by_source = frequent.groupBy(F.col("source").alias(source)).agg(F.collect_set("line").alias(lines))
        kept = kept.join(by_source, keyed["source"].eqNullSafe(F.col(source)), "left")

        @F.pandas_udf("string")
        def cut_listed(texts: pd.Series, listed: pd.Series) -> pd.Series:
            out = [None if t is None else without_lines(t, set(bad.tolist())) for t, bad in zip(texts, listed)]
            return pd.Series(out, dtype=object)

        changed = cut_listed(F.when(F.col(touched), F.col("text")), F.when(F.col(touched), F.col(lines)))
    cut_text = F.coalesce(F.col(text), F.col("text"))
    columns = [
        cut_text.alias("text") if c == "text"
        else F.when(F.col(text) != F.col("text"), F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else quoted(c)
        for c in docs.columns
    ]
    return kept.withColumn(text, changed).select(*columns)
