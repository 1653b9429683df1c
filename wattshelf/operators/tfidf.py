"""TF-IDF: vocabulary by aggregation, vectors row by row inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import quoted
from wattshelf.functions.fixed_values import MAX_DF, MAX_FEATURES, MIN_DF, NGRAM_RANGE
from wattshelf.functions.text import ngrams, tokens
from wattshelf.operators.ranks import dense_index
from wattshelf.session import materialise

VOCABULARY_SCHEMA = "term string, term_idx int, df bigint, cf bigint, idf double"


@dataclass(frozen=True)
class TfidfSettings:
    max_features: int | None = MAX_FEATURES
    ngram_range: tuple[int, int] = NGRAM_RANGE
    min_df: int | float = MIN_DF
    max_df: int | float = MAX_DF


def terms_of(corpus: Column, settings: TfidfSettings) -> Column:
    return ngrams(tokens(corpus), settings.ngram_range)


def exploded(df: DataFrame, values: Column, output: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per array element. The outer form avoids the inferred ``size(...) > 0`` filter,
    which would run the tokenising expression a second time below the projection."""
    spread = df.select(*[quoted(name) for name in keep], F.explode_outer(values).alias(output))
    return spread.filter(F.col(output).isNotNull())


def term_frequencies(df: DataFrame, key: str, corpus: str, settings: TfidfSettings, rows_per_block: int = 2048) -> DataFrame:
    """(key, term, tf) in long form. Texts are shuffled by key, about ``rows_per_block`` to a task; terms are counted where they are made."""
    blocks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows_per_block))
    texts = df.select(quoted(key), quoted(corpus)).repartition(blocks, quoted(key))
    return (
        exploded(texts, terms_of(quoted(corpus), settings), "term", [key])
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def counted_block(words: pa.Array, group: np.ndarray, groups: int, ngram_range: tuple[int, int]):
    """(names, group, df, cf) per n-gram size of the lists ``words``, whose lists belong to ``group`` (codes below ``groups``).

    n-grams are pairs of integer codes; only the different ones become text.
    """
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    encoded = words.flatten().dictionary_encode()
    single, singles = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
    low, high = ngram_range
    starts, codes, names, width = np.arange(len(owner)), single, singles, max(len(singles), 1)
    for size in range(1, high + 1):
        if size > 1:  # a gram one word shorter, whose code is known, and the word after it
            longer = starts + size - 1 < len(owner)
            longer[longer] = owner[starts[longer]] == owner[starts[longer] + size - 1]
            starts = starts[longer]
            pairs, codes = np.unique(codes[longer] * width + single[starts + size - 1], return_inverse=True)
            names = pc.binary_join_element_wise(names.take(pa.array(pairs // width)), singles.take(pa.array(pairs % width)), " ")
        texts = owner[starts]
        if size < low or not len(codes):
            continue
        # occurrences per (term, text), then texts and occurrences per (term, group)
        held, times = np.unique(codes * len(sizes) + texts, return_counts=True)
        cells, at = np.unique(held // len(sizes) * groups + group[held % len(sizes)], return_inverse=True)
        yield names.take(pa.array(cells // groups)), cells % groups, np.bincount(at), np.bincount(at, times).astype(np.int64)


def count_terms(batches, ngram_range: tuple[int, int], words_per_block: int):
    """Arrow batches of (words, group columns...) to (term, df, cf, group columns...), counted over blocks of texts."""

    def counted(block: list[pa.RecordBatch]):
        table = pa.Table.from_batches(block).combine_chunks()
        by, keys = table.column_names[1:], [table.column(i).combine_chunks() for i in range(1, table.num_columns)]
        group, groups = np.zeros(table.num_rows, np.int64), 1
        for key in keys:
            code = key.dictionary_encode(null_encoding="encode")
            group = group * len(code.dictionary) + code.indices.to_numpy(zero_copy_only=False)
            groups *= len(code.dictionary)
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        for names, cell, df, cf in counted_block(table.column(0).combine_chunks(), group, len(first), ngram_range):
            shown = [key.take(pa.array(first[cell])) for key in keys]
            yield pa.RecordBatch.from_arrays([names, pa.array(df), pa.array(cf), *shown], ["term", "df", "cf", *by])

    block, held = [], 0
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + words_per_block - held, side="right")))
            block.append(batch.slice(at, end - at))
            held += int(upto[end - 1]) - before
            at = end
            if held >= words_per_block or at < batch.num_rows:
                yield from counted(block)
                block, held = [], 0
    if block:
        yield from counted(block)


def term_statistics(
    df: DataFrame, corpus: str, settings: TfidfSettings, by: Sequence[str] = (), words_per_block: int = 1 << 20
) -> DataFrame:
    """(term, df, cf), per ``by`` if named, with a single shuffle on the term.

    Words leave the JVM as Arrow lists; blocks of texts with about ``words_per_block`` words are counted in their task, and
    only the different terms of a block are shuffled.
    """
    words = df.select(tokens(quoted(corpus)).alias("words"), *[quoted(name) for name in by])
    schema = T.StructType.fromDDL("term string, df bigint, cf bigint")
    for name in by:
        schema = schema.add(df.schema[name])
    blocks = words.mapInArrow(partial(count_terms, ngram_range=settings.ngram_range, words_per_block=words_per_block), schema)
    return blocks.groupBy(*[quoted(name) for name in by], "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def document_bounds(n: int, settings: TfidfSettings) -> tuple[float, float]:
    """Lowest and highest document frequency kept: int = count, float = share of ``n``."""

    def absolute(limit: int | float) -> float:
        return limit * n if isinstance(limit, float) else limit

    low, high = absolute(settings.min_df), absolute(settings.max_df)
    if high < low:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    return low, high


def smooth_idf(df: Column, n: int) -> Column:
    return F.log(F.lit(float(1 + n)) / (df + F.lit(1.0))) + F.lit(1.0)


def most_frequent(statistics: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms of highest corpus frequency, ties in term order.

    A histogram of log-scaled frequencies (a few hundred rows) finds how far down to look, so
    the ordered part is about ``k`` terms however large the vocabulary is.
    """
    steps = F.floor(F.log2("cf") * 16).cast("int")
    histogram = sorted(
        ((row["s"], row["count"]) for row in statistics.groupBy(steps.alias("s")).count().collect()),
        reverse=True,
    )
    total, lowest = 0, None
    for step, count in histogram:
        if total >= k:
            break
        total, lowest = total + count, step
    if total <= k or lowest is None:
        return statistics
    candidates, order = statistics.filter(steps >= lowest), [F.desc("cf"), F.asc("term")]
    if total > 4 * k:  # many ties at the cut: number them with a distributed sort
        return dense_index(candidates, order, "_rank").filter(F.col("_rank") < k).drop("_rank")
    return candidates.orderBy(*order).limit(k)


def fit_vocabulary(df: DataFrame, corpus: str, settings: TfidfSettings | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(term, term_idx, df, cf, idf): filtered, capped, indexed alphabetically.

    ``counted`` are the term statistics of the same texts where they are known already, per group or not.
    """
    settings = settings or TfidfSettings()
    n = df.count()
    low, high = document_bounds(n, settings)
    if counted is None:
        statistics = term_statistics(df, corpus, settings)
    else:
        statistics = counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    statistics = statistics.filter(F.col("df").between(low, high))
    if settings.max_features is None:
        indexed = dense_index(statistics, [F.col("term")], "term_idx")
    else:
        capped = most_frequent(materialise(statistics), settings.max_features)
        # At most max_features rows from here on.
        indexed = capped.withColumn("term_idx", F.row_number().over(Window.orderBy("term")) - 1)
    return indexed.select(
        "term",
        F.col("term_idx").cast("int").alias("term_idx"),
        F.col("df").cast("bigint").alias("df"),
        F.col("cf").cast("bigint").alias("cf"),
        smooth_idf(F.col("df"), n).alias("idf"),
    )


def vectorizer(vocabulary: DataFrame, terms: str = "terms", output: str = "features") -> PipelineModel:
    """Counts, times idf, L2-normalised: three built-in stages that add no shuffle.

    The vocabulary (at most ``max_features`` terms) becomes part of the model.
    """
    rows = vocabulary.orderBy("term_idx").select("term", "idf").collect()
    if not rows:
        raise ValueError("no term is left in the vocabulary")
    counts = CountVectorizerModel.from_vocabulary([row["term"] for row in rows], inputCol=terms, outputCol="_tf")
    weights = ElementwiseProduct(
        scalingVec=Vectors.dense([row["idf"] for row in rows]), inputCol="_tf", outputCol="_tfidf"
    )
    return PipelineModel([counts, weights, Normalizer(p=2.0, inputCol="_tfidf", outputCol=output)])


def vectorise(
    df: DataFrame, corpus: str, model: PipelineModel, settings: TfidfSettings, output: str = "features"
) -> DataFrame:
    """Feature vectors for any text; unknown terms are dropped, a vector may be empty."""
    with_terms = df.withColumn("terms", terms_of(quoted(corpus), settings))
    features = model.transform(with_terms).drop("terms", "_tf", "_tfidf")
    return features if output == "features" else features.withColumnRenamed("features", output)


def matrix_cells(df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """The sparse matrix in long form, read from each row's own vector."""
    vector = F.unwrap_udt(quoted(features))
    dense_positions = F.sequence(F.lit(0), F.size(vector["values"]) - 1)
    positions = F.when(vector["type"] == 0, vector["indices"]).otherwise(dense_positions)
    cells = F.when(F.size(vector["values"]) > 0, F.arrays_zip(positions.alias("term_idx"), vector["values"].alias("tfidf")))
    return exploded(df, cells, "cell", keep).select(
        *[quoted(name) for name in keep],
        F.col("cell")["term_idx"].alias("term_idx"),
        F.col("cell")["tfidf"].alias("tfidf"),
    )


def tfidf_rows(
    df: DataFrame, key: str, corpus: str, vocabulary: DataFrame, settings: TfidfSettings
) -> DataFrame:
    """(key, term, tfidf) for a vocabulary of any size, through joins.

    For a vocabulary too large to be a model; Spark picks the join from the runtime size.
    """
    weighted = (
        term_frequencies(df, key, corpus, settings)
        .join(vocabulary.select("term", "idf"), "term")
        .select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    )
    per_text = Window.partitionBy(key)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_text))
    return weighted.select(key, "term", (F.col("w") / norm).alias("tfidf"))


def feature_summary_row(df: DataFrame, vocabulary: DataFrame, text_columns: Sequence[str]) -> DataFrame:
    """row_count, feature_count and the text columns used, as one row."""
    terms = vocabulary.agg(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", terms.alias("feature_count"), F.lit(",".join(text_columns)).alias("text_columns")
    )

