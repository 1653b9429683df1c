"""Whole jobs from a CSV file to stored results: check, clean, features, classifier, forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.operators.product_quality import QualityRules, quality_report
from wattshelf.operators.projection import add_corpus
from wattshelf.operators.series_quality import SeriesRules, validate_series
from wattshelf.operators.tfidf import TfidfSettings, feature_summary_row, fit_vocabulary, vectorise, vectorizer
from wattshelf.functions.columns import resolve_text_columns
from wattshelf.plans.classify import TrainingResult, TrainingSettings, train_and_select
from wattshelf.plans.forecast import ForecastResult, train_forecaster
from wattshelf.session import materialise
from wattshelf.sources.csv_files import read_csv, with_row_id
from wattshelf.sources.json_records import write_report
from wattshelf.sources.tables import append, write_features


def check_products(
    spark: SparkSession,
    path: str,
    report_path: str | None = None,
    rules: QualityRules | None = None,
    infer: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Quality report of a product CSV as one row, appended to ``report_path`` when given.

    ``infer`` types the columns by a scan, so that a column of the wrong type is reported; otherwise
    every column is text.
    """
    rules = replace(rules, row_id="row_id") if rules else QualityRules(row_id="row_id")
    report = materialise(quality_report(with_row_id(read_csv(spark, path, infer=infer, multi_line=multi_line)), rules, path))
    if report_path is not None:
        write_report(report, report_path)
    return report


def build_features(
    spark: SparkSession,
    path: str,
    output: str,
    columns: Sequence[str] | None = None,
    settings: TfidfSettings | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """TF-IDF vectors, vocabulary and vectorizer of a CSV below ``output``; returns the summary row."""
    settings = settings or TfidfSettings()
    rows = with_row_id(read_csv(spark, path, multi_line=multi_line))
    chosen = resolve_text_columns(rows.columns, columns)
    corpus = materialise(add_corpus(rows, chosen).select("row_id", "corpus"))
    vocabulary = materialise(fit_vocabulary(corpus, "corpus", settings))
    model = vectorizer(vocabulary)
    features = vectorise(corpus, "corpus", model, settings).select("row_id", "features")
    write_features(features, vocabulary, output)
    model.write().overwrite().save(f"{output.rstrip('/')}/vectorizer")
    return feature_summary_row(corpus, vocabulary, chosen)


def train_products(
    spark: SparkSession, path: str, output: str, settings: TrainingSettings | None = None, multi_line: bool = True
) -> TrainingResult:
    """Compare classifiers on a product CSV; store the scorer, append the run rows."""
    settings = replace(settings, key="row_id") if settings else TrainingSettings(key="row_id")
    rows = materialise(with_row_id(read_csv(spark, path, multi_line=multi_line)))
    result = train_and_select(rows, settings)
    result.scorer.save(f"{output.rstrip('/')}/scorer")
    append(result.report(), f"{output.rstrip('/')}/runs")
    return result


def check_meter(spark: SparkSession, path: str, rules: SeriesRules | None = None) -> list[str]:
    """Messages for every broken rule of a meter CSV; its cells are still text, so that a word in a number
    column is a wrong number and not a missing one."""
    return validate_series(read_csv(spark, path), rules or SeriesRules(), raise_on_error=False)


def train_energy(
    spark: SparkSession,
    path: str,
    schema: str,
    output: str,
    rules: SeriesRules | None = None,
    roster: Mapping[str, Any] | None = None,
) -> ForecastResult:
    """Validate a meter CSV, compare regressors, store the best model and the comparison."""
    rules = rules or SeriesRules()
    validate_series(read_csv(spark, path), rules)
    rows = materialise(read_csv(spark, path, schema))
    result = train_forecaster(rows, rules.time, rules, roster)
    result.model.write().overwrite().save(f"{output.rstrip('/')}/model")
    stamped = result.runs.withColumn("generated_at", F.current_timestamp())
    write_report(stamped, f"{output.rstrip('/')}/comparison")
    return result
