"""Product classification: prepare, split, fit candidates, choose, save, score."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted, resolve_label_columns, resolve_text_columns
from wattshelf.functions.fixed_values import CLASSIFIER_ROSTER, MAX_DF, MAX_FEATURES, MIN_DF, NGRAM_RANGE
from wattshelf.functions.text import clean_text, split_label
from wattshelf.operators.boosting import BoostSettings, SoftmaxTrees, fit_softmax_trees
from wattshelf.operators.forest import Forest, ForestSettings, fit_forest
from wattshelf.operators.logistic import SoftmaxRegression
from wattshelf.operators.metrics import best_classifier, classification_metrics, comparison_table
from wattshelf.operators.projection import add_composite_label, add_corpus, keep_labelled, resolve_request_text, sample_rows
from wattshelf.operators.ranks import broadcast_if_small
from wattshelf.operators.split import class_weights, dataset_fingerprint, label_counts, label_profile, train_test_split
from wattshelf.operators.tfidf import TfidfSettings, fit_vocabulary, vectorise, vectorizer
from wattshelf.session import materialise

LOGISTIC, BAYES, FOREST, EXTERNAL = CLASSIFIER_ROSTER
BOOSTED = "Gradient Boosted Trees"
RUN_COLUMNS = (
    "ordinal int, model_name string, accuracy double, precision double, recall double, f1_score double, "
    "status string, message string"
)


@dataclass(frozen=True)
class TrainingSettings:
    """``key`` names a unique row key; ``forest_trees=None`` and ``boosted_rounds=None`` leave those models out."""

    key: str
    text_columns: tuple[str, ...] | None = None
    category: str | None = None
    sub_category: str | None = None
    test_share: float = 0.2
    seed: int = 42
    sample_size: int | None = None
    max_features: int | None = MAX_FEATURES
    ngram_range: tuple[int, int] = NGRAM_RANGE
    min_df: int | float = MIN_DF
    max_df: int | float = MAX_DF
    average: str = "weighted"
    logistic_iterations: int = 1000
    forest_trees: int | None = 100
    forest_depth: int = 30
    boosted_rounds: int | None = 200
    boosted_depth: int = 6
    boosted_step: float = 0.3
    parallel_fits: int = 4

    @property
    def tfidf(self) -> TfidfSettings:
        return TfidfSettings(self.max_features, self.ngram_range, self.min_df, self.max_df)


@dataclass(frozen=True)
class BoostedTrees:
    """Boosted trees for all classes at once, with ``fit`` like a Spark estimator; they use no class weights."""

    settings: BoostSettings

    def fit(self, train: DataFrame) -> SoftmaxTrees:
        return fit_softmax_trees(train, self.settings)


@dataclass(frozen=True)
class RandomForest:
    """The library's forest, with ``fit`` like a Spark estimator."""

    settings: ForestSettings

    def fit(self, train: DataFrame) -> Forest:
        return fit_forest(train, self.settings)


@dataclass(frozen=True)
class Candidate:
    """A named estimator, or the reason why it does not run."""

    name: str
    estimator: Any | None
    skipped: str | None = None


@dataclass
class TrainingResult:
    best_model_name: str
    scorer: ProductScorer
    runs: DataFrame
    row_count: int
    train_row_count: int
    test_row_count: int
    feature_count: int
    text_columns: tuple[str, ...]
    category_column: str
    sub_category_column: str | None
    dataset_version: str
    model_version: str
    run_rows: list[dict[str, Any]] = field(default_factory=list)

    def report(self) -> DataFrame:
        """One row for the report sink and the run registry."""
        params = {
            "text_columns": ",".join(self.text_columns),
            "category_column": self.category_column,
            "sub_category_column": self.sub_category_column or "",
        }
        spark = self.runs.sparkSession
        return spark.createDataFrame(
            [
                (
                    f"{name_slug(row['model_name'])}-{self.model_version}",
                    row["model_name"],
                    self.model_version,
                    params,
                    {"dataset_version": self.dataset_version, "status": row["status"]},
                    {
                        "accuracy": row["accuracy"],
                        "precision": row["precision"],
                        "recall": row["recall"],
                        "f1_score": row["f1_score"],
                        "row_count": float(self.row_count),
                        "train_row_count": float(self.train_row_count),
                        "test_row_count": float(self.test_row_count),
                        "feature_count": float(self.feature_count),
                    },
                    datetime.strptime(self.model_version, "%Y%m%d%H%M%S"),
                )
                for row in self.run_rows
            ],
            "run_id string, model_name string, model_version string, params map<string,string>, "
            "tags map<string,string>, metrics map<string,double>, created_at timestamp",
        )


def name_slug(name: str) -> str:
    return "-".join(name.casefold().split())


def candidates(settings: TrainingSettings, weight_sum: float) -> list[Candidate]:
    """The roster in report order, then boosted trees, reading ``features``, ``label_index``, ``weight``.

    The roster's external booster is reported as skipped; the library's own boosted trees have a row of their own.
    """
    columns = {"featuresCol": "features", "labelCol": "label_index"}
    # unit inverse penalty on the summed loss
    logistic = SoftmaxRegression(settings.logistic_iterations, 1.0 / max(weight_sum, 1.0))
    bayes = NaiveBayes(modelType="multinomial", smoothing=1.0, **columns)
    listed = [Candidate(LOGISTIC, logistic), Candidate(BAYES, bayes)]
    if settings.forest_trees:
        forest = RandomForest(ForestSettings(settings.forest_trees, settings.forest_depth, settings.seed))
        listed.append(Candidate(FOREST, forest))
    listed.append(Candidate(EXTERNAL, None, "the library is not part of this engine"))
    if settings.boosted_rounds:
        trees = BoostSettings(settings.boosted_rounds, settings.boosted_depth, settings.boosted_step)
        listed.append(Candidate(BOOSTED, BoostedTrees(trees)))
    return listed


@dataclass(frozen=True)
class TrainingFrames:
    """Vectorised train and test rows; the train rows carry label index and class weight."""

    train: DataFrame
    test: DataFrame
    vectorizer: PipelineModel
    indexer: StringIndexerModel
    feature_count: int
    text_columns: tuple[str, ...]
    category: str
    sub_category: str | None
    counts: dict[str, int]


def prepare(df: DataFrame, settings: TrainingSettings) -> tuple[DataFrame, tuple[str, ...], str, str | None]:
    """(key, corpus, label) rows with a usable label."""
    rows = df if settings.sample_size is None else sample_rows(df, settings.sample_size, settings.key, settings.seed)
    category, sub_category = resolve_label_columns(df.columns, settings.category, settings.sub_category)
    text_columns = resolve_text_columns(df.columns, settings.text_columns)
    labelled = keep_labelled(rows, [name for name in (category, sub_category) if name])
    labelled = add_composite_label(labelled, category, sub_category, "label")
    with_text = add_corpus(labelled, text_columns, "corpus")
    return with_text.select(quoted(settings.key), "corpus", "label"), text_columns, category, sub_category


def training_frames(df: DataFrame, settings: TrainingSettings) -> TrainingFrames:
    """Prepared, split and vectorised rows, written once so that every fit reads the same.

    The vocabulary becomes part of the model, so it needs a bound: ``max_features=None`` is refused here (see
    ``tfidf.tfidf_rows`` for the form without one).
    """
    if settings.max_features is None:
        raise ValueError("training needs a bound on the vocabulary (max_features)")
    prepared, text_columns, category, sub_category = prepare(df, settings)
    prepared = materialise(prepared)
    if not label_profile(prepared, "label").first()["trainable"]:
        raise ValueError("training needs at least two different labels")
    split = train_test_split(prepared, settings.key, "label", settings.test_share, settings.seed)
    train, test = (split.filter(F.col("split") == part).drop("split") for part in ("train", "test"))

    vocabulary = fit_vocabulary(train, "corpus", settings.tfidf)
    vectors = vectorizer(vocabulary)
    # Every label of the train part is known, so no class is set aside for unknown ones.
    indexer = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc").fit(train)
    weights = class_weights(train, "label").select("label", "weight")
    weighted = indexer.transform(train).join(broadcast_if_small(weights, len(indexer.labels)), "label")
    train_rows = materialise(vectorise(weighted, "corpus", vectors, settings.tfidf).drop("corpus"))
    test_rows = materialise(vectorise(test, "corpus", vectors, settings.tfidf).drop("corpus"))
    counts = {"train": train_rows.count(), "test": test_rows.count()}
    size = len(vectors.stages[0].vocabulary)
    return TrainingFrames(
        train_rows, test_rows, vectors, indexer, size, text_columns, category, sub_category, counts
    )


@dataclass(frozen=True)
class FittedClassifier:
    """A fitted model, its labels, and an optional shift of the raw class scores.

    The shift makes naive Bayes use the plain class shares as prior, where Spark smooths them.
    """

    model: Model | SoftmaxTrees | Forest
    labels: tuple[str, ...]
    shift: tuple[float, ...] | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted_label`` and ``confidence``."""
        predicted = self.model.transform(df)
        named = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=list(self.labels))
        if self.shift is None:
            return named.transform(predicted.withColumn("confidence", confidence_of(predicted)))
        shift = F.array(*[F.lit(value) for value in self.shift])
        shifted = predicted.withColumn(
            "_raw", F.zip_with(vector_to_array("rawPrediction"), shift, lambda raw, by: raw + by)
        )
        highest = F.array_max("_raw")
        weights = F.transform("_raw", lambda raw: F.exp(raw - highest))
        total = F.aggregate(weights, F.lit(0.0), lambda sum_, weight: sum_ + weight)
        best = (F.array_position("_raw", highest) - 1).cast("double")
        return named.transform(shifted.withColumns({"confidence": F.lit(1.0) / total, "prediction": best})).drop("_raw")


def prior_shift(model: NaiveBayesModel, train: DataFrame, labels: Sequence[str]) -> tuple[float, ...]:
    """Log class shares minus the smoothed log priors of the model."""
    rows = {row["label"]: row["rows"] for row in label_counts(train, "label").collect()}
    total = sum(rows.values())
    return tuple(math.log(rows[label] / total) - float(pi) for label, pi in zip(labels, model.pi, strict=True))


def evaluate(predictions: DataFrame, average: str = "weighted") -> dict[str, float]:
    row = classification_metrics(predictions, "label", "predicted_label", average).first()
    return {name: row[name] for name in ("accuracy", "precision", "recall", "f1_score")}


def fit_candidates(
    frames: TrainingFrames, settings: TrainingSettings, roster: Sequence[Candidate] | None = None
) -> tuple[list[dict[str, Any]], dict[str, FittedClassifier]]:
    """A metrics row per candidate, and the fitted classifier for each that ran.

    Candidates are fitted side by side. Each row holds its test predictions as ``predictions`` (key, label,
    predicted_label, confidence), written once; the metrics are read from them.
    """
    roster = roster if roster is not None else candidates(settings, float(frames.counts["train"]))
    labels = tuple(frames.indexer.labels)

    def fit(candidate: Candidate) -> FittedClassifier | None:
        if candidate.estimator is None:
            return None
        model = candidate.estimator.fit(frames.train)
        shift = prior_shift(model, frames.train, labels) if isinstance(model, NaiveBayesModel) else None
        return FittedClassifier(model, labels, shift)

    with ThreadPoolExecutor(max(1, settings.parallel_fits)) as pool:
        fitted = list(pool.map(inheritable_thread_target(frames.train.sparkSession)(fit), roster))
    rows, models = [], {}
    for ordinal, (candidate, model) in enumerate(zip(roster, fitted, strict=True)):
        row: dict[str, Any] = {"ordinal": ordinal, "model_name": candidate.name, "message": candidate.skipped}
        if model is None:
            row |= {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1_score": 0.0, "status": "skipped"}
        else:
            models[candidate.name] = model
            predictions = materialise(
                model.predict(frames.test).select(quoted(settings.key), "label", "predicted_label", "confidence"), "predictions"
            )
            row |= evaluate(predictions, settings.average) | {"status": "trained", "predictions": predictions}
        rows.append(row)
    return rows, models


def run_frame(spark: SparkSession, rows: Sequence[dict[str, Any]]) -> DataFrame:
    names = [part.split()[0] for part in RUN_COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(row[name] for name in names) for row in rows], RUN_COLUMNS)


def train_and_select(df: DataFrame, settings: TrainingSettings) -> TrainingResult:
    """Fit and compare the classifiers, keep the best one ready for scoring."""
    frames = training_frames(df, settings)
    rows, models = fit_candidates(frames, settings)
    runs = run_frame(df.sparkSession, rows)
    chosen = best_classifier(runs).first()
    if chosen is None:
        raise RuntimeError("no classifier was trained")
    scorer = ProductScorer(frames.vectorizer, models[chosen["model_name"]], settings.tfidf)
    return TrainingResult(
        best_model_name=chosen["model_name"],
        scorer=scorer,
        runs=comparison_table(runs, best_classifier(runs)),
        row_count=sum(frames.counts.values()),
        train_row_count=frames.counts["train"],
        test_row_count=frames.counts["test"],
        feature_count=frames.feature_count,
        text_columns=frames.text_columns,
        category_column=frames.category,
        sub_category_column=frames.sub_category,
        dataset_version=dataset_fingerprint(df).first()["fingerprint"],
        model_version=datetime.now(UTC).strftime("%Y%m%d%H%M%S"),
        run_rows=rows,
    )


def confidence_of(df: DataFrame) -> Column:
    """The highest class probability."""
    shares = F.col("probability")
    return F.array_max(shares if df.schema["probability"].dataType.simpleString().startswith("array") else vector_to_array(shares))


@dataclass(frozen=True)
class ProductScorer:
    """Cleaning, vectorising, predicting and label splitting as one reusable transform."""

    vectorizer: PipelineModel
    classifier: FittedClassifier
    settings: TfidfSettings

    def score(self, df: DataFrame, text: str = "request_text") -> DataFrame:
        """Add cleaned text, category, sub-category and confidence; works on streams too."""
        kept = df.columns
        cleaned = df.withColumn("cleaned_text", clean_text(quoted(text)))
        vectors = vectorise(cleaned, "cleaned_text", self.vectorizer, self.settings)
        predicted = self.classifier.predict(vectors)
        parts = split_label(F.col("predicted_label"))
        return predicted.select(
            *[quoted(name) for name in kept],
            "cleaned_text",
            parts.getField("category").alias("predicted_category"),
            parts.getField("sub_category").alias("predicted_sub_category"),
            "confidence",
        )

    def save(self, path: str) -> None:
        base = path.rstrip("/")
        self.vectorizer.write().overwrite().save(f"{base}/vectorizer")
        spark, model = SparkSession.active(), self.classifier.model
        if isinstance(model, SoftmaxTrees | Forest):
            model.rows(spark).write.mode("overwrite").parquet(f"{base}/classifier")
        else:
            PipelineModel([model]).write().overwrite().save(f"{base}/classifier")
        values = {
            "trees": isinstance(model, SoftmaxTrees),
            "forest": isinstance(model, Forest),
            "tfidf": asdict(self.settings),
            "labels": self.classifier.labels,
            "shift": self.classifier.shift,
        }
        spark.createDataFrame([(json.dumps(values),)], "settings string").write.mode(
            "overwrite"
        ).json(f"{base}/settings")

    @staticmethod
    def load(path: str) -> ProductScorer:
        base = path.rstrip("/")
        stored = SparkSession.active().read.schema("settings string").json(f"{base}/settings").first()
        values = json.loads(stored["settings"])
        tfidf = values["tfidf"]
        settings = TfidfSettings(**(tfidf | {"ngram_range": tuple(tfidf["ngram_range"])}))
        if values["trees"]:
            model = SoftmaxTrees.from_rows(SparkSession.active().read.parquet(f"{base}/classifier"))
        elif values.get("forest"):
            model = Forest.from_rows(SparkSession.active().read.parquet(f"{base}/classifier"))
        else:
            model = PipelineModel.load(f"{base}/classifier").stages[0]
        shift = None if values["shift"] is None else tuple(values["shift"])
        classifier = FittedClassifier(model, tuple(values["labels"]), shift)
        return ProductScorer(PipelineModel.load(f"{base}/vectorizer"), classifier, settings)


def score_products(scorer: ProductScorer, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored requests, and the requests without any text."""
    resolved = resolve_request_text(requests)
    usable = resolved.filter(F.col("request_text").isNotNull())
    return scorer.score(usable), resolved.filter(F.col("request_text").isNull()).drop("request_text")


def naive_bayes_parameters(label_terms: DataFrame, terms: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(label, term, log_probability): ``ln((sum + a) / (class sum + a * V))`` for every pair.

    ``label_terms`` is (label, term) with a row per occurrence, or (label, term, term_sum) where they are counted; ``terms`` is the
    vocabulary. Occurrences are counted before they are joined, so texts need no join. The result is the model's matrix; pairs that a
    class never uses come from the class list inside each term row.
    """
    known = terms.select("term")
    if "term_sum" in label_terms.columns:
        sums = materialise(label_terms.join(known, "term").groupBy("label", "term").agg(F.sum("term_sum").alias("term_sum")))
    else:
        counted = label_terms.groupBy("label", "term").agg(F.count(F.lit(1)).alias("term_sum"))
        sums = materialise(counted.join(known, "term"))
    classes = sums.groupBy("label").agg(F.sum("term_sum").alias("class_sum"))
    # The list of classes and the vocabulary size are single values, computed once as subqueries.
    roster = classes.agg(F.collect_list(F.struct("label", "class_sum"))).scalar()
    size = terms.agg(F.count(F.lit(1))).scalar()
    pairs = (
        terms.select("term", size.alias("v"), roster.alias("classes"))
        .select("term", "v", F.explode("classes").alias("c"))
        .select("term", "v", "c.*")
    )
    numerator = F.coalesce("term_sum", F.lit(0)) + F.lit(smoothing)
    return pairs.join(sums, ["label", "term"], "left").select(
        "label",
        "term",
        F.log(numerator / (F.col("class_sum") + F.lit(smoothing) * F.col("v"))).alias("log_probability"),
    )

