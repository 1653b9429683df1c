import math
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wattshelf.functions.text import clean_text
from wattshelf.operators import tfidf
from wattshelf.operators.projection import add_corpus
from wattshelf.sources.tables import write_features

NAMES = ["Apple iPhone with fast charger", "Samsung phone with wireless charger", "Cotton running shoes for men"]
EVERYTHING = tfidf.TfidfSettings(min_df=1, max_df=1.0)


def corpus(spark, texts=NAMES):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    return rows.withColumn("corpus", clean_text(F.col("name")))


def by_hand(texts, min_df=1, max_df=1.0, cap=50_000):
    """Counts, smooth idf and unit rows from the definition."""
    grams = []
    for text in texts:
        words = [w for w in text.split() if len(w) > 1]
        grams.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    df = Counter(term for g in grams for term in g)
    cf = Counter()
    for g in grams:
        cf.update(g)
    n = len(texts)
    high = max_df * n if isinstance(max_df, float) else max_df
    low = min_df * n if isinstance(min_df, float) else min_df
    kept = sorted((t for t in df if low <= df[t] <= high), key=lambda t: (-cf[t], t))[:cap]
    index = {t: i for i, t in enumerate(sorted(kept))}
    cells = {}
    for i, g in enumerate(grams):
        weights = {t: g[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in g if t in index}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cells |= {(i, index[t]): w / norm for t, w in weights.items()}
    return index, cells


@pytest.mark.parametrize("settings", [EVERYTHING, tfidf.TfidfSettings(max_features=5, min_df=1, max_df=1.0), tfidf.TfidfSettings(min_df=2, max_df=3)])
def test_matrix_equals_definition(spark, settings):
    rows = corpus(spark)
    texts = [r["corpus"] for r in rows.orderBy("id").collect()]
    index, cells = by_hand(texts, settings.min_df, settings.max_df, settings.max_features)
    vocabulary = tfidf.fit_vocabulary(rows, "corpus", settings)
    assert {r["term"]: r["term_idx"] for r in vocabulary.collect()} == index
    features = tfidf.vectorise(rows, "corpus", tfidf.vectorizer(vocabulary), settings)
    got = {(r["id"], r["term_idx"]): r["tfidf"] for r in tfidf.matrix_cells(features, ["id"]).collect()}
    assert got.keys() == cells.keys()
    assert all(math.isclose(got[k], cells[k], rel_tol=1e-12) for k in cells)


def test_vocabulary_of_product_names(spark):
    rows = corpus(spark)
    vocabulary = tfidf.fit_vocabulary(rows, "corpus", EVERYTHING)
    terms = {r["term"] for r in vocabulary.collect()}
    assert {"iphone", "apple iphone", "charger"} <= terms and "with" not in terms
    summary = tfidf.feature_summary_row(rows, vocabulary, ["name"]).first()
    assert summary["row_count"] == 3 and summary["feature_count"] == len(terms)


def test_joined_form_and_uncapped_vocabulary(spark):
    settings = tfidf.TfidfSettings(max_features=None, min_df=1, max_df=1.0)
    rows = corpus(spark)
    vocabulary = tfidf.fit_vocabulary(rows, "corpus", settings)
    index, cells = by_hand([r["corpus"] for r in rows.orderBy("id").collect()])
    assert {r["term"]: r["term_idx"] for r in vocabulary.collect()} == index
    got = {(r["id"], index[r["term"]]): r["tfidf"] for r in tfidf.tfidf_rows(rows, "id", "corpus", vocabulary, settings).collect()}
    assert got.keys() == cells.keys() and all(math.isclose(got[k], cells[k]) for k in cells)


def test_texts_are_shuffled_and_their_terms_are_not(spark):
    rows = corpus(spark, [*NAMES, NAMES[0]]).withColumn("id", F.when(F.col("id") > 0, F.col("id") % 3))
    counted = tfidf.term_frequencies(rows, "id", "corpus", EVERYTHING)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    got = {(r["id"], r["term"]): r["tf"] for r in counted.collect()}
    assert got[None, "iphone"] == 1 and got[1, "samsung phone"] == 1 and got[0, "iphone"] == 1
    assert len(got) == counted.count() and sum(got.values()) == 3 * 7 + 7  # four words and three pairs in each of four texts


def test_cap_takes_most_frequent_terms(spark):
    counts = spark.range(2000).select(
        F.format_string("t%04d", F.col("id")).alias("term"), (F.col("id") % 700 + 1).alias("cf"), F.lit(1).alias("df")
    )
    rows = {r["term"] for r in tfidf.most_frequent(counts, 100).collect()}
    expected = sorted(((r["term"], r["cf"]) for r in counts.collect()), key=lambda x: (-x[1], x[0]))[:100]
    assert rows == {term for term, _ in expected}
    assert tfidf.most_frequent(counts, 5000).count() == 2000


def test_unseen_text_may_be_empty(spark):
    model = tfidf.vectorizer(tfidf.fit_vocabulary(corpus(spark), "corpus", EVERYTHING))
    rows = tfidf.vectorise(corpus(spark, ["charger charger", "zzz", ""]), "corpus", model, EVERYTHING)
    sizes = {r["id"]: r["features"].numNonzeros() for r in rows.collect()}
    assert sizes == {0: 1, 1: 0, 2: 0}


def test_two_columns(spark):
    rows = spark.createDataFrame(
        [("Laptop stand", "Adjustable desk stand"), ("Gaming mouse", None)], "product_name string, description string"
    )
    vocabulary = tfidf.fit_vocabulary(add_corpus(rows), "corpus", EVERYTHING)
    assert "stand adjustable" in {r["term"] for r in vocabulary.collect()}


def test_limits(spark):
    assert tfidf.document_bounds(10, tfidf.TfidfSettings(min_df=2, max_df=0.95)) == (2, 9.5)
    assert tfidf.document_bounds(10, tfidf.TfidfSettings(min_df=0.1, max_df=1.0)) == (1.0, 10.0)
    with pytest.raises(ValueError):
        tfidf.document_bounds(10, tfidf.TfidfSettings(min_df=2, max_df=1))
    with pytest.raises(ValueError):
        tfidf.vectorizer(tfidf.fit_vocabulary(corpus(spark, ["a", "b"]), "corpus", EVERYTHING))


def test_features_and_model_survive_storage(spark, tmp_path):
    rows = corpus(spark)
    vocabulary = tfidf.fit_vocabulary(rows, "corpus", EVERYTHING)
    model = tfidf.vectorizer(vocabulary)
    features = tfidf.vectorise(rows, "corpus", model, EVERYTHING).select("id", "features")
    paths = write_features(features, vocabulary, str(tmp_path / "store"))
    stored = {r["id"]: r["features"] for r in spark.read.parquet(paths["features"]).collect()}
    model.write().overwrite().save(str(tmp_path / "model"))
    again = tfidf.vectorise(rows, "corpus", PipelineModel.load(str(tmp_path / "model")), EVERYTHING)
    assert stored == {r["id"]: r["features"] for r in again.collect()}
    assert spark.read.parquet(paths["vocabulary"]).count() == vocabulary.count()


def test_terms_are_tokenised_once(spark):
    plan = tfidf.term_statistics(corpus(spark), "corpus", EVERYTHING)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("words_per_block", [1, 7, 1 << 20])
@pytest.mark.parametrize("ngram_range", [(1, 1), (1, 2), (2, 3)])
def test_terms_are_counted_in_blocks_of_texts(spark, words_per_block, ngram_range):
    texts = ["aa bb aa bb aa", None, "", "bb", "x aa bb", "aa bb aa bb aa", "cc " * 9, "dd aa"]
    labels = ["u", "u", None, "v", None, "v", "u", "u"]
    rows = spark.createDataFrame(list(zip(texts, labels)), "corpus string, label string").repartition(2)
    expected = {}
    for text, label in zip(texts, labels):
        words = [w for w in (text or "").split() if len(w) > 1]
        grams = Counter(" ".join(words[i : i + n]) for n in range(ngram_range[0], ngram_range[1] + 1) for i in range(len(words) - n + 1))
        for term, times in grams.items():
            df, cf = expected.get((label, term), (0, 0))
            expected[label, term] = (df + 1, cf + times)
    settings = tfidf.TfidfSettings(ngram_range=ngram_range, min_df=1, max_df=1.0)
    got = tfidf.term_statistics(rows, "corpus", settings, ["label"], words_per_block)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row per occurrence
    found = got.collect()
    assert {(r["label"], r["term"]): (r["df"], r["cf"]) for r in found} == expected and len(found) == len(expected)
    whole = {r["term"]: r["cf"] for r in tfidf.term_statistics(rows, "corpus", settings, words_per_block=words_per_block).collect()}
    assert whole == {t: sum(cf for (_, u), (_, cf) in expected.items() if u == t) for _, t in expected}
    again = tfidf.fit_vocabulary(rows, "corpus", settings, got).collect()
    assert sorted(again) == sorted(tfidf.fit_vocabulary(rows, "corpus", settings).collect())
