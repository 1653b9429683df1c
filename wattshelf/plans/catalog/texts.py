"""Text cleaning and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions import text as t
from wattshelf.operators import tfidf
from wattshelf.operators.lemmas import lemmatise
from wattshelf.operators.projection import clean_columns
from wattshelf.plans import views as v
from wattshelf.plans.catalog.registry import query

SETTINGS = tfidf.TfidfSettings()


@query(
    "strip_html",
    f"SELECT page_id, regexp_replace({v.sql_decode('html')}, '<[^>]+>', ' ', 'g') AS text FROM pages",
)
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.load_texts(spark, sf_dir, "pages").select("page_id", t.strip_html(F.col("html")).alias("text"))


@query(
    "strip_urls",
    """SELECT page_id, regexp_replace('see ' || url || ' and www.' || url || ' then ' || html,
         'https?://[^\\s\\p{Z}]+|www\\.[^\\s\\p{Z}]+', ' ', 'g') AS text FROM pages""",
)
def strip_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    joined = F.concat(F.lit("see "), url, F.lit(" and www."), url, F.lit(" then "), F.col("html"))
    return v.load_texts(spark, sf_dir, "pages").select("page_id", t.strip_urls(joined).alias("text"))


@query(
    "strip_punct",
    "SELECT doc_id, regexp_replace(text, '[!-/:-@\\[-`{-~]', ' ', 'g') AS text FROM documents",
)
def strip_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.load_texts(spark, sf_dir, "documents").select("doc_id", t.strip_punctuation(F.col("text")).alias("text"))


@query("clean_text", f"SELECT doc_id, {v.sql_clean('text')} AS text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.load_texts(spark, sf_dir, "documents").select("doc_id", t.clean_text(F.col("text")).alias("text"))


@query("clean_pages", f"SELECT page_id, {v.sql_clean(v.sql_decode('html'))} AS text FROM pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.load_texts(spark, sf_dir, "pages").select("page_id", t.clean_text(F.col("html")).alias("text"))


@query(
    "remove_stopwords",
    f"""SELECT doc_id, array_to_string(list_filter(string_split({v.sql_words('text')}, ' '),
          lambda w: w NOT IN ({v.STOP})), '|') AS kept, CAST(len(list_filter(string_split({v.sql_words('text')}, ' '),
          lambda w: w IN ({v.STOP}))) AS INTEGER) AS dropped FROM documents""",
)
def remove_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = t.split_words(t.clean_words(F.col("text")))
    docs = v.load_texts(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    kept = t.drop_stop_words(F.col("words"))
    return docs.select("doc_id", F.array_join(kept, "|").alias("kept"), (F.size("words") - F.size(kept)).alias("dropped"))


@query(
    "clean_products",
    f"""WITH {v.PRODUCTS_DIRTY} SELECT row_id, {v.sql_clean('product_name')} AS product_name_cleaned,
          {v.sql_clean('description')} AS description_cleaned FROM products_dirty_v""",
)
def clean_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_columns(v.products_dirty(spark, sf_dir))
    return rows.select("row_id", "product_name_cleaned", "description_cleaned")


LEMMA_SOURCE = f"""lemma_v AS (SELECT DISTINCT w AS token, substr(w, 1, length(w) - 1) AS lemma FROM
  (SELECT unnest(string_split({v.sql_words('text')}, ' ')) AS w FROM benchmark) WHERE w LIKE '%s' AND length(w) > 3)"""


@query(
    "lemma_lookup",
    f"""WITH {v.CORPUS}, {LEMMA_SOURCE}, words_v AS (
          SELECT doc_id, unnest(string_split(corpus, ' ')) AS token, generate_subscripts(string_split(corpus, ' '), 1) AS pos
          FROM corpus_v)
        SELECT doc_id, coalesce(string_agg(coalesce(lemma, token), ' ' ORDER BY pos), '') AS lemmatised
        FROM words_v LEFT JOIN lemma_v USING (token) GROUP BY doc_id""",
)
def lemma_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words with a final s and their stem as the lemma table, applied to the documents."""
    words = v.load(spark, sf_dir, "benchmark").select(F.explode(t.split_words(t.clean_words(F.col("text")))).alias("token"))
    lemmas = words.filter(F.col("token").endswith("s") & (F.length("token") > 3)).distinct()
    lemmas = lemmas.withColumn("lemma", F.expr("substring(token, 1, length(token) - 1)"))
    docs = v.corpus(spark, sf_dir).select("doc_id", "corpus")
    return lemmatise(docs, "doc_id", "corpus", lemmas).select("doc_id", "lemmatised")


# --- TF-IDF -------------------------------------------------------------------------------


@query("tokens", f"WITH {v.TOKENS} SELECT doc_id, array_to_string(t, '|') AS tokens, CAST(len(t) AS INTEGER) AS n FROM tokens_v")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.corpus(spark, sf_dir).select("doc_id", t.tokens(F.col("corpus")).alias("t"))
    return rows.select("doc_id", F.array_join("t", "|").alias("tokens"), F.size("t").alias("n"))


@query(
    "ngrams",
    f"""WITH {v.TOKENS} SELECT doc_id, array_to_string(list_concat(t, list_transform(range(1, len(t)),
          lambda i: t[i] || ' ' || t[i + 1])), '|') AS terms FROM tokens_v""",
)
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = tfidf.terms_of(F.col("corpus"), SETTINGS)
    return v.corpus(spark, sf_dir).select("doc_id", F.array_join(terms, "|").alias("terms"))


@query("term_freq", f"WITH {v.GRAMS} SELECT doc_id, term, tf FROM tf_v")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.term_frequencies(v.corpus(spark, sf_dir), "doc_id", "corpus", SETTINGS)


@query("vocab_df", f"WITH {v.VOCAB} SELECT term, df, cf FROM vocab_all_v")
def vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.corpus(spark, sf_dir)
    low, high = tfidf.document_bounds(v.load(spark, sf_dir, "documents").count(), SETTINGS)
    return tfidf.term_statistics(docs, "corpus", SETTINGS).filter(F.col("df").between(low, high))


@query("vocab_topk", f"WITH {v.VOCAB} SELECT term, CAST(term_idx AS INTEGER) AS term_idx, df, cf FROM vocab_v")
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.fit_vocabulary(v.corpus(spark, sf_dir), "corpus", SETTINGS).drop("idf")


@query("idf", f"WITH {v.VOCAB} SELECT term, round(idf, 6) AS idf FROM vocab_v")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.fit_vocabulary(v.corpus(spark, sf_dir), "corpus", SETTINGS).select("term", F.round("idf", 6).alias("idf"))


@query(
    "tfidf_matrix",
    f"""WITH {v.VOCAB}, w_v AS (SELECT doc_id, term_idx, tf * idf AS w FROM tf_v JOIN vocab_v USING (term))
        SELECT doc_id, CAST(term_idx AS INTEGER) AS term_idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w_v""",
)
def tfidf_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.corpus(spark, sf_dir)
    model = tfidf.vectorizer(tfidf.fit_vocabulary(docs, "corpus", SETTINGS))
    cells = tfidf.matrix_cells(tfidf.vectorise(docs, "corpus", model, SETTINGS), ["doc_id"])
    return cells.withColumn("tfidf", F.round("tfidf", 6))


@query(
    "tfidf_joined",
    f"""WITH {v.VOCAB}, w_v AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w
          FROM tf_v JOIN vocab_all_v USING (term), n_v)
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w_v""",
)
def tfidf_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form without a vocabulary cap."""
    uncapped = tfidf.TfidfSettings(max_features=None)
    docs = v.corpus(spark, sf_dir)
    vocabulary = tfidf.fit_vocabulary(docs, "corpus", uncapped)
    rows = tfidf.tfidf_rows(docs, "doc_id", "corpus", vocabulary, uncapped)
    return rows.withColumn("tfidf", F.round("tfidf", 6))


UNSEEN = f"""unseen_v AS (SELECT conv_id, turn, {v.sql_tokens(v.sql_clean('text'))} AS t FROM conversations),
unseen_tf_v AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(list_concat(t,
  list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM unseen_v) GROUP BY ALL),
unseen_w_v AS (SELECT conv_id, turn, term_idx, tf * idf AS w FROM unseen_tf_v JOIN vocab_v USING (term))"""


@query(
    "tfidf_transform",
    f"""WITH {v.VOCAB}, {UNSEEN} SELECT c.conv_id, c.turn, CAST(count(w) AS INTEGER) AS known_terms,
          round(coalesce(max(w) / sqrt(sum(w * w)), 0), 6) AS highest
        FROM conversations c LEFT JOIN unseen_w_v u ON c.conv_id = u.conv_id AND c.turn = u.turn GROUP BY c.conv_id, c.turn""",
)
def tfidf_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary fitted on documents applied to conversation turns; unknown terms drop out."""
    model = tfidf.vectorizer(tfidf.fit_vocabulary(v.corpus(spark, sf_dir), "corpus", SETTINGS))
    turns = v.load_texts(spark, sf_dir, "conversations").select(
        "conv_id", "turn", t.clean_text(F.col("text")).alias("corpus")
    )
    values = F.unwrap_udt("features")["values"]
    rows = tfidf.vectorise(turns, "corpus", model, SETTINGS).select("conv_id", "turn", values.alias("x"))
    return rows.select(
        "conv_id",
        "turn",
        F.size("x").alias("known_terms"),
        F.round(F.coalesce(F.array_max("x"), F.lit(0.0)), 6).alias("highest"),
    )


@query(
    "tfidf_summary",
    f"""WITH {v.VOCAB} SELECT (SELECT n FROM n_v) AS row_count, (SELECT count(*) FROM vocab_v) AS feature_count,
          'text' AS text_columns""",
)
def tfidf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.corpus(spark, sf_dir)
    vocabulary = tfidf.fit_vocabulary(docs, "corpus", SETTINGS)
    return tfidf.feature_summary_row(docs.select("doc_id"), vocabulary, ["text"])
