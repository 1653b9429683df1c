"""The numbered queries, with production parameters over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wattshelf.llm import (
    checks, decontaminate, fill_middle, licenses, line_rules, manifest, mixing, near_join, pii, seed_extend, suffix_dedup, token_store,
    urls, warc,
)
from wattshelf.llm.common import table, tokenizer_file
from wattshelf.plans.catalog.registry import Query
from wattshelf.session import scratch_path

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

#: The rules of the URL query.
URL_RULES = (
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
)


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            CHECKS[name] = sql
        return function

    return add


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op2_mixing", checks.MIXING)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "whole", "extra")


@query("op3_suffix_dedup", checks.SUFFIX)
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_token_store")
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_store.read_tokens(spark, path)


@query("op5_line_rules", checks.LINE_RULES)
def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = line_rules.judge_documents(table(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


@query("op6_near_join", checks.NEAR_JOIN)
def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_warc", checks.WARC)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to")
    )


@query("op8_licenses")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


#: Pages that show a mail address go on the list of URLs to block.
MAIL = r"[a-z0-9]@[a-z0-9-]+\.[a-z]"


@query("op9_urls", checks.URLS)
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(F.col("html").contains("@") & F.col("html").rlike(MAIL)).select("url")
    return urls.filter_urls(pages, listed, URL_RULES)


@query("op10_decontaminate", checks.DECONTAMINATE)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op11_manifest", checks.MANIFEST)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents lose their line feeds; their leaves no longer lead to the root."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.translate("text", "\n", "") if name == "text" else F.col(name) for name in manifest.FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    built = manifest.manifest(docs, carry=[F.when(chosen, manifest.leaf_digest(fields))])
    folded = manifest.fold(F.coalesce(F.col("carried")[0], "leaf"), F.col("proof"))
    return built.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_seed_extend", checks.SEED_EXTEND)
def op12_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend.remove_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op13_fill_middle", checks.FILL_MIDDLE)
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
