"""Benchmark decontamination: token windows of documents against a broadcast hash set of benchmark n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshelf.llm.common import fresh, keep_rows, map_rows, parts_for, plain_words, windows_hash
from wattshelf.session import materialise

WINDOW = 10
#: Words of benchmark text in one broadcast block (about 100 bytes each in a task); more text means more blocks.
WORDS_PER_BLOCK = 1_000_000


def item_blocks(benchmark: DataFrame, words_per_block: int) -> list[list[tuple[str, list[bytes]]]]:
    """The benchmark's items as blocks of at most about ``words_per_block`` words, read one block at a time.

    The benchmark is the query set; its blocks are dealt by a hash of the item and fetched one by one, so
    the driver holds a single block.
    """
    sizes = benchmark.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n_blocks = parts_for(sizes, words_per_block * 5)
    dealt = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), "text",
        F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).alias("block"),
    )
    for block in range(n_blocks):
        rows = dealt.filter(F.col("block") == block).select("item_id", "text").collect()
        yield [(r["item_id"], words) for r in rows if r["item_id"] is not None and (words := plain_words(r["text"]))]


def ngram_index(items: list[tuple[str, list[bytes]]], window: int) -> dict:
    """Vocabulary, and per window length the sorted hashes with their words and items."""
    vocabulary: dict[bytes, int] = {}
    grams: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, words in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        width = min(window, len(ids))
        held = grams.setdefault(width, {})
        for i in range(len(ids) - width + 1):
            held.setdefault(tuple(ids[i : i + width]), set()).add(item)
    index = {}
    for width, held in grams.items():
        keys = list(held)
        hashes = windows_hash(np.array(keys, np.uint64).ravel(), width)[::width] if keys else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        index[width] = (hashes[order], [keys[i] for i in order], [sorted(held[keys[i]]) for i in order])
    return {"vocabulary": vocabulary, "widths": index}


def find_hits(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Verified occurrences as (start, end) in words, and the items they belong to."""
    lookup = index["vocabulary"].get
    ids = np.array([lookup(w, 0) for w in words], np.uint64)
    spans, items = [], set()
    for width, (hashes, keys, owners) in index["widths"].items():
        seen = windows_hash(ids, width)
        if not len(seen):
            continue
        at = np.searchsorted(hashes, seen)
        at[at == len(hashes)] = 0
        for start in np.flatnonzero(hashes[at] == seen):
            found = tuple(ids[start : start + width].tolist())
            k = int(at[start])
            while k < len(keys) and hashes[k] == seen[start]:
                if keys[k] == found:
                    spans.append((int(start), int(start) + width))
                    items.update(owners[k])
                k += 1
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """One row per document: doc_id, text, n_words, hits (start, end, start, ...), items.

    Blocks of benchmark n-grams are scanned one after the other; the documents' rows go through each scan
    unchanged but for what it adds, so a larger benchmark costs passes, not memory.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind},text string,n_words bigint,hits array<bigint>,items array<string>"
    current = docs.select(
        "doc_id", "text", F.array().cast("array<bigint>").alias("hits"), F.array().cast("array<string>").alias("items")
    )
    for k, items in enumerate(item_blocks(benchmark, words_per_block)):
        if k:
            current = materialise(current, "scan")
        shared = spark.sparkContext.broadcast(ngram_index(items, window))

        def factory(shared=shared):
            def step(batch):
                index = shared.value
                out = {"doc_id": batch["doc_id"], "text": batch["text"], "n_words": [], "hits": [], "items": []}
                for text, old, names in zip(*(batch[c].to_pylist() for c in ("text", "hits", "items"))):
                    words = plain_words(text)
                    spans, more = find_hits(words, index)
                    merged = _merged([*zip(old[::2], old[1::2]), *spans])
                    out["n_words"].append(len(words))
                    out["hits"].append([x for pair in merged for x in pair])
                    out["items"].append(sorted({*names, *more}))
                return out

            return step

        current = map_rows(current, factory, schema, ["doc_id", "text", "hits", "items"])
    return current


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_block: int = WORDS_PER_BLOCK
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, text_key.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``window``
    consecutive words of an item; an item of fewer words is one window. Hash hits are verified word by
    word. ``hits`` lists the hit runs as start, end, start, end ... in words, so that spans can be cut.

    Null or empty texts have no words and no hits; null or empty items have no window, an item without
    id is ignored; repeated rows are judged alike; an empty benchmark hits nothing; other columns are ignored.
    """
    found = scan(docs, benchmark, window, words_per_block)
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "hits",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that no benchmark window hits; same columns.

    Null and empty texts stay, as nothing hits them; rows that repeat a document are judged alike; an empty table
    stays empty and an empty benchmark keeps all; extra columns of any name pass through.
    """
    judged = decontaminate(docs, benchmark, **settings).filter("contaminated")
    (key,) = fresh(docs.columns, "_text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    bad = judged.select("doc_id", F.col("text_key").alias(key))
    return keep_rows(keyed, bad, ["doc_id", key], "left_anti").drop(key)
