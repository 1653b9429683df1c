"""Substring removal by seed and extend: winnowed anchors meet, matches grow both ways, long repeats go."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshelf.llm.common import map_rows, mix64, space_words
from wattshelf.llm.urls import block_count, bloom_blocks, maybe_listed
from wattshelf.session import materialise

#: A repeat of so many words is removed; seeds are runs of so many words.
LENGTH = 35
SEED = 16
BASE = 0x9E3779B97F4A7C15
KEY = "k1 bigint,k2 bigint"


class WordIds:
    """64-bit ids of words, kept per task up to a bounded number of words."""

    def __init__(self) -> None:
        self.held: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        held = self.held
        if len(held) > 1_000_000:
            held.clear()
        try:
            return np.array([held[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in held:
                    held[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([held[w] for w in words], np.uint64)


class RunHashes:
    """Hashes of arbitrary runs of a word list, from prefix sums of one polynomial."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        if len(RunHashes._powers) < n + 1:
            size = max(2 * n, 1 << 16)
            for name, base in (("_powers", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(RunHashes, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ids * RunHashes._powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * RunHashes._inverse[start] + (end - start).astype(np.uint64))


def seed_hashes(ids: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of all runs of ``seed`` words, by other numbers than ``RunHashes`` uses."""
    out = np.zeros(len(ids) - seed + 1, np.uint64)
    for i in range(seed):
        out = out * np.uint64(0xD6E8FEB86659FD93) + (ids[i : i + len(out)] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return mix64(out)


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` consecutive values, by doubling."""
    pick = np.minimum if least else np.maximum
    have = 1
    while 2 * have <= width:
        values = pick(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def winnow(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of every hash that some window of ``width`` hashes chooses: its last least one.

    Which hash a window chooses follows from its content alone, so equal windows choose equal anchors. Every window
    chooses one position; the windows that choose the same one stand next to each other.
    """
    windows = sliding(hashes, width)
    # the largest of the minima of the windows that hold a position is its own value if one of them chose it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), windows, np.zeros(width - 1, np.uint64)])
    position = np.flatnonzero(sliding(padded, width, least=False) == hashes)
    offsets = np.arange(width)
    first, last = np.empty(len(position), np.int64), np.empty(len(position), np.int64)
    for at in range(0, len(position), 65_536):
        p = position[at : at + 65_536]
        chose = padded[p[:, None] + offsets] == hashes[p][:, None]
        first[at : at + 65_536] = p - (width - 1) + chose.argmax(1)
        last[at : at + 65_536] = p - chose[:, ::-1].argmax(1)
    # where an equal hash follows inside the window, the window chooses that one
    order = np.lexsort((position, hashes[position]))
    here, after = order[:-1], order[1:]
    equal = hashes[position[here]] == hashes[position[after]]
    last[here[equal]] = np.minimum(last[here[equal]], position[after[equal]] - width)
    chosen = last >= first
    return position[chosen], first[chosen], last[chosen]


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text (null like empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Per text: k1, k2, n_words, and its anchors as arrays (seed, reach, position, first, last).

    ``seed`` is the hash of the anchor's words, ``reach`` that of all words of the windows that chose it, with the
    anchor's place in them.
    """

    def factory():
        number = WordIds()

        def step(batch):
            out = {"k1": batch["k1"], "k2": batch["k2"], **{c: [] for c in ("n_words", "seed", "reach", "position", "first", "last")}}
            for text in batch["text"].to_pylist():
                words = space_words(text)
                found = [np.empty(0, np.int64)] * 5
                if len(words) >= length:
                    ids = number(words)
                    seeds = seed_hashes(ids, seed)
                    position, first, last = winnow(seeds, length - seed + 1)
                    reach = RunHashes(ids)(first, last + length) + mix64((position - first).astype(np.uint64))
                    found = [seeds[position].view(np.int64), reach.view(np.int64), position, first, last]
                out["n_words"].append(len(words))
                for name, values in zip(("seed", "reach", "position", "first", "last"), found):
                    out[name].append(values)
            return out

        return step

    keyed = docs.select(*text_key(F.col("text")), "text")
    arrays = "seed array<bigint>,reach array<bigint>,position array<int>,first array<int>,last array<int>"
    return map_rows(keyed, factory, f"{KEY},n_words bigint,{arrays}", ["k1", "k2", "text"])


def window_keys(texts: DataFrame, length: int) -> DataFrame:
    """A row per window of the named anchors: seed, window (hash of its words), k1, k2, start, weight, asked.

    ``texts`` holds a text with the lists position, first, last, seed, weight, asked of its anchors to open.
    """

    def factory():
        number = WordIds()

        def step(batch):
            parts: dict[str, list] = {c: [] for c in ("seed", "window", "k1", "k2", "start", "weight", "asked")}
            columns = [batch[c].to_pylist() for c in ("k1", "k2", "text", "wanted")]
            for k1, k2, text, wanted in zip(*columns):
                hashes = RunHashes(number(space_words(text)))
                first = np.array([w["first"] for w in wanted], np.int64)
                last = np.array([w["last"] for w in wanted], np.int64)
                counts = last - first + 1
                start = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                spread = lambda name, kind: np.repeat(np.array([w[name] for w in wanted], kind), counts)  # noqa: E731, B023
                parts["start"].append(start)
                parts["window"].append(hashes(start, start + length).view(np.int64))
                parts["seed"].append(spread("seed", np.int64))
                parts["weight"].append(spread("weight", np.int64))
                parts["asked"].append(spread("asked", np.bool_))
                parts["k1"].append(np.full(len(start), k1, np.int64))
                parts["k2"].append(np.full(len(start), k2, np.int64))
            return {name: np.concatenate(values) for name, values in parts.items()}

        return step

    schema = f"seed bigint,window bigint,{KEY},start bigint,weight bigint,asked boolean"
    return map_rows(texts, factory, schema, ["k1", "k2", "text", "wanted"])


def with_texts(docs: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """(k1, k2, text, ...): each text that ``wanted`` names, with its columns, once.

    A Bloom filter of the names keeps other texts out of the shuffle; the join is exact.
    """
    named = wanted.withColumn("_name", F.concat_ws(":", "k1", "k2"))
    n_blocks = block_count(named.count())
    keyed = docs.select(*text_key(F.col("text")), "text").withColumn("_name", F.concat_ws(":", "k1", "k2"))
    near = maybe_listed(keyed, "_name", bloom_blocks(named, "_name", n_blocks), n_blocks).filter("maybe")
    one = near.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return one.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", *columns)


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts is (k1, k2, copies, n_words); spans is (k1, k2, spans): the (first word, end) of what repeats.

    Texts that stand in several rows repeat as a whole and have no spans of their own.
    """
    held = materialise(
        anchors(docs, length, seed)
        .groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("n_words", "seed", "reach", "position", "first", "last")).alias("t"))
        .select("k1", "k2", "copies", "t.*"),
        "anchors",
    )
    zipped = F.explode(F.arrays_zip("seed", "reach", "position", "first", "last")).alias("a")
    all_anchors = held.select("k1", "k2", "copies", zipped).select("k1", "k2", "copies", "a.*")
    # Seeds: documents join on anchors that stand in two places at least.
    # Counts are written before a join, so that the join reads two plain shuffles and Spark can split a hot seed.
    shared = materialise(all_anchors.groupBy(F.col("seed").alias("_seed")).agg(F.sum("copies").alias("_n")).filter("_n > 1"), "shared-seeds")
    seeded = materialise(all_anchors.join(shared, F.col("seed") == F.col("_seed")).drop("_seed", "_n"), "seeded")
    # Extension in full: seeds whose whole reach, to the left and to the right, stands in two places at least.
    place = F.struct("k1", "k2", "position", "first", "last")
    classes = materialise(
        seeded.groupBy("seed", "reach").agg(F.sum("copies").alias("n"), F.min(place).alias("one")), "seed-classes"
    )
    grown = classes.filter("n > 1").select(F.col("seed").alias("_seed"), F.col("reach").alias("_reach"))
    whole = seeded.join(grown, (F.col("seed") == F.col("_seed")) & (F.col("reach") == F.col("_reach"))).select(
        "k1", "k2", F.col("first").cast("bigint").alias("a"), (F.col("last") + length).cast("bigint").alias("b")
    )
    # Extension in part: the others grow left and right as far as one window does, against one place of each class.
    per_seed = classes.groupBy(F.col("seed").alias("_seed")).agg(F.count(F.lit(1)).alias("_all"), F.min("n").alias("_least"))
    open_seeds = materialise(per_seed.filter("_all > 1 AND _least = 1"), "open-seeds")
    partial = classes.join(open_seeds, F.col("seed") == F.col("_seed"))
    wanted = partial.select(
        "one.k1", "one.k2",
        F.struct("one.first", "one.last", "seed", F.col("n").alias("weight"), (F.col("n") == 1).alias("asked")).alias("w"),
    ).groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    windows = materialise(window_keys(with_texts(docs, materialise(wanted, "wanted"), "wanted"), length), "windows")
    sums = windows.groupBy(F.col("seed").alias("_seed"), F.col("window").alias("_window")).agg(F.sum("weight").alias("_n"))
    repeated = materialise(sums.filter("_n > 1"), "repeated-windows")
    parts = windows.filter("asked").join(repeated, (F.col("seed") == F.col("_seed")) & (F.col("window") == F.col("_window"))).select(
        "k1", "k2", F.col("start").alias("a"), (F.col("start") + length).alias("b")
    )
    spans = whole.unionByName(parts).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    return held.select("k1", "k2", "copies", "n_words"), spans


def remove_substrings(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_words (joined by one space), kept_sha256.

    A word goes if it lies in a run of ``length`` words that starts in another place too, in the same document or
    another one. Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.

    Seeds: of each ``length - seed + 1`` consecutive runs of ``seed`` words the one with the least hash is an
    anchor, so every repeat of ``length`` words shares one with its other place. Documents meet on anchors that repeat.
    Extension: each anchor grows left and right over all windows that chose it; places with the same
    full reach are maximal there and done. What differs somewhere in its reach is opened: each of its windows, left
    and right of the anchor as far as it goes, is compared with those of one place per reach. Repeats that touch or overlap
    join to maximal ones. Places are compared by keys of 128 bits (the anchor's and the window's, from different
    polynomials), in aggregates with map-side sums, so an anchor that stands in any number of documents costs a row per place
    and never pairs.

    Null and empty texts have no words and an empty ``kept_words``; documents of fewer than ``length`` words keep
    all. Rows that repeat a text repeat as a whole, whatever their doc_id. Empty tables give no rows; other columns of any
    name are ignored.
    """
    texts, spans = repeated_spans(docs, length, seed)
    copied = texts.filter((F.col("copies") > 1) & (F.col("n_words") >= length)).select(
        "k1", "k2", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("n_words").alias("b"))).alias("spans")
    )
    single = spans.join(copied.select("k1", "k2"), ["k1", "k2"], "left_anti")
    decided = materialise(single.unionByName(copied), "spans")
    named = decided.select(F.concat_ws(":", "k1", "k2").alias("_name"))
    n_blocks = block_count(named.count())
    keyed = docs.select("doc_id", *text_key(F.col("text")), "text").withColumn("_name", F.concat_ws(":", "k1", "k2"))
    probed = maybe_listed(keyed, "_name", bloom_blocks(named, "_name", n_blocks), n_blocks).drop("_name")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    clear = probed.filter("NOT maybe").select("doc_id", "text", none.alias("spans"))
    touched = probed.filter("maybe").join(decided, ["k1", "k2"], "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))

    def factory():
        def step(batch):
            out = {"doc_id": batch["doc_id"], **{c: [] for c in ("n_words", "n_removed", "kept_words", "kept_sha256")}}
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                words = space_words(text)
                n = len(words)
                if spans:
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, np.array([s["a"] for s in spans]), 1)
                    np.add.at(edges, np.array([s["b"] for s in spans]), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges)[:n] == 0).tolist()]
                kept = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_words"].append(kept.decode("utf-8", "surrogatepass"))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            return out

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind},n_words bigint,n_removed bigint,kept_words string,kept_sha256 string"
    return map_rows(clear.unionByName(touched), factory, schema, ["doc_id", "text", "spans"])
