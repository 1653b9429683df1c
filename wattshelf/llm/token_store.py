"""Token-id output: raw id shards in key order, each with a minimal perfect hash from document key to offset."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattshelf.llm.common import mix64, parts_for
from wattshelf.operators.joins import interval_join
from wattshelf.session import materialise

END_ID = 1
SHARD_TEXT_BYTES = 24 << 20
MAGIC = b"WSIDS001"
CACHE_WORDS = 700_000
KEYS_PER_SEED = 4
KEYS_PER_CALL = 1_000_000
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Characters that are one of ``LETTERS`` in lower case: a full stop or comma after them is a piece of its own.
BEFORE_STOP = frozenset(c for c in map(chr, range(0x250)) if LETTERS.fullmatch(c.lower()))
#: Byte-level vocabularies write a byte as its Latin-1 character where that is visible, others as 256, 257, ... in order.
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(HIDDEN)}
SLOT = np.dtype([("print", "<u4"), ("record", "<u4"), ("records", "<u4")])


class WordCache:
    """Token ids of white-space separated pieces, so that a piece is encoded once per task.

    The tokenizer cuts at white space and drops it, so a text's ids are its pieces' ids in order. Texts
    in Latin-1 are lower-cased first (no character there composes with a neighbour, so this commutes
    with the tokenizer's own normalisation); a final full stop or comma is a piece of its own after a letter that is one of
    ``LETTERS`` in lower case (others, like a capital I with a dot, may end in a mark that joins the punctuation).
    Texts with special-token marks are encoded whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.held: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        sample = ["a", "the", "zwölf", "électricité", "ßmüñqx", "internationalisation"]
        coded = self.tokenizer.encode_batch_fast(sample, add_special_tokens=False)
        # the model alone is several times faster; it may be used where it agrees with the whole tokenizer
        self.direct = all(self.by_model(w) == list(c.ids) for w, c in zip(sample, coded))

    def by_model(self, letters: str) -> list[int]:
        """Ids of a run of lower-case Latin-1 letters from the BPE model, which takes bytes as printable characters."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return [t.id for t in self.model.tokenize(letters)]

    def pack(self, ids: list[int]) -> bytes:
        packed = array("I" if self.wide else "H", ids)
        if sys.byteorder != "little":
            packed.byteswap()
        return packed.tobytes()

    def learn(self, pieces: set[str]) -> None:
        stems = {p: p[:-1] for p in pieces if len(p) > 1 and p[-1] in ".," and p[-2] in BEFORE_STOP}
        wanted = sorted(p for p in {*pieces, *stems.values(), ".", ","} if p not in stems and p not in self.held)
        if self.direct:
            for piece in wanted:
                if LETTERS.fullmatch(lower := piece.lower()):
                    self.held[piece] = self.pack(self.by_model(lower))
            wanted = [p for p in wanted if p not in self.held]
        for piece, coded in zip(wanted, self.tokenizer.encode_batch_fast(wanted, add_special_tokens=False)):
            self.held[piece] = self.pack(coded.ids)
        for piece, stem in stems.items():
            self.held[piece] = self.held[stem] + self.held[piece[-1]]

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        if "<|" in text:
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        held = self.held
        try:
            return b"".join([held[p] for p in pieces if p])
        except KeyError:
            wanted = {p for p in pieces if p}
            if len(held) + len(wanted) > CACHE_WORDS:
                held.clear()
            self.learn({p for p in wanted if p not in held})
            return b"".join([held[p] for p in pieces if p])


def _slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix64(keys ^ mix64(seeds.astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash of distinct 64-bit keys: hash, displace, and try the next seed.

    Keys are dealt into groups of about four; larger groups choose first, and each takes the smallest seed that
    sends its keys to free slots.
    """
    n = len(keys)
    n_groups = max(1, -(-n // KEYS_PER_SEED))
    group = (mix64(keys) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(n_groups + 1))
    seeds = np.zeros(n_groups, np.uint32)
    used = np.zeros(max(n, 1), bool)
    batch = 64
    for g in np.argsort(-(bounds[1:] - bounds[:-1]), kind="stable"):
        own = keys[order[bounds[g] : bounds[g + 1]]]
        if not len(own):
            break
        seed = 0
        while True:
            tried = np.arange(seed, seed + batch, dtype=np.uint64)
            slots = _slots(np.broadcast_to(own, (batch, len(own))), tried[:, None], n)
            free = ~used[slots].any(1)
            if len(own) > 1:
                placed = np.sort(slots, 1)
                free &= (placed[:, 1:] != placed[:, :-1]).all(1)
            hit = np.flatnonzero(free)
            if len(hit):
                seeds[g] = seed + hit[0]
                used[slots[hit[0]]] = True
                break
            seed += batch
    return seeds


def hash_lookup(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key, in constant time per key; for foreign keys any slot."""
    group = (mix64(keys) % np.uint64(len(seeds))).astype(np.int64)
    return _slots(keys, seeds[group], n)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: list[int | None], payloads: list[bytes], kind: np.dtype, order: tuple[int, int] = (0, 0)) -> bytes:
    """A shard: ids, record table, seeds, slot table, head (JSON), head length, magic.

    The record table holds key, offset and number of ids of each record, in order. A slot holds the key's
    fingerprint, its first record and how many records have the key (they stand together). Records with
    a null key come first; they are counted in the head and not indexed.
    """
    counts = np.array([len(p) // kind.itemsize for p in payloads], np.int64)
    offsets = np.cumsum(counts) - counts
    nulls = sum(k is None for k in keys)
    table = np.stack([np.array([k or 0 for k in keys], np.int64), offsets, counts], 1).astype("<i8")
    distinct, first, copies = np.unique(table[nulls:, 0], return_index=True, return_counts=True)
    unsigned = distinct.astype(np.int64).view(np.uint64)
    seeds = perfect_hash(unsigned)
    slots = np.zeros(len(distinct), SLOT)
    if len(distinct):
        at = hash_lookup(unsigned, seeds, len(distinct))
        slots["print"][at], slots["record"][at], slots["records"][at] = fingerprint(unsigned), first + nulls, copies
    parts = [b"".join(payloads), table.tobytes(), seeds.astype("<u4").tobytes(), slots.tobytes()]
    head = {
        "width": kind.itemsize, "bytes": [len(p) for p in parts], "nulls": nulls, "order": list(order),
        "first": int(distinct[0]) if len(distinct) else None, "last": int(distinct[-1]) if len(distinct) else None,
    }
    text = json.dumps(head).encode()
    return b"".join([*parts, text, len(text).to_bytes(4, "little"), MAGIC])


class Shard:
    """A shard opened from its bytes; ``get`` is keyed access through the index."""

    def __init__(self, data: bytes):
        end = len(data) - len(MAGIC)
        if data[end:] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(data[end - 4 : end], "little")
        self.head = json.loads(data[end - 4 - size : end - 4])
        bounds = np.concatenate([[0], np.cumsum(self.head["bytes"])]).tolist()
        cut = [memoryview(data)[a:b] for a, b in zip(bounds, bounds[1:])]
        self.ids = np.frombuffer(cut[0], np.dtype(f"<u{self.head['width']}"))
        self.table = np.frombuffer(cut[1], "<i8").reshape(-1, 3)
        self.seeds = np.frombuffer(cut[2], "<u4")
        self.slots = np.frombuffer(cut[3], SLOT)

    def records_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first record, number of records) of each key; 0 records where fingerprint or stored key differ."""
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        unsigned = keys.astype(np.int64).view(np.uint64)
        slot = self.slots[hash_lookup(unsigned, self.seeds, len(self.slots))]
        first = slot["record"].astype(np.int64)
        hit = (slot["print"] == fingerprint(unsigned)) & (self.table[first, 0] == keys)
        return first, np.where(hit, slot["records"], 0).astype(np.int64)

    def record(self, i: int) -> np.ndarray:
        _, start, n = self.table[i].tolist()
        return self.ids[start : start + n]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every record with the key."""
        first, n = self.records_of(np.array([key], np.int64))
        return [self.record(i) for i in range(int(first[0]), int(first[0] + n[0]))]


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, shard_text_bytes: int = SHARD_TEXT_BYTES
) -> None:
    """Encode every whole text and write shards below ``path``, in ascending doc_id order.

    Texts are range-partitioned by doc_id (and a hash of the text, so that a doc_id of very many rows
    is split), sorted, and encoded in that order; ids are shuffled nowhere. The tokenizer file must exist
    where tasks run; its path is a parameter.

    Rows with a null doc_id come first and are not indexed; equal doc_ids follow each other; null texts
    are empty and give the end id alone; no rows give no shards; other columns are ignored.
    """
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(parts_for(size, shard_text_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    text = F.coalesce("text", F.lit(""))
    order = [F.col("key").asc_nulls_first(), F.col("mark")]
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))
        .repartitionByRange(n_parts, *order)
        .sortWithinPartitions(*order)
        .select("key", "text")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache = WordCache(tokenizer_file)
        end = cache.pack([end_id])
        keys, payloads, size, number, part = [], [], 0, 0, TaskContext.get().partitionId()

        def shard():
            data = pack_shard(keys, payloads, cache.kind, (part, number))
            return pa.RecordBatch.from_pydict({"shard": pa.array([data], pa.binary())})

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                keys.append(key)
                payloads.append(cache.encode(text) + end)
                size += len(text)
                if size >= shard_text_bytes:
                    yield shard()
                    keys, payloads, size, number = [], [], 0, number + 1
        if keys:
            yield shard()

    # Spark's text writer puts the bytes out as they are and ends the file with one line feed.
    ordered.mapInArrow(pack, "shard binary").select(F.col("shard").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every record: doc_id, start (ids before it in all shards), n_tokens, ids_crc32.

    The keys of a shard are looked up through its index and their records read from the raw ids. Starts come
    from one row per shard, summed within and then over range partitions.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py()[:-1])
                nulls = shard.head["nulls"]
                keys = np.unique(shard.table[nulls:, 0])
                first, n = shard.records_of(keys)
                if int(n.sum()) + nulls != len(shard.table):
                    raise ValueError("index does not reach every record")
                at = [*range(nulls), *(i for a, b in zip(first.tolist(), n.tolist()) for i in range(a, a + b))]
                crc = [zlib.crc32(shard.record(i).astype("<u4").tobytes()) for i in at]
                table = shard.table[at]
                part, number = shard.head["order"]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(at), pa.int64()), "number": pa.array([number] * len(at), pa.int64()),
                    "shard_ids": pa.array([len(shard.ids)] * len(at), pa.int64()),
                    "doc_id": pa.array([None if i < nulls else k for i, k in zip(at, table[:, 0].tolist())], pa.int64()),
                    "offset": pa.array(table[:, 1], pa.int64()), "n_tokens": pa.array(table[:, 2], pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    schema = "part bigint, number bigint, shard_ids bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    records = materialise(
        spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema), "token-records"
    )
    shards = records.groupBy("part", "number").agg(F.first("shard_ids").alias("_ids"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        shards.groupBy(F.col("part").alias("_part")).agg(F.sum("_ids").alias("_all"))
        .select("_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        shards.withColumn("_own", F.coalesce(F.sum("_ids").over(inside), F.lit(0)))
        .join(parts, F.col("part") == F.col("_part"))
        .select(F.col("part").alias("_p"), F.col("number").alias("_n"), (F.col("_base") + F.col("_own")).alias("_start"))
    )
    return records.join(bases, (F.col("part") == F.col("_p")) & (F.col("number") == F.col("_n"))).select(
        "doc_id", (F.col("_start") + F.col("offset")).cast("bigint").alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: (doc_id, ids) for every record whose key is in ``keys``; absent keys give no row.

    The directory has one row per shard (its key range). Keys go to the shards whose range holds them by an interval
    join on bins, and each shard answers through its index, for at most about ``KEYS_PER_CALL`` keys at a time.
    """

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [Shard(c.as_py()[:-1]).head for c in batch.column(1)]
            yield pa.RecordBatch.from_pydict({
                "path": batch.column(0), "first": pa.array([h["first"] for h in heads], pa.int64()),
                "last": pa.array([h["last"] for h in heads], pa.int64()),
            })

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1)):
                shard = Shard(content.as_py()[:-1])
                found = [(k, ids) for k in wanted.as_py() for ids in shard.get(k)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([k for k, _ in found], pa.int64()),
                    "ids": pa.array([ids.tolist() for _, ids in found], pa.list_(pa.int64())),
                })

    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    directory = files.mapInArrow(head, "path string, first bigint, last bigint")
    distinct = materialise(keys.select(F.col(key).cast("bigint").alias("_key")).filter("_key IS NOT NULL").distinct(), "lookup-keys")
    parts = parts_for(distinct.count(), KEYS_PER_CALL)
    wanted = (
        interval_join(distinct, directory, "_key", "first", "last")
        .groupBy(F.col("path").alias("_path"), F.pmod(F.xxhash64("_key"), F.lit(parts)).alias("_part"))
        .agg(F.collect_list("_key").alias("_keys"))
    )
    return files.join(wanted, F.col("path") == F.col("_path")).select("content", "_keys").mapInArrow(
        answer, "doc_id bigint, ids array<bigint>"
    )
