"""Similarity join on word shingles: MinHash banding (a trie node per tree and prefix), then exact verification inside candidate classes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshelf.llm.common import fresh, map_rows, mix64, parts_for, plain_words, windows_hash
from wattshelf.llm.components import connected_components
from wattshelf.llm.urls import block_count, bloom_blocks, maybe_listed
from wattshelf.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
TREES = 24
DEPTH = 5
RECALL = 0.9999
#: Pairs whose estimated similarity is below this (over five standard errors under 0.8) are not candidates.
ESTIMATE = 0.6
#: Members of a prefix group that are compared in one task; larger groups are split.
GROUP = 2048
#: Members of a large group that are compared with all of it at first.
HUBS = 128
#: Documents and bytes of text of one block in exact verification.
BLOCK_DOCS = 1024
BLOCK_BYTES = 16 << 20
UNIT_BYTES = 8 << 20
MEMBERS_PER_TASK = 50_000


def prefix_depth(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair of the wanted similarity shares a node with the target recall.

    One length for all trees, from 1 - (1 - s^k)^trees: this is banding, prefixes do not adapt to the data.
    """
    k = depth
    while k > 1 and 1.0 - (1.0 - similarity**k) ** trees < recall:
        k -= 1
    return k


def shingle_hashes(ids: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of a document's word ids; a shorter document is one shingle."""
    return windows_hash(ids, min(width, len(ids))) if len(ids) else np.empty(0, np.uint64)


def sequence_key(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


class Signer:
    """MinHash signatures of word lists, with word hashes kept per task."""

    def __init__(self, trees: int, depth: int, prefix: int, width: int):
        self.trees, self.depth, self.prefix, self.width = trees, depth, prefix, width
        numbers = mix64(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64))
        self.factors, self.offsets = numbers[::2] | np.uint64(1), numbers[1::2]
        self.hashes: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        held = self.hashes
        if len(held) > 1_000_000:
            held.clear()
        try:
            return np.array([held[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in held:
                    held[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([held[w] for w in words], np.uint64)

    def sign(self, words: list[bytes]) -> tuple[list[int], bytes]:
        """(a trie node per tree, the low byte of every minimum)."""
        shingles = shingle_hashes(self.ids(words), self.width)
        lowest = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 512):
            block = shingles[at : at + 512, None] * self.factors
            block += self.offsets
            np.minimum(lowest, block.min(0), out=lowest)
        lowest = mix64(lowest)
        labels = lowest.reshape(self.trees, self.depth)
        node = mix64(np.arange(1, self.trees + 1, dtype=np.uint64))
        for i in range(self.prefix):
            node = mix64(node * np.uint64(0x9E3779B97F4A7C15) + labels[:, i])
        return node.view(np.int64).tolist(), lowest.astype(np.uint8).tobytes()


def signatures(docs: DataFrame, trees: int, depth: int, prefix: int, width: int) -> DataFrame:
    """Per document: doc_id, key (its word sequence; null without words), n_bytes, nodes, sketch."""

    def factory():
        signer = Signer(trees, depth, prefix, width)

        def step(batch):
            out = {"doc_id": batch["doc_id"], "key": [], "n_bytes": [], "nodes": [], "sketch": []}
            for text in batch["text"].to_pylist():
                words = plain_words(text)
                nodes, sketch = signer.sign(words) if words else (None, None)
                out["key"].append(sequence_key(words) if words else None)
                out["n_bytes"].append(len(text) if text else 0)
                out["nodes"].append(nodes)
                out["sketch"].append(sketch)
            return out

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind},key binary,n_bytes bigint,nodes array<bigint>,sketch binary"
    return map_rows(docs, factory, schema, ["doc_id", "text"])


def spanning(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index connected with each index."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            root[i] = i
            frontier = np.array([i])
            while len(frontier):
                reached = np.flatnonzero(linked[frontier].any(0) & (root < 0))
                root[reached] = i
                frontier = reached
    return root


def _agreeing(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which rows of two sketch tables agree in enough bytes (chance agreements of one in 256 taken off)."""
    width = left.shape[1]
    needed = width * (least * 255 / 256 + 1 / 256)
    columns = np.ascontiguousarray(right.T)
    linked = np.empty((len(left), len(right)), bool)
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        agreed = np.zeros((len(rows), len(right)), np.min_scalar_type(width))
        for i in range(width):
            agreed += rows[:, i, None] == columns[i]
        linked[at : at + 64] = agreed >= needed
    return linked


def candidate_edges(reps: DataFrame, group: int, hubs: int, estimate: float) -> DataFrame:
    """Edges (a, b) that connect the members of each trie node whose estimated similarity is enough.

    A node's members are compared inside one task and only a spanning forest of the links leaves it. A node
    with more than ``group`` members is first dealt to several tasks by a hash of tree and member, and
    about ``hubs`` members chosen by hash go to all of them; that connects most of a large class. What
    is not connected yet is then compared with all of its node (``_across_parts``), so every pair of a
    node's members is either compared or connected already.
    """
    rows = reps.select("rep", F.explode("nodes").alias("node"))
    shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumnRenamed("node", "_node")
    parts = F.ceil(F.col("_n") / F.lit(group)).cast("int")
    is_hub = (F.col("_n") > group) & (F.pmod(F.xxhash64("node", "rep", F.lit("hub")), F.col("_n")) < hubs)
    dealt = F.when(is_hub, F.sequence(F.lit(0), parts - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node", "rep"), parts.cast("bigint")).cast("int"))
    )
    members = materialise(
        rows.join(shared, F.col("node") == F.col("_node")).select("rep", "node", F.explode(dealt).alias("part")), "members"
    )
    buckets = parts_for(members.count(), MEMBERS_PER_TASK)
    sketched = members.withColumnRenamed("rep", "_rep").join(reps.select("rep", "sketch"), F.col("_rep") == F.col("rep"))
    bucketed = sketched.select("rep", "node", "part", "sketch", F.pmod(F.xxhash64("node", "part"), F.lit(buckets)).alias("bucket"))

    def link(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        node = table.column("node").to_numpy()
        part = table.column("part").to_numpy().astype(np.int64)
        order = np.lexsort((rep, part, node))
        rep, node, part = rep[order], node[order], part[order]
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)[order]
        starts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (part[1:] != part[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(rep)]]))
        needed = sketches.shape[1] * (estimate * 255 / 256 + 1 / 256)
        pairs = starts[sizes == 2]
        close = pairs[(sketches[pairs] == sketches[pairs + 1]).sum(1) >= needed]
        a, b = [rep[close + 1]], [rep[close]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            root = spanning(_agreeing(sketches[start : start + size], sketches[start : start + size], estimate))
            at = np.flatnonzero(root != np.arange(size))
            a.append(rep[start + at])
            b.append(rep[start + root[at]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    edges = materialise(bucketed.groupBy("bucket").applyInArrow(link, "a bigint, b bigint").distinct(), "near-edges")
    hot = materialise(shared.filter(F.col("_n") > group).select("_node"), "large-nodes")
    if hot.isEmpty():
        return edges
    return edges.unionByName(_across_parts(rows.join(hot, F.col("node") == F.col("_node")).drop("_node"), reps, edges, group, estimate))


def _across_parts(rows: DataFrame, reps: DataFrame, edges: DataFrame, group: int, estimate: float) -> DataFrame:
    """Links between members (rep, node) of large nodes that ``edges`` does not connect.

    A node's members outside its largest component (strays) are dealt to parts, and so are the others;
    each part of strays meets every part of both in a task of its own. Members of one component need no
    comparison: it could only connect what is connected.
    """
    known = connected_components(edges).select(F.col("node").alias("_r"), "component")
    placed = rows.join(known, F.col("rep") == F.col("_r"), "left").select("rep", "node", F.coalesce("component", "rep").alias("component"))
    placed = materialise(placed, "large-node-members")
    sizes = placed.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("node").alias("_n")).agg(
        F.max(F.struct("n", "component")).alias("_largest"), F.sum("n").alias("_all")
    )
    outside = F.col("_all") - F.col("_largest.n")
    sizes = sizes.filter(outside > 0).select(
        "_n", F.col("_largest.component").alias("main"), F.ceil(outside / F.lit(group)).cast("int").alias("strays"),
        F.ceil(F.col("_largest.n") / F.lit(group)).cast("int").alias("mains"),
    )
    stray = F.col("component") != F.col("main")
    own = F.pmod(F.xxhash64("node", "rep", F.lit("across")), F.when(stray, F.col("strays")).otherwise(F.col("mains")).cast("bigint")).cast("int")
    # A block is (part of strays, part of strays) or (part of strays, -1 - part of the others).
    among = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda i: F.struct(F.least("own", i).alias("low"), F.greatest("own", i).alias("high")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(F.col("own").alias("low"), (-1 - i).alias("high")))
    to_strays = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda i: F.struct(i.alias("low"), (-1 - F.col("own")).alias("high")))
    blocks = F.when(stray, F.concat(among, with_main)).otherwise(to_strays)
    dealt = materialise(
        placed.join(sizes, F.col("node") == F.col("_n")).withColumn("own", own)
        .withColumn("side", F.when(stray, F.col("own")).otherwise(-1 - F.col("own")))
        .withColumn("block", F.explode(blocks))
        .select("rep", "node", "component", "side", "block.low", "block.high"),
        "large-node-blocks",
    )
    buckets = parts_for(dealt.count(), 2 * group)
    sketched = dealt.withColumnRenamed("rep", "_rep").join(reps.select("rep", "sketch"), F.col("_rep") == F.col("rep"))
    bucketed = sketched.select(
        "rep", "node", "component", "side", "low", "high", "sketch", F.pmod(F.xxhash64("node", "low", "high"), F.lit(buckets)).alias("bucket")
    )

    def link(table: pa.Table) -> pa.Table:
        rep, node, component, side, low, high = (table.column(c).to_numpy() for c in ("rep", "node", "component", "side", "low", "high"))
        order = np.lexsort((rep, high, low, node))
        rep, node, component, side, low, high = (c[order] for c in (rep, node, component, side, low, high))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)[order]
        new = (node[1:] != node[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.flatnonzero(np.concatenate([[True], new]))
        a, b = [], []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)]):
            left, right = (start + np.flatnonzero(side[start:end] == part[start]) for part in (low, high))
            linked = _agreeing(sketches[left], sketches[right], estimate) & (component[left][:, None] != component[right][None])
            both = np.zeros((end - start, end - start), bool)
            both[np.ix_(left - start, right - start)] = linked
            root = spanning(both | both.T)
            at = np.flatnonzero(root != np.arange(end - start))
            a.append(rep[start + at])
            b.append(rep[start + root[at]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return bucketed.groupBy("bucket").applyInArrow(link, "a bigint, b bigint").distinct()


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of shingle sets have at least the Jaccard similarity (a fraction of small integers)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.full((n, n), float(np.count_nonzero(counts == n)), np.float32)
    chosen = (counts > 1) & (counts < n)
    width = max(256, (1 << 22) // n)
    position = np.cumsum(chosen) - 1
    keep = chosen[column]
    owner, column = owner[keep], position[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(chosen.sum())
    for at in range(0, total, width):
        low, high = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, min(width, total - at)), np.float32)
        block[owner[low:high], column[low:high] - at] = 1
        shared += block @ block.T
    whole = np.rint(shared).astype(np.int64)
    union = sizes[:, None] + sizes[None] - whole
    return 1000 * whole >= round(1000 * similarity) * union


def verified_links(docs: DataFrame, members: DataFrame, similarity: float, width: int) -> DataFrame:
    """(rep, root, links): exact links of each member inside its candidate class, per unit of work.

    A small class is verified in one task, many classes together. A large class is cut into blocks, and
    each pair of blocks is a unit: what leaves it are counts and a spanning forest of the links.
    """
    totals = members.groupBy(F.col("component").alias("_c")).agg(
        F.count(F.lit(1)).alias("_docs"), F.sum("n_bytes").alias("_bytes")
    )
    blocks = F.greatest(F.ceil(F.col("_docs") / BLOCK_DOCS), F.ceil(F.col("_bytes") / BLOCK_BYTES), F.lit(1)).cast("bigint")
    sized = members.join(totals, F.col("component") == F.col("_c")).withColumn("_blocks", blocks)
    volume = sized.agg(F.sum(F.col("n_bytes") * F.col("_blocks"))).first()[0] or 0
    units = parts_for(volume, UNIT_BYTES)
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_other")
    placed = sized.select("rep", "key", "copies", "first_doc", "component", own.alias("block"), "_blocks", other).select(
        "rep", "key", "copies", "first_doc", "component", "block",
        F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
        F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(units)))
        .otherwise(F.xxhash64("component", F.least("block", "_other"), F.greatest("block", "_other"))).alias("unit"),
    )
    # A Bloom filter of the members keeps other texts out of the shuffle; the join is exact.
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    wanted = members.select(name("first_doc").alias("_name")).distinct()
    n_blocks = block_count(wanted.count())
    named = docs.select(F.col("doc_id").alias("_doc"), "text", name("doc_id").alias("_name"))
    texts = maybe_listed(named, "_name", bloom_blocks(wanted, "_name", n_blocks), n_blocks).filter("maybe").select("_doc", "text")
    with_text = placed.join(texts, F.col("first_doc").eqNullSafe(F.col("_doc"))).select(
        "unit", "component", "low", "high", "block", "rep", "key", "copies", "text"
    )

    def verify(table: pa.Table) -> pa.Table:
        groups: dict[tuple, dict[int, tuple]] = {}
        vocabulary: dict[bytes, int] = {}
        columns = [table.column(c).to_pylist() for c in ("component", "low", "high", "block", "rep", "key", "copies", "text")]
        for component, low, high, block, rep, key, copies, text in zip(*columns):
            words = plain_words(text)
            if sequence_key(words) != key:  # another row with the same doc_id
                continue
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.uint64)
            groups.setdefault((component, low, high), {})[rep] = (block, copies, np.unique(shingle_hashes(ids, width)))
        out: tuple[list, list, list] = ([], [], [])
        for (_, low, high), held in groups.items():
            reps = sorted(held)
            linked = similar([held[r][2] for r in reps], similarity)
            np.fill_diagonal(linked, False)
            if low != high:
                side = np.array([held[r][0] for r in reps])
                linked &= side[:, None] != side[None]
            root = spanning(linked)
            out[0].extend(reps)
            out[1].extend(reps[i] for i in root.tolist())
            out[2].extend((linked @ np.array([held[r][1] for r in reps], np.int64)).tolist())
        return pa.table({"rep": out[0], "root": out[1], "links": out[2]}, pa.schema([(c, pa.int64()) for c in ("rep", "root", "links")]))

    return with_text.groupBy("unit").applyInArrow(verify, "rep bigint, root bigint, links bigint")


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    width: int = SHINGLE,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    group: int = GROUP,
    hubs: int = HUBS,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Documents link if the sets of their shingles (``width`` words; words as in decontamination) have at least the
    Jaccard similarity. ``class_id`` is the smallest doc_id of the documents connected by links;
    ``n_links`` counts all other documents that a document links with, copies included.

    Documents with the same words are collapsed first, so copies cost one row each. The forest's trie nodes
    give candidate classes (no link with the target recall per pair is lost), whose members' texts are then
    fetched once and compared exactly; nothing emits the pairs of a class.

    A document without words (null, empty, only punctuation) links with nothing and is a class of its own; one of
    fewer than ``width`` words has one shingle. Repeated rows are copies of each other. A class of null
    doc_ids only has a null class_id. An empty table gives no rows; other columns are ignored.
    """
    prefix = prefix_depth(similarity, trees, depth, recall)
    signed = materialise(signatures(docs, trees, depth, prefix, width), "signatures")
    reps = materialise(
        signed.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"),
            F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"),
        )
        .withColumn("rep", F.monotonically_increasing_id()),
        "reps",
    )
    coarse = connected_components(candidate_edges(reps, group, hubs, ESTIMATE))
    members = materialise(
        reps.select("rep", "key", "first_doc", "copies", "n_bytes").join(
            coarse.select(F.col("node").alias("_node"), "component"), F.col("rep") == F.col("_node")
        ).drop("_node"),
        "class-members",
    )
    links = materialise(verified_links(docs, members, similarity, width), "links")
    final = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("rep").agg(F.sum("links").alias("_links"))
    keyed = members.select("rep", "key", "first_doc", "copies")
    classes = keyed.join(final.select(F.col("node").alias("_node"), "component"), F.col("rep") == F.col("_node"))
    named = classes.groupBy(F.col("component").alias("_c")).agg(F.min("first_doc").alias("_class"))
    linked = classes.join(named, F.col("component") == F.col("_c")).select(F.col("rep").alias("_r"), "_class")
    rows = (
        reps.select("rep", "key", "first_doc", "copies")
        .join(linked, F.col("rep") == F.col("_r"), "left")
        .join(counted.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep"), "left")
        .select(
            F.col("key").alias("_key"),
            F.coalesce("_class", "first_doc").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).cast("bigint").alias("n_links"),
        )
    )
    wordless = signed.filter("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    worded = signed.filter("key IS NOT NULL").select("doc_id", "key")
    return worded.join(rows, F.col("key") == F.col("_key")).select("doc_id", "class_id", "n_links").unionByName(wordless)


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The document with the smallest doc_id of each class; same columns. Of rows that repeat it one stays.

    A class without doc_ids keeps one document for each different text. Documents without words are classes of
    their own and stay; an empty table stays empty; extra columns of any name pass through.
    """
    classes = near_duplicates(docs, **settings)
    (name,) = fresh(docs.columns, "_first")
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first[name])).drop(name)
    named = kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionByName(kept.filter("doc_id IS NULL").dropDuplicates(["text"]))
