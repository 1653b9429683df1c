"""Merkle manifest of a table: levels of a block as hex strings, parents and proofs by fixed-width substrings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted
from wattshelf.operators.ranks import broadcast_if_small, dense_index
from wattshelf.session import materialise

ARITY = 3
#: Levels of one block: it holds ARITY ** BLOCK_LEVELS nodes of its lowest level at most.
BLOCK_LEVELS = 6
DIGEST = 64
PAYLOAD = "struct<key:string,carried:array<string>>"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value (numbers as decimals)."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The lowercase hex sha256 of a row's framed fields, one after the other."""
    return F.sha2(F.concat(*[framed(field) for field in fields]), 256)


def parents(level: Column, arity: int = ARITY) -> Column:
    """The next level of a block: each run of ``arity`` digests becomes the digest of their hex text."""
    width = arity * DIGEST
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "")


def siblings(levels: Column, depth: Column, at: Column, arity: int, block_levels: int) -> Column:
    """Per level of a block (left, right): what flanks the ancestor of node ``at`` inside its run."""
    width = arity * DIGEST

    def flanks(j: int) -> Column:
        own = F.floor(at / F.lit(arity**j)).cast("int")
        run = F.substring(levels[j], F.floor(own / F.lit(arity)).cast("int") * width + 1, F.lit(width))
        before = (own % arity) * DIGEST
        return F.struct(
            F.substring(run, F.lit(1), before).alias("left"), F.substring(run, before + DIGEST + 1, F.lit(width)).alias("right")
        )

    return F.array_compact(F.array(*[F.when(depth > j, flanks(j)) for j in range(block_levels)]))


def layer(nodes: DataFrame, arity: int, block_levels: int) -> DataFrame:
    """Blocks of aligned nodes: group, block, n, depth, members (at, digest, payload) and levels.

    ``nodes`` is (group, at, n, digest, payload): the at-th of the n nodes of a group. The only block of a group goes
    up to one digest; blocks of larger groups go up ``block_levels`` levels, to one digest each.
    """
    span = arity**block_levels
    depth = reduce(lambda total, j: total + (F.col("n") > arity**j).cast("int"), range(block_levels), F.lit(0))
    blocks = (
        nodes.withColumn("block", F.floor(F.col("at") / F.lit(span)))
        .withColumn("at", (F.col("at") % span).cast("int"))
        .groupBy("group", "block")
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", "payload"))).alias("members"))
        .withColumn("depth", depth)
        .withColumn("_level0", F.array_join(F.col("members.digest"), ""))
    )
    for j in range(block_levels):
        blocks = blocks.withColumn(f"_level{j + 1}", F.when(F.col("depth") > j, parents(F.col(f"_level{j}"), arity)))
    held = F.array_compact(F.array(*[F.col(f"_level{j}") for j in range(block_levels + 1)]))
    return materialise(blocks.select("group", "block", "n", "depth", "members", held.alias("levels")), "manifest-layer")


def build(nodes: DataFrame, largest: int, arity: int, block_levels: int) -> list[DataFrame]:
    """Layers of blocks, each over the top digests of the one below, until a group is one block."""
    span = arity**block_levels
    layers = [layer(nodes, arity, block_levels)]
    while largest > span:
        largest = -(-largest // span)
        tops = layers[-1].filter(F.col("n") > span).select(
            "group", F.col("block").alias("at"), F.ceil(F.col("n") / F.lit(span)).alias("n"),
            F.element_at("levels", -1).alias("digest"), F.lit(None).cast(PAYLOAD).alias("payload"),
        )
        layers.append(layer(tops, arity, block_levels))
    return layers


def finished(layers: Sequence[DataFrame], span: int) -> DataFrame:
    """(group, digest): the one digest that remains of each group."""
    ends = [one.filter(F.col("n") <= span).select("group", F.element_at("levels", -1).alias("digest")) for one in layers]
    return reduce(DataFrame.unionByName, ends)


def opened(layers: Sequence[DataFrame], ends: DataFrame, arity: int, block_levels: int) -> DataFrame:
    """Every node of the lowest layer with its siblings: group, digest, payload, proof, and columns of ``ends``.

    ``ends`` is (group, proof, ...): the siblings above a group's last digest. From the top layer down, a block takes
    the proof of its top digest from the layer above and hands every member its own flanks before it.
    """
    span = arity**block_levels
    carried = [name for name in ends.columns if name not in ("group", "proof")]
    above: DataFrame | None = None
    for blocks in reversed(layers):
        tops = ends.select(F.col("group").alias("_g"), F.lit(0).cast("bigint").alias("_b"), F.lit(True).alias("_last"), "proof", *carried)
        if above is not None:
            inner = above.select(F.col("group").alias("_g"), F.col("at").alias("_b"), F.lit(False).alias("_last"), "proof", *carried)
            tops = tops.unionByName(inner)
        same = F.col("group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")) & ((F.col("n") <= span) == F.col("_last"))
        joined = blocks.join(tops, same)
        member = F.explode(
            F.transform(
                "members",
                lambda m: F.struct(
                    (F.col("block") * span + m["at"]).alias("at"), m["digest"].alias("digest"), m["payload"].alias("payload"),
                    siblings(F.col("levels"), F.col("depth"), m["at"], arity, block_levels).alias("own"),
                ),
            )
        ).alias("m")
        above = joined.select("group", "proof", *carried, member).select(
            "group", "m.at", "m.digest", "m.payload", F.concat("m.own", "proof").alias("proof"), *carried
        )
    return above


def fold(digest: Column, proof: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    return F.aggregate(proof, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(
    rows: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", carry: Sequence[Column] = (),
    arity: int = ARITY, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """A Merkle tree per group and one over the groups; a row per input row:
    ``order``, carry (strings), leaf, subroot, root, proof (array of left, right).

    Leaves of a group stand in ascending ``order``; while several nodes remain, each run of ``arity`` becomes its
    digest (a last run may be shorter, even one node). What remains is the group's subroot; subroots in order of
    their group give the root the same way. ``carry`` columns travel with their row.

    Positions come from one range-partitioned sort, so a group with most of the rows is spread like any other. A task
    then handles blocks of arity ** block_levels leaves at most; the top digests of blocks are the leaves
    of the next layer. Proofs go down the layers the same way, one join per layer at block level.

    Groups are ordered as strings. Null groups form one group, first in order; null keys come first in their group; of equal keys, the smaller leaf
    digest is first; repeated rows are leaves of their own. Null fields are framed as ``-``. Empty tables give no
    rows; other columns of any name are ignored.
    """
    span = arity**block_levels
    kind = rows.schema[order].dataType.simpleString()
    leaves = rows.select(
        quoted(group).cast("string").alias("group"), quoted(order).alias("key"), leaf_digest([quoted(name) for name in fields]).alias("digest"),
        F.array(*[c.cast("string") for c in carry]).cast("array<string>").alias("carried"),
    )
    # rows that repeat each other are interchangeable; their place in the input keeps them in several tasks
    placed = dense_index(
        leaves.withColumn("_place_in", F.monotonically_increasing_id()),
        [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("_place_in")], "position",
    )
    groups = materialise(placed.groupBy("group").agg(F.min("position").alias("_start"), F.count(F.lit(1)).alias("n")), "manifest-groups")
    totals = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    starts = broadcast_if_small(groups.withColumnRenamed("group", "_g"), totals[0])
    payload = F.struct(F.col("key").cast("string").alias("key"), "carried")
    nodes = placed.join(starts, F.col("group").eqNullSafe(F.col("_g"))).select(
        "group", (F.col("position") - F.col("_start")).alias("at"), "n", "digest", payload.alias("payload")
    )
    layers = build(nodes, totals[1] or 0, arity, block_levels)
    subroots = materialise(
        dense_index(finished(layers, span), [F.col("group").asc_nulls_first()], "at").select(
            F.lit(0).alias("group"), "at", F.lit(totals[0]).cast("bigint").alias("n"), "digest",
            F.struct(F.col("group").alias("key"), F.lit(None).cast("array<string>").alias("carried")).alias("payload"),
        ),
        "manifest-subroots",
    )
    upper = build(subroots, totals[0], arity, block_levels)
    segments = "array<struct<left:string,right:string>>"
    root = finished(upper, span).select("group", F.array().cast(segments).alias("proof"), F.col("digest").alias("root"))
    ends = opened(upper, root, arity, block_levels).select(
        F.col("payload.key").alias("group"), "proof", F.col("digest").alias("subroot"), "root"
    )
    opened_rows = opened(layers, materialise(ends, "manifest-ends"), arity, block_levels)
    return opened_rows.select(
        F.col("payload.key").cast(kind).alias(order), F.col("payload.carried").alias("carried"), F.col("digest").alias("leaf"),
        "subroot", "root", "proof",
    )
