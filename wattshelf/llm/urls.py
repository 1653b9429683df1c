"""URL filter: longest matching rule, else a blocked Bloom filter of listed URLs and an exact join."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshelf.llm.common import lower_ascii

WORDS_PER_BLOCK = 8
BITS_PER_KEY = 12
#: The filter is the only thing that is broadcast: at most so many blocks of 8 x 32 bits (64 MB of rows).
MAX_BLOCKS = 1 << 19


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for a null or a URL without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, ``m.`` or port, path without ``.html`` or a final slash; no scheme, query, fragment.

    Null where there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":[0-9]*$", ""), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:\.html?|/+)$", "")
    return F.when(host != "", F.concat(host, path))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Rules are hand-written configuration."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def _hash(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("bits"))


def _bit(bits: Column, word: int) -> Column:
    """Word ``word`` of a key's mask: one of 32 bits, chosen by five bits of the second hash."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(bits, 5 * word).bitwiseAND(F.lit(31)).cast("int"))


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """A blocked Bloom filter as rows (block, w0..w7): a key sets one bit in each word of one block."""
    place, bits = _hash(F.col(key))
    masks = [F.bit_or(_bit(F.col("_bits"), i)).alias(f"w{i}") for i in range(WORDS_PER_BLOCK)]
    return (
        keys.filter(F.col(key).isNotNull())
        .select(F.pmod(place, F.lit(n_blocks)).alias("block"), bits.alias("_bits"))
        .groupBy("block")
        .agg(*masks)
    )


def maybe_listed(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """``df`` with ``maybe``: false only if the key is certainly not in the filter."""
    place, bits = _hash(F.col(key))
    probe = df.withColumn("_block", F.pmod(place, F.lit(n_blocks))).withColumn("_bits", bits)
    hit = F.lit(True)
    for i in range(WORDS_PER_BLOCK):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(F.col("_bits"), i)) != 0)
    joined = probe.join(F.broadcast(blocks), F.col("_block") == F.col("block"), "left")
    return joined.select(*df.columns, (F.col(key).isNotNull() & F.coalesce(hit, F.lit(False))).alias("maybe"))


def block_count(n_keys: int) -> int:
    """Blocks for so many keys, up to the limit of what is broadcast."""
    return min(MAX_BLOCKS, max(1, -(-n_keys * BITS_PER_KEY // (32 * WORDS_PER_BLOCK))))


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per page: host, path, rule (null if none), verdict, listed.

    ``listed`` holds URLs to block in column ``url``. A rule decides first (longest text wins, equal
    lengths by text); without one, a page is blocked if its canonical URL is the canonical form of a
    listed URL. The Bloom filter passes possible hits to an exact join, so a false positive cannot block.
    A filter that reaches its size limit only passes more rows to the join.

    Null URLs and URLs without ``://`` have empty host and path, match no rule and no listed URL, and are
    allowed. Repeated pages give repeated rows; an empty list or table gives no blocks; other columns are
    ignored.
    """
    keys = listed.select(canonical(F.col("url")).alias("_listed_key")).filter("_listed_key IS NOT NULL").distinct()
    n_blocks = block_count(keys.count())
    blocks = bloom_blocks(keys, "_listed_key", n_blocks)
    parsed = pages.select(
        F.col(id_column).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        canonical(F.col(url)).alias("_key"),
    ).withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    probed = maybe_listed(parsed, "_key", blocks, n_blocks)
    exact = probed.filter("maybe").join(keys, F.col("_key") == F.col("_listed_key"), "left")
    clear = probed.filter("NOT maybe").withColumn("_listed_key", F.lit(None).cast("string"))
    both = exact.unionByName(clear)
    is_listed = F.col("_listed_key").isNotNull()
    return both.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        is_listed.alias("listed"),
    )
