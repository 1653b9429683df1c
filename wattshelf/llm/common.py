"""Helpers the training-data operators share: tables, words, hashes, Arrow mapping."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A-Z to a-z; every other ASCII character that is no letter or digit to a space; bytes from 0x80 stay.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters untouched."""
    return F.translate(text, UPPER, LOWER)


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift rounds)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows_hash(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` consecutive ids (empty if there are fewer)."""
    n = len(ids) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += ids[i : i + n]
    return mix64(out)


def map_rows(
    df: DataFrame, factory: Callable[[], Callable[[dict[str, pa.Array]], dict[str, object]]], schema: str, columns: list[str]
) -> DataFrame:
    """``factory()`` is called once per task; what it returns maps each Arrow batch to output columns.

    A batch comes as name -> Arrow array; the output may have any number of rows.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = factory()
        for batch in batches:
            if batch.num_rows:
                out = step({name: batch.column(i) for i, name in enumerate(batch.schema.names)})
                arrays = [
                    v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type)
                    for f, v in ((f, out[f.name]) for f in target)
                ]
                yield pa.RecordBatch.from_arrays(
                    [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=target
                )

    return df.select(*columns).mapInArrow(run, schema)


def to_arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string of flat columns and arrays."""
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(","))])


def fresh(columns: list[str], *names: str) -> list[str]:
    """Helper names that none of the columns has in any case: each name with as many underscores before it as it takes."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, decisions: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose keys are (or, with ``left_anti``, are not) in ``decisions``; nulls match nulls."""
    named = decisions.select(*[F.col(k).alias(f"_keep_{i}") for i, k in enumerate(keys)]).dropDuplicates()
    condition = None
    for i, k in enumerate(keys):
        part = docs[k].eqNullSafe(named[f"_keep_{i}"])
        condition = part if condition is None else condition & part
    return docs.join(named, condition, how)


def parts_for(units: int, per_part: int) -> int:
    """How many parts hold ``units`` at ``per_part`` each; follows the input, without an upper cap."""
    return max(1, math.ceil(units / per_part))


def tokenizer_file() -> str:
    """Where the public tokenizer lies; ``WATTSHELF_TOKENIZER`` names another file."""
    named = os.environ.get("WATTSHELF_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
