"""Optional lemmatisation through a caller-supplied (token, lemma) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted
from wattshelf.operators.ranks import broadcast_if_small
from wattshelf.session import materialise


def lemmatise(df: DataFrame, key: str, text: str, lemmas: DataFrame, output: str = "lemmatised") -> DataFrame:
    """Replace each word that has a lemma; words keep their order, texts without words stay.

    ``key`` identifies a text, so a group holds one text's words. The lemma table is written with one row per token and
    counted: a small one is broadcast, so words need no shuffle; with a large one both sides of the join are plain
    shuffles, in which Spark splits frequent words.
    """
    words = df.select(quoted(key), F.posexplode_outer(F.filter(F.split(text, " "), lambda w: w != "")).alias("pos", "token"))
    table = materialise(lemmas.groupBy("token").agg(F.min("lemma").alias("lemma")), "lemmas")
    replaced = words.join(broadcast_if_small(table, table.count()), "token", "left").withColumn("word", F.coalesce("lemma", "token"))
    in_order = F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word"))))
    rebuilt = replaced.groupBy(key).agg(F.array_join(F.transform(in_order, lambda x: x["word"]), " ").alias(output))
    return df.join(rebuilt, key)
