"""Text cleaning and tokens as column expressions; only entity decoding leaves the JVM."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import NOT_SPACE, SPACE
from wattshelf.functions.fixed_values import (
    ASCII_PUNCTUATION,
    LABEL_SEPARATOR,
    NGRAM_RANGE,
    STOP_WORDS,
)
from wattshelf.functions.columns import strip

WORD = r"[\p{L}\p{N}_]{2,}"


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(text: Column) -> Column:
    """HTML entities to characters. Texts without ``&`` are not sent to Python."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def strip_html(text: Column) -> Column:
    return strip_tags(decode_entities(text))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)https?://{NOT_SPACE}+|www\\.{NOT_SPACE}+", " ")


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, ASCII_PUNCTUATION, " " * len(ASCII_PUNCTUATION))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def clean_words(text: Column, *, decode: bool = True) -> Column:
    """The cleaned text before stop-word removal, words separated by one space."""
    present = F.coalesce(text, F.lit(""))
    untagged = strip_tags(decode_entities(present) if decode else present)
    return squeeze(strip_punctuation(F.lower(strip_urls(untagged))))


def split_words(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda word: word != "")


def drop_stop_words(words: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return F.filter(words, lambda word: ~word.isin(*stop_words))


def clean_text(
    text: Column,
    *,
    remove_stop_words: bool = True,
    stop_words: Sequence[str] = STOP_WORDS,
    decode: bool = True,
) -> Column:
    """Entities, tags, URLs, case, punctuation, white space, then stop words - in that order."""
    cleaned = clean_words(text, decode=decode)
    if not remove_stop_words:
        return cleaned
    return F.array_join(drop_stop_words(F.split(cleaned, " "), stop_words), " ")


def tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def ngrams(words: Column, ngram_range: tuple[int, int] = NGRAM_RANGE) -> Column:
    """Word n-grams joined by a space, over the token list as given.

    The list is bound once as a lambda variable: referring to it by expression inside the
    inner lambdas would tokenise the text again for every element.
    """
    low, high = ngram_range

    def grams(bound: Column) -> Column:
        sizes = []
        for size in range(low, high + 1):
            joined = bound
            for shift in range(1, size):
                later = F.slice(bound, shift + 1, F.size(bound))
                joined = F.zip_with(joined, later, lambda left, right: F.concat(left, F.lit(" "), right))
            sizes.append(F.filter(joined, lambda gram: gram.isNotNull()) if size > 1 else joined)
        return sizes[0] if len(sizes) == 1 else F.concat(*sizes)

    return F.element_at(F.transform(F.array(words), grams), 1)


def composite_label(category: Column, sub_category: Column | None = None) -> Column:
    main = strip(category.cast("string"))
    if sub_category is None:
        return main
    return F.concat(main, F.lit(LABEL_SEPARATOR), strip(sub_category.cast("string")))


def split_label(label: Column) -> Column:
    """Struct (category, sub_category), cut at the first separator; a blank rest is null."""
    at = F.instr(label, LABEL_SEPARATOR)
    rest = strip(F.substring(label, at + F.lit(len(LABEL_SEPARATOR)), F.length(label)))
    return F.struct(
        F.when(at == 0, label).otherwise(strip(F.substring(label, F.lit(1), at - 1))).alias("category"),
        F.when((at > 0) & (rest != ""), rest).alias("sub_category"),
    )
