import html
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattshelf.functions import columns as c
from wattshelf.functions import text as t
from wattshelf.functions.fixed_values import ASCII_PUNCTUATION, STOP_WORDS
from wattshelf.operators.lemmas import lemmatise
from wattshelf.operators.projection import add_corpus, canonical_projection, clean_columns, resolve_request_text
from wattshelf.functions.money import format_percent, parse_price


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        # The first five pairs are exact expectations of the specification.
        ("<b>The Apple iPhone!</b> Visit https://example.com with A18 chip.", "apple iphone visit a18 chip"),
        ("THE Phone!!!", "phone"),
        ("<p>Latest phone with charger.</p>", "latest phone charger"),
        ("Running Shoes, for Men", "running shoes men"),
        ("New phone with charger", "new phone charger"),
        (None, ""),
        ("", ""),
        ("&lt;b&gt;Bold&lt;/b&gt; tea &amp; cake", "bold tea cake"),
        ("HTTP://shop.test x", "http shop test x"),
        ("www.shop.test now \x1fthen", "now then"),
        ("the and of", ""),
        ("line<\nbr>break", "line break"),
    ],
)
def test_cleaning(spark, raw, cleaned):
    assert one(spark, raw, t.clean_text) == cleaned


def expected_cleaning(raw):
    untagged = re.sub(r"<[^>]+>", " ", html.unescape(raw))
    plain = re.sub(r"https?://\S+|www\.\S+", " ", untagged).lower()
    words = "".join(" " if ch in string.punctuation else ch for ch in plain).split()
    return " ".join(word for word in words if word not in STOP_WORDS)


def test_cleaning_agrees_with_python_on_random_texts(spark):
    pieces = st.sampled_from(
        ["The", "a", "café", "<i>", "</i>", "&amp;", "&lt;", "&#39;", "http://x.y/z", "www.q", " ", "\x1d", "\n", " ", "!", "_", "a_b", "9", "中文", "ı"]
    )
    found = []

    @settings(max_examples=200, deadline=None, derandomize=True)
    @given(st.lists(pieces, max_size=14))
    def collect(parts):
        found.append("".join(parts))

    collect()
    rows = spark.createDataFrame([(raw,) for raw in set(found)], "x string").select("x", t.clean_text(F.col("x")).alias("y"))
    for row in rows.collect():
        assert row["y"] == expected_cleaning(row["x"]), row["x"]


def test_stop_words_can_stay(spark):
    assert one(spark, "The Phone", lambda x: t.clean_text(x, remove_stop_words=False)) == "the phone"
    assert len(STOP_WORDS) == 29 and ASCII_PUNCTUATION == string.punctuation


def test_tokens_and_ngrams(spark):
    assert one(spark, "a bb céé d_d 42 x", t.tokens) == ["bb", "céé", "d_d", "42"]
    assert one(spark, "bb cc dd", lambda x: t.ngrams(t.tokens(x))) == ["bb", "cc", "dd", "bb cc", "cc dd"]
    assert one(spark, "bb", lambda x: t.ngrams(t.tokens(x))) == ["bb"]
    assert one(spark, "", lambda x: t.ngrams(t.tokens(x))) == []
    assert one(spark, "bb cc dd", lambda x: t.ngrams(t.tokens(x), (2, 3))) == ["bb cc", "cc dd", "bb cc dd"]


@pytest.mark.parametrize(
    "label, parts",
    [("a", ("a", None)), ("a|||b", ("a", "b")), (" a ||| b|||c ", ("a", "b|||c")), ("a|||  ", ("a", None))],
)
def test_label_split(spark, label, parts):
    assert tuple(one(spark, label, t.split_label)) == parts


def test_names_and_roles():
    assert c.normalise_name("  Product-Name (v2) ") == "product_name_v2"
    roles = c.resolve_roles(["name", "manufacturer", "discount_price", "main_category"])
    assert roles == {
        "product_name": "name",
        "description": "name",
        "brand": "manufacturer",
        "price": "discount_price",
        "category": "main_category",
    }
    assert c.resolve_roles(["x"])["brand"] is None
    # The later of two columns with the same normalised name is taken.
    assert c.resolve_roles(["Brand", "brand "])["brand"] == "brand "


def test_text_and_label_columns():
    assert c.resolve_text_columns(["Title", "name", "x"]) == ("name", "Title")
    with pytest.raises(ValueError):
        c.resolve_text_columns(["x"])
    with pytest.raises(ValueError):
        c.resolve_text_columns(["x"], ["y"])
    assert c.resolve_label_columns(["Main Category", "subcategory"]) == ("Main Category", "subcategory")
    with pytest.raises(ValueError):
        c.resolve_label_columns(["x"])


def test_canonical_projection_uses_odd_names(spark):
    frame = spark.createDataFrame([(1, "n", "m")], "id long, `Na.me` string, ` Manufacturer ` string")
    row = canonical_projection(frame, keep=["id"]).first()
    assert row["brand"] == "m" and row["product_name"] is None
    frame = spark.createDataFrame([("n",)], "`product.name` string")
    assert canonical_projection(frame).first()["product_name"] == "n"


def test_clean_columns_and_corpus(spark):
    frame = spark.createDataFrame([("THE Phone!", "<p>with charger</p>", "Acme")], "product_name string, description string, brand string")
    row = clean_columns(frame).first()
    assert (row["product_name_cleaned"], row["description_cleaned"], row["brand"]) == ("phone", "charger", "Acme")
    assert add_corpus(frame).first()["corpus"] == "phone charger"
    empty = spark.createDataFrame([(None, None)], "product_name string, description string")
    assert add_corpus(empty).first()["corpus"] == ""


def test_request_text(spark):
    frame = spark.createDataFrame(
        [(" a ", None, "b "), (None, "  ", ""), ("x", "y", "z")], "text string, product_name string, description string"
    )
    assert [r["request_text"] for r in resolve_request_text(frame).collect()] == ["a b", None, "x y z"]


@pytest.mark.parametrize(
    "text, price",
    [("₹1,999", 1999.0), ("not-a-price", None), ("1-2", None), ("", None), ("-", None), ("-.", None), (None, None), ("$ -3.50", -3.5), ("1.2.3", None)],
)
def test_price(spark, text, price):
    assert one(spark, text, parse_price) == price


def test_percent(spark):
    assert one(spark, 0.6171, format_percent, "double") == "61.7%"
    assert one(spark, None, format_percent, "double") == "N/A"


def test_lemmas_keep_order_and_repeats(spark):
    docs = spark.createDataFrame([(1, "cats see cats run"), (2, "")], "id long, text string")
    table = spark.createDataFrame([("cats", "cat"), ("run", "go")], "token string, lemma string")
    rows = {r["id"]: r["lemmatised"] for r in lemmatise(docs, "id", "text", table).collect()}
    assert rows == {1: "cat see cat go", 2: ""}


def test_row_digest_keeps_values_apart(spark):
    frame = spark.createDataFrame([("a", None), (None, "a"), ("", "a"), ("a|1:b", ""), ("a", "b")], "x string, y string")
    digests = [r[0] for r in frame.select(c.row_digest([F.col("x"), F.col("y")])).collect()]
    assert len(set(digests)) == 5
