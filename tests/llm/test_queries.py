"""The numbered queries over a whole small table: against SQL where there is some, else against brute force."""

import hashlib
import os
import zlib
from decimal import Decimal

import pytest

from tests.llm import brute
from wattshelf.llm.common import tokenizer_file
from wattshelf.llm.queries import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(connection):
    return connection.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, (int, float, Decimal)) else str(value)


def by_id(spark, name):
    return {row["doc_id"]: row for row in QUERIES[name](spark, SF_DIR).collect()}


def test_thirteen_operators_and_the_pipeline():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES and set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, connection, name):
    frame = QUERIES[name](spark, SF_DIR)
    cursor = connection.execute(CHECKS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = [tuple(map(plain, row)) for row in cursor.fetchall()]
    actual = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    assert sorted(actual, key=repr) == sorted(expected, key=repr)


def test_personal_data_base_equals_brute_force(spark, texts):
    rows = by_id(spark, "op1_pii")
    assert len(rows) == len(texts)
    for doc, text in texts:
        spans = brute.base_spans(text)
        row = rows[doc]
        assert [row[f"n_{k}"] for k in brute.BASE_KINDS] == [sum(s[3] == k for s in spans) for k in brute.BASE_KINDS]
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(row["spans"].split(","))


def test_license_base_equals_brute_force(spark, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    rows = by_id(spark, "op8_licenses")
    for doc, text in texts:
        words = brute.plain_words(text)
        places = [
            (i, label)
            for phrase, label in phrases.items()
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        row = rows[doc]
        at = [i for i, _ in places]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert (row["first_word"], row["last_word"]) == (min(at, default=None), max(at, default=None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1


def test_token_ids_equal_the_library(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    numpy = pytest.importorskip("numpy")
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file())
    rows, start = by_id(spark, "op4_token_store"), 0
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        crc = zlib.crc32(numpy.array(ids, "<u4").tobytes())
        assert (rows[doc]["start"], rows[doc]["n_tokens"], rows[doc]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)


def test_taken_words_come_near_targets(spark, connection):
    mixed = QUERIES["op2_mixing"](spark, SF_DIR).toPandas()
    source = connection.execute("SELECT doc_id, source FROM documents").df()
    joined = mixed.merge(source, on="doc_id")
    assert (joined["taken"] <= 3 * joined["size"]).all()
    for _, group in joined.groupby("source", dropna=False):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) < 1


def test_pipeline_stages_equal_brute_force(spark, connection, texts, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames.append(docs)
    quality, near, clean, mixed, tokens = frames
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    assert all(f.columns == columns for f in frames[:-1])

    judged = {doc: brute.quality(text) for doc, text in texts}
    passed = {d for d, q in judged.items() if q[0] >= 50 and 100 * q[4] <= 50 * q[0]}
    kept = {r["doc_id"]: r["text"] for r in quality.collect()}
    assert set(kept) <= passed and len(kept) >= 0.95 * len(passed)

    classes = brute.near_classes(sorted(kept.items()))
    first = {d for d, (c, _) in classes.items() if c == d}
    assert {r["doc_id"] for r in near.collect()} == first and near.count() == len(first)

    items = connection.execute("SELECT item_id, text FROM benchmark").fetchall()
    order = sorted(first)
    bad = {d for d, h in zip(order, brute.hits([kept[d] for d in order], items)) if h[4]}
    assert {r["doc_id"] for r in clean.collect()} == first - bad

    rows = mixed.collect()
    assert {r["doc_id"] for r in rows} <= first - bad and all(kept[r["doc_id"]] == r["text"] for r in rows)
    assert tokens.count() == len(rows)
    assert tokens.agg({"n_tokens": "sum"}).first()[0] == max(r["start"] + r["n_tokens"] for r in tokens.collect())
