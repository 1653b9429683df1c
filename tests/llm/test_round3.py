"""Manifest, seed and extend, fill-in-middle; clashing helper names; ids of any text; segments; exact repeats."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_edges import ROWS, ordered, words
from wattshelf.llm import decontaminate, fill_middle, line_rules, manifest, mixing, near_join, seed_extend, token_store, warc
from wattshelf.llm.common import tokenizer_file

SCHEMA = "doc_id long, text string, source string, lang string, n_chars int, k1 int, `group` int, digest string, position int, n int, form string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, s, "en", None if t is None else len(t), 1, 2, "d", 3, 4, "f") for d, t, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Manifest -----------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, arity=3):
    """(root, per leaf the list of (left, right) siblings)."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = i // arity * arity
            proofs[leaf].append(("".join(level[run:i]), "".join(level[i + 1 : run + arity])))
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], proofs


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, source, fields...)."""
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], sha("".join(map(framed, row)))))
    trees = {}
    for source, leaves in groups.items():
        leaves.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = plain_tree([leaf for _, leaf in leaves])
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = plain_tree([trees[s][0] for s in order])
    out = []
    for source in groups:
        for (doc, leaf), proof in zip(groups[source], trees[source][1]):
            out.append((doc, leaf, trees[source][0], root, proof + upper[order.index(source)]))
    return out


def found_manifest(frame, **settings):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in manifest.manifest(frame, **settings).collect()]


def test_manifest_equals_a_plain_tree(docs, none):
    rows = [(d, s, "en", None if t is None else len(t), t) for d, t, s in ROWS]
    assert ordered(found_manifest(docs)) == ordered(plain_manifest(rows))
    assert manifest.manifest(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_manifest_over_several_layers(spark, n):
    """Blocks of nine leaves, so that large groups need layers and 12 groups need two for the roots."""
    rows = [(i, f"s{i % 12}" if i < 24 else "hot", "x", i, f"t{i}") for i in range(n + 24)] + [(None, None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(4)
    found = found_manifest(frame, block_levels=2)
    assert ordered(found) == ordered(plain_manifest(rows))
    folded = manifest.manifest(frame, block_levels=2).select(
        manifest.fold(F.col("leaf"), F.col("proof")).alias("whole"), manifest.fold(F.sha2("leaf", 256), F.col("proof")).alias("changed"), "root"
    )
    assert folded.filter("whole = root AND changed <> root").count() == len(rows)


# --- Seed and extend ----------------------------------------------------------------------


def plain_removal(texts, length=35):
    split = [brute.SPACE_WORD.findall(t or "") for t in texts]
    places = {}
    for i, ws in enumerate(split):
        for p in range(len(ws) - length + 1):
            places.setdefault(tuple(ws[p : p + length]), []).append((i, p))
    gone = [set() for _ in split]
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                gone[i].update(range(p, p + length))
    return [(len(ws), len(g), sha(" ".join(w for q, w in enumerate(ws) if q not in g))) for ws, g in zip(split, gone)]


def removed(frame, **settings):
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in seed_extend.remove_substrings(frame, **settings).collect()]


def test_substring_removal(docs, none):
    want = [(d, *w) for (d, _, _), w in zip(ROWS, plain_removal([t for _, t, _ in ROWS]))]
    assert ordered(removed(docs)) == ordered(want)
    assert seed_extend.remove_substrings(none).count() == 0


def test_substring_removal_of_pieces_and_overlaps(spark):
    """Passages of 20 to 60 words pasted together, repeated words and lines, windows that just fit or just not."""
    rng = random.Random(8)
    passages = [words(400 + i, rng.randint(20, 60)) for i in range(12)]
    texts = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(1, 6)):
            ws = rng.choice(passages).split()
            parts.append(" ".join(ws[rng.randint(0, 8) : len(ws) - rng.randint(0, 8)]))
        texts.append(f"doc{i} " + rng.choice([" ", "\n", "\t\n"]).join(parts))
    texts += ["na " * 34, "na " * 35, "na " * 36, "na " * 200, "do re " * 40, "do re mi " * 30 + "end", words(1, 34), words(1, 35), words(1, 35) + " x", "x " + words(1, 36)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(removed(frame)) == [(i, *w) for i, w in enumerate(plain_removal(texts))]
    assert sorted(removed(frame, length=12, seed=5)) == [(i, *w) for i, w in enumerate(plain_removal(texts, 12))]


def test_every_window_chooses_one_anchor():
    import numpy as np

    rng = np.random.default_rng(4)
    for high in (3, 10, 1 << 40):
        hashes = rng.integers(1, high, 300).astype(np.uint64)
        position, first, last = seed_extend.winnow(hashes, 20)
        chosen = sorted(w for a, b in zip(first, last) for w in range(a, b + 1))
        assert chosen == list(range(281))
        for p, a, b in zip(position.tolist(), first.tolist(), last.tolist()):
            for w in range(a, b + 1):
                window = hashes[w : w + 20]
                assert p == w + 19 - int(window[::-1].argmin())


def test_longest_previous_factors_equal_brute_force():
    import numpy as np

    from wattshelf.llm import suffix_dedup

    rng = np.random.default_rng(2)
    for letters, n in ((2, 400), (3, 300), (26, 300), (1, 250)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        data[150:240] = data[20:110]  # a long repeat
        windows = np.arange(n - 100 + 1)
        position = rng.permutation(len(windows))
        text = data.tobytes()
        want = []
        for w in windows.tolist():
            earlier = [v for v in windows.tolist() if position[v] < position[w]]
            agree = lambda v: next((k for k in range(100) if text[v + k] != text[w + k]), 100)  # noqa: B023, E731
            want.append(max(map(agree, earlier), default=0))
        assert suffix_dedup.longest_previous_factors(data, windows, position).tolist() == want


# --- Fill in the middle -------------------------------------------------------------------


def plain_middle(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark, docs, none):
    odd = ["a$1\\2 <P", "<P>x", "mid <S> dle", "<<M>", "$", "\\", "a\nb\r\nc", "😀é漢́", "<P", "S>", " ", "ab" * 5, "<" * 9, "x<", "\x00 y"]
    rows = [(i, odd[i % len(odd)]) for i in range(150)] + [(1000, "9 " * 500_000), (1001, "word " * 200_000), (1002, "w" * 1_000_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for source, listed in ((frame, rows), (docs, [(d, t) for d, t, _ in ROWS])):
        made = fill_middle.fill_in_middle(source)
        made = made.withColumn("back", fill_middle.restore(F.col("form"), F.col("output")))
        got = [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()]
        assert ordered(got) == ordered((d, *plain_middle(d, t), t or "") for d, t in listed)
    assert fill_middle.fill_in_middle(none).count() == 0


# --- Names, ids, segments -----------------------------------------------------------------


def test_stages_keep_columns_that_have_helper_names(spark):
    extra = ["_s", "_Text_Key", "_text", "_frequent", "_first", "_mix_copy", "_mix_id", "_keep_0", "_source", "_row", "doc.x"]
    line = "subscribe to our letter and follow us on every channel you can find today"
    rows = [(i, f"{words(i, 60)}\n{line}", "s", 0, *[f"{c}{i}" for c in extra]) for i in range(30)]
    names = ["doc_id", "text", "source", "n_chars", *extra]
    frame = spark.createDataFrame(rows, names)
    benchmark = spark.createDataFrame([(1, words(3, 60))], "item_id long, text string")
    kept = line_rules.apply_rules(frame)
    one = near_join.one_of_each(kept)
    clean = decontaminate.clean_documents(one, benchmark)
    mixed = mixing.repeat_documents(clean, mixing.mix(clean, split_words=False))
    for stage, n in ((kept, 30), (one, 30), (clean, 29), (mixed, 29)):
        assert stage.columns == names and stage.count() == n
        for r in stage.collect():
            assert tuple(r)[4:] == rows[r["doc_id"]][4:] and r["text"] == words(r["doc_id"], 60)


def test_ids_of_any_text_equal_the_library():
    """20,000 random texts of many scripts, marks and white space, and runs of Latin-1 letters straight to the model."""
    np = pytest.importorskip("numpy")
    cache = token_store.WordCache(tokenizer_file())
    rng = random.Random(11)
    pools = [
        "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "éèçâîôûïüñößÉÈÇÖÄÜØÆÐþ", "İıŞşĞğŁłŒœŽžǅ", "абвйёЙЁ", "αβσςΣΆ", "0123½²",
        "'’\"-_.,;:!?()<>|@#$%&*+=~`/\\", "̀́̇̈‍ ﻿­", "漢字かな한", "😀👍🏽", "عربहिน", " \x85　\x0b\x0c\x00", "ﬁＡ①Ⅷ",
    ]
    texts = ["VERİLDİ.", "DAVASİ, ANKARA", "İ.", "ΑΣ. Σ", "ẞ.", "l'été.", "'s. n't,"]
    for _ in range(20_000):
        parts = []
        for _ in range(rng.randint(1, 8)):
            pool = rng.choice(pools) + rng.choice(pools)
            parts.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) + rng.choice(["", ".", ",", " ", "\n", "\t", ". "]))
        texts.append("".join(parts))
    want = cache.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want) if np.frombuffer(cache.encode(t), cache.kind).tolist() != w.ids] == []
    letters = "abcdefghijklmnopqrstuvwxyzß" + "".join(chr(i) for i in range(0xE0, 0x100) if i != 0xF7)
    runs = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(5_000)]
    assert [c.ids for c in cache.tokenizer.encode_batch(runs, add_special_tokens=False)] == [cache.by_model(r) for r in runs]


def test_pages_of_ordinary_size_come_in_segments(spark, tmp_path):
    rows = [(1, "http://a/1", words(1, 9_000)), (2, "http://a/2", words(1, 9_000)), (3, "http://a/3", "short"), (4, "http://a/4", words(2, 5_000))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_warc(frame, path)
    records = warc.read_records(spark, path)
    assert records.filter("record_type = 'continuation'").count() >= 3
    back = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert {i: back[i]["record_type"] for i in back} == {1: "response", 2: "revisit", 3: "response", 4: "response"}
    assert all(bytes(back[i]["payload"]).decode() == t for i, _, t in rows if i != 2)


def test_repeated_words_are_exact_for_any_vocabulary():
    rng = random.Random(6)
    for n in (0, 2, 3, 4, 50, 400):
        ws = [rng.choice("abcde").encode() for _ in range(n)]
        assert line_rules.repeated_words(ws) == brute.quality(" ".join(w.decode() for w in ws))[4]


def test_boilerplate_rule_equals_sql_where_lines_go(spark):
    """Lines above the limit and depleted documents, against the check SQL."""
    duckdb = pytest.importorskip("duckdb")
    pytest.importorskip("pandas")
    from wattshelf.llm.checks import LINE_RULES

    rows = []
    for i in range(300):
        shared = [words(5000 + j, 9) for j in range(6)]
        own = words(i, 12 if i % 3 else 70)
        rows.append((i, "\n".join([*shared[: i % 7], own]) if i % 5 else None, None if i % 11 == 0 else f"h{i % 2}"))
    rows += rows[:40]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts, _ = line_rules.judge_documents(frame)
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    cursor = con.execute(LINE_RULES)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert ordered(tuple(r) for r in verdicts.select(*columns).collect()) == ordered(want)
    at = columns.index("removed_words")
    assert sum(r[at] > 0 for r in want) > 50 and sum(not r[-1] and not r[-2] for r in want) > 10


def test_tampered_documents_do_not_verify(spark, tmp_path):
    from wattshelf.llm.queries import QUERIES

    rows = [(i, "a", "en", 9, f"line {i}\nnext" if i % 3 else "no break") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op11_manifest"](spark, str(tmp_path)).collect():
        even = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        assert r["verified"] == (not (even and r["doc_id"] % 3)) == (r["folded_root"] == r["root"])


def test_long_texts_take_time_in_proportion(spark):
    """A megabyte of numbers for the personal-data search, a megabyte of one URL for the license scan."""
    import time

    from wattshelf.llm import licenses, pii

    text = " ".join(f"{i} (415) 555-{i % 9000 + 1000} or +1 415 555 {i % 9000 + 1000} of" for i in range(25_000))
    started = time.monotonic()
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_phone"] == 25_000 and row["n_spans"] >= 25_000
    scanner = licenses.Scanner(licenses.signature_rules())
    assert scanner.detections("joinup.ec.europa.eu/" * 50_000 + " docs.python.org/" * 10_000) == []
    assert time.monotonic() - started < 200


def test_spans_are_clear_of_sure_ones(spark):
    from wattshelf.llm import pii

    rng = random.Random(9)
    spans = lambda n, kind: [(a := rng.randint(0, 4000), kind, a + rng.randint(1, 30)) for _ in range(n)]
    for n in (0, 5, 400):
        sure, others = sorted(spans(n, 1)), sorted(spans(400, 5))
        kind = "array<struct<start:bigint,kind:int,end:bigint>>"
        row = spark.createDataFrame([(sure, others)], f"sure {kind}, others {kind}").select(
            pii.clear_of(F.col("sure"), F.col("others")).alias("left")
        ).first()
        want = [o for o in others if not any(s[0] < o[2] and o[0] < s[2] for s in sure)]
        assert sorted(tuple(x) for x in row["left"]) == want
