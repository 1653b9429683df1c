"""Removal of repeated 100-byte strings: suffix order, previous and next smaller positions, longest previous factors.

Every 100-byte window has an anchor, its smallest 32-byte gram by hash; equal windows have equal
anchors. So windows are compared in buckets by anchor, and only anchors that occur twice need text:

1. anchors of all texts, counted by hash parts: which (text, anchor) have company;
2. texts meet their marked anchors and cut out the windows around them (maximal runs of windows with one anchor);
3. in each bucket the suffixes of those runs are put in order (to 100 bytes); the previous and the next one in this
   order that start earlier in the corpus give each suffix its longest previous factor, and where it reaches 100 the window is a later copy;
4. texts meet their removed intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshelf.llm.common import mix64, parts_for

LENGTH = 100
GRAM = 32
PIECE_BYTES = 2 << 20
PART_BYTES = 16 << 20
BUCKET_BYTES = 4 << 20
SORT_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64))
ANCHOR = np.dtype([("hash", "<u8"), ("text", "<u8"), ("ordinal", "<u4")])
MARK = np.dtype([("text", "<u8"), ("ordinal", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("end", "<i8")])
RUN = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("part", "<i8"), ("bytes", "<u4")])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor, over texts laid end to end (text i from offsets[i] to offsets[i + 1]).

    Returns (text, first start, last start + 1, anchor hash), starts relative to ``data``. An anchor is the
    gram with the smallest 40 leading hash bits, the leftmost of equals; both follow from the window's bytes.
    ``gram`` is a power of two.
    """
    none = np.empty(0, np.int64)
    n = len(data) - length + 1
    if n < 1:
        return none, none, none, none.astype(np.uint64)
    h, width = BYTE_HASH[data], 1
    while width < gram:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    span, wanted = 1, length - gram + 1
    while span * 2 <= wanted:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wanted:
        low = np.minimum(low[: len(low) - (wanted - span)], low[wanted - span :])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64) + 1
    for end in offsets[1:].tolist():  # windows that would leave their text
        at[max(0, end - length + 1) : end] = 0
    bounds = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
    held = at[bounds[:-1]] > 0
    first, last = bounds[:-1][held], bounds[1:][held]
    text = np.searchsorted(offsets, first, side="right") - 1
    return text, first, last, h[at[first] - 1]


def text_runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of ``texts`` of bounded size: (index of the first text, bytes, shift, text, first, last, hash).

    A text longer than a piece is cut into pieces that overlap by one window less one byte; ``shift`` is then the
    piece's place in the text.
    """
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE_BYTES:
            whole = np.frombuffer(texts[at], np.uint8)
            for shift in range(0, max(1, len(whole) - LENGTH + 1), PIECE_BYTES):
                piece = whole[shift : shift + PIECE_BYTES + LENGTH - 1]
                yield (at, piece, shift, *anchored_runs(piece, np.array([0, len(piece)])))
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= PIECE_BYTES:
            size += len(texts[end])
            end += 1
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:end]])])
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        yield (at, data, 0, *anchored_runs(data, offsets))
        at = end


def ordinals(text: np.ndarray, held: dict[int, int], base: int) -> np.ndarray:
    """The place of each run among its text's runs; ``held`` counts those of texts cut into pieces."""
    if not len(text):
        return text
    fresh = np.concatenate([[True], text[1:] != text[:-1]])
    starts = np.flatnonzero(fresh)
    place = np.arange(len(text)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(text)]])))
    add = np.array([held.get(base + t, 0) for t in text[starts].tolist()])
    place += np.repeat(add, np.diff(np.concatenate([starts, [len(text)]])))
    held[base + int(text[-1])] = int(place[-1]) + 1
    return place


def prefix_ranks(data: np.ndarray) -> dict[int, np.ndarray]:
    """For widths 1, 2, 4, ... 64: a number per position that orders and identifies that many bytes from there."""
    ranks = {1: data.astype(np.uint64)}
    for width in (1, 2, 4):
        ranks[2 * width] = (ranks[width][:-width] << np.uint64(8 * width)) | ranks[width][width:]
    ranks[8] = np.unique(ranks[8], return_inverse=True)[1].astype(np.int64)
    for width in (8, 16, 32):
        pair = ranks[width][:-width] * len(data) + ranks[width][width:]
        ranks[2 * width] = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    return ranks


def common_prefixes(ranks: dict[int, np.ndarray], left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, up to ``length``, agree from each pair of positions."""
    shared = np.zeros(len(left), np.int64)
    for width in sorted(ranks, reverse=True):
        room = np.flatnonzero(shared + width <= length)
        at = shared[room]
        equal = ranks[width][left[room] + at] == ranks[width][right[room] + at]
        shared[room[equal]] += width
    return shared


def nearest_smaller(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix with the nearest one before it that starts at a smaller position; 0 without one.

    ``shared[i]`` is the common prefix of i - 1 and i. All suffixes jump at once: whoever stands on a larger position takes
    that one's pointer and the smaller prefix, so pointers double and the rounds grow with the logarithm.
    """
    at = np.arange(-1, len(position) - 1)
    least = shared.copy()
    open_ = np.flatnonzero(at >= 0)
    while len(open_ := open_[(at[open_] >= 0)]) and len(open_ := open_[position[at[open_]] > position[open_]]):
        on = at[open_]
        least[open_], at[open_] = np.minimum(least[open_], least[on]), at[on]
    least[at < 0] = 0
    return least


def longest_previous_factors(data: np.ndarray, windows: np.ndarray, position: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Per window the longest string, up to ``length``, that starts there and at a window of smaller ``position`` too.

    ``windows`` are starts in ``data``; ``position`` orders them in the corpus and is unique.
    """
    ranks = prefix_ranks(data)
    pair = ranks[64][windows] * len(data) + ranks[64][windows + length - 64]
    order = np.lexsort((position, pair))
    start, place = windows[order], position[order]
    shared = np.zeros(len(order), np.int64)
    shared[1:] = common_prefixes(ranks, start[:-1], start[1:], length)
    before = nearest_smaller(place, shared)
    after = nearest_smaller(place[::-1], np.concatenate([shared[:1] * 0, shared[1:][::-1]]))[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _packed(records: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(parts, kind="stable")
    records, parts = records[order], parts[order]
    bounds = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]])
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b > a:
            yield int(parts[a]), records[a:b].tobytes()


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"blob": pa.binary(), "text": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.int64())) for i, n in enumerate(names)], names=list(names))


def anchor_parts(docs: DataFrame, n_parts: int) -> DataFrame:
    """(part, known, blob): anchors of all different texts of a task, dealt by anchor hash.

    Where a task has several anchors with one hash, one goes to the hash's part and the others are marks already
    (``known``), dealt by text: an anchor of a third of all texts is compared once per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts, names = [], []
            for value in batch.column(0):
                text = value.as_py().encode("utf-8", "surrogatepass")
                if len(text) >= LENGTH and (name := hashlib.md5(text).digest()) not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    texts.append(text)
                    names.append(name)
            ids = np.frombuffer(b"".join(n[:8] for n in names), "<u8")
            counted: dict[int, int] = {}
            for base, _, _, text, _, _, hashes in text_runs(texts):
                records = np.zeros(len(hashes), ANCHOR)
                records["hash"], records["text"], records["ordinal"] = hashes, ids[base + text], ordinals(text, counted, base)
                order = np.argsort(hashes, kind="stable")
                again = np.zeros(len(records), bool)
                again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
                company = again.copy()
                company[order[:-1]] |= again[order[1:]]
                rows = [(p, 0, b) for p, b in _packed(records[~again], (hashes[~again] % np.uint64(n_parts)).astype(np.int64))]
                marks = np.zeros(int(company.sum()), MARK)
                marks["text"], marks["ordinal"] = records["text"][company], records["ordinal"][company]
                rows += [(p, 1, b) for p, b in _packed(marks, (marks["text"] % np.uint64(n_parts)).astype(np.int64))]
                if rows:
                    yield _batch(rows, ("part", "known", "blob"))

    return docs.select("text").mapInArrow(run, "part bigint, known bigint, blob binary")


def repeated_anchors(anchors: DataFrame, n_parts: int) -> DataFrame:
    """(part, blob): marks (text, ordinal) of anchors that occur more than once, dealt by text."""

    def run(table: pa.Table) -> pa.Table:
        blobs = list(zip(table.column("known").to_pylist(), table.column("blob").to_pylist()))
        records = np.frombuffer(b"".join(b for known, b in blobs if not known), ANCHOR)
        order = np.lexsort((records["ordinal"], records["text"], records["hash"]))
        records = records[order]
        if len(records):
            same = records[1:] == records[:-1]  # copies of a text from several tasks
            records = records[np.concatenate([[True], ~same])]
        equal = records["hash"][1:] == records["hash"][:-1]
        company = np.zeros(len(records), bool)
        company[1:] |= equal
        company[:-1] |= equal
        marks = np.zeros(int(company.sum()), MARK)
        marks["text"], marks["ordinal"] = records["text"][company], records["ordinal"][company]
        marks = np.concatenate([marks, np.frombuffer(b"".join(b for known, b in blobs if known), MARK)])
        rows = list(_packed(marks, (marks["text"] % np.uint64(n_parts)).astype(np.int64)))
        return pa.Table.from_batches([_batch(rows, ("part", "blob"))])

    return anchors.groupBy("part").applyInArrow(run, "part bigint, blob binary")


def different_texts(docs: DataFrame, n_parts: int) -> DataFrame:
    """(doc_id, n_bytes, part, text): every row; later copies within a task have a null text and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            texts = [v.as_py().encode("utf-8", "surrogatepass") for v in batch.column(1)]
            ids = batch.column(0).to_pylist()
            names = [hashlib.md5(t).digest() for t in texts]
            order = sorted(range(len(ids)), key=lambda i: NO_ID if ids[i] is None else ids[i])
            for i in order:
                seen.setdefault(names[i], i)
            kept = [len(texts[i]) < LENGTH or seen[names[i]] == i for i in range(len(ids))]
            rows = [
                (ids[i], len(t), int.from_bytes(names[i][:8], "little") % n_parts if kept[i] else None, t if kept[i] else None)
                for i, t in enumerate(texts)
            ]
            yield _batch(rows, ("doc_id", "n_bytes", "part", "text"))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, part bigint, text binary")


def _named(table: pa.Table) -> list[tuple[int, int, bytes, bytes]]:
    """(doc, tie, name, text) of each row, in corpus order; a null doc_id comes last."""
    out = []
    for doc, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()):
        name = hashlib.md5(text).digest()
        out.append((NO_ID if doc is None else doc, int.from_bytes(name[8:], "little", signed=True), name, text))
    return sorted(out, key=lambda r: r[:2])


def marked_runs(texts: DataFrame, marks: DataFrame, n_parts: int, n_buckets: int) -> DataFrame:
    """(bucket, known, blob): the runs of windows around marked anchors, dealt by anchor.

    Of equal runs within a call the first goes on; the others are intervals to remove already (``known``).
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first: dict[bytes, tuple] = {}
        for row in _named(left):
            if len(row[3]) >= LENGTH:
                first.setdefault(row[2], row)
        held = np.unique(np.frombuffer(b"".join(right.column("blob").to_pylist()), MARK))
        wanted = {int(t) for t in np.unique(held["text"])}
        rows = [r for r in first.values() if int.from_bytes(r[2][:8], "little") in wanted]
        ids = np.array([int.from_bytes(r[2][:8], "little") for r in rows], np.uint64)
        counted: dict[int, int] = {}
        seen: set[bytes] = set()
        known, heads, bodies = [], [], []
        for base, data, shift, text, start, end, hashes in text_runs([r[3] for r in rows]):
            own = np.zeros(len(text), MARK)
            own["text"], own["ordinal"] = ids[base + text], ordinals(text, counted, base)
            lengths = [len(r[3]) for r in rows[base : base + int(text[-1]) + 1]] if len(text) else []
            offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1] if not shift else np.zeros(len(lengths), np.int64)
            for i in np.flatnonzero(np.isin(own, held)).tolist():
                doc, tie, name, _ = rows[base + int(text[i])]
                a, b = int(start[i]), int(end[i]) + LENGTH - 1
                at, body = a - int(offsets[text[i]]) + shift, data[a:b].tobytes()
                if body in seen:
                    known.append((doc, tie, at, at + len(body), int.from_bytes(name[:8], "little")))
                else:
                    seen.add(body)
                    heads.append((hashes[i], doc, tie, at, int.from_bytes(name[:8], "little") % n_parts, len(body)))
                    bodies.append(body)
        out = []
        if heads:
            table = np.array(heads, RUN)
            buckets = (table["hash"] % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(buckets, kind="stable")
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(buckets[order])) + 1, [len(order)]])
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                chosen = order[a:b]
                head = table[chosen].tobytes()
                out.append((int(buckets[chosen[0]]), -1, len(head).to_bytes(8, "little") + head + b"".join(bodies[i] for i in chosen.tolist())))
        if known:
            spans = np.array([k[:4] for k in known], SPAN)
            part = known[0][4] % n_parts  # all rows of a call have one part
            out.append((part % n_buckets, part, spans.tobytes()))
        return pa.Table.from_batches([_batch(out, ("bucket", "known", "blob"))])

    return texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(run, "bucket bigint, known bigint, blob binary")


def removed_intervals(runs: DataFrame) -> DataFrame:
    """(part, blob): intervals to remove, by the part of their text."""

    def run(table: pa.Table) -> pa.Table:
        out, heads, bodies = [], [], []
        for known, blob in zip(table.column("known").to_pylist(), table.column("blob").to_pylist()):
            if known >= 0:
                out.append((known, blob))
                continue
            size = int.from_bytes(blob[:8], "little")
            head = np.frombuffer(blob[8 : 8 + size], RUN)
            heads.append(head)
            ends = (8 + size + np.cumsum(head["bytes"], dtype=np.int64)).tolist()
            bodies += [blob[a:b] for a, b in zip([8 + size, *ends], ends)]
        if heads:
            head = np.concatenate(heads)
            order = np.lexsort((head["start"], head["tie"], head["doc"], head["hash"]))
            spans: list[tuple] = []
            chosen: list[int] = []
            size, previous, seen = 0, None, set()
            for i in order.tolist():
                if head["hash"][i] != previous:
                    previous = head["hash"][i]
                    seen.clear()
                    if size > SORT_BYTES:
                        spans += compared(head[chosen], [bodies[j] for j in chosen])
                        chosen, size = [], 0
                if bodies[i] in seen:
                    _, doc, tie, start, part, n = head[i].tolist()
                    spans.append((part, doc, tie, start, start + n))
                else:
                    seen.add(bodies[i])
                    chosen.append(i)
                    size += len(bodies[i])
            spans += compared(head[chosen], [bodies[j] for j in chosen])
            if spans:
                table = np.array([s[1:] for s in spans], SPAN)
                out += list(_packed(table, np.array([s[0] for s in spans], np.int64)))
        return pa.Table.from_batches([_batch(out, ("part", "blob"))])

    return runs.groupBy("bucket").applyInArrow(run, "part bigint, blob binary")


def compared(head: np.ndarray, bodies: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """Removed intervals (part, doc, tie, start, end) of runs that stand in corpus order within each anchor."""
    if len(bodies) < 2:
        return []
    sizes = head["bytes"].astype(np.int64)
    base = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(head)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.empty(len(head), np.int64)
    order[np.lexsort((head["start"], head["tie"], head["doc"]))] = np.arange(len(head))
    data = np.frombuffer(b"".join(bodies), np.uint8)
    hit = longest_previous_factors(data, base[owner] + inside, order[owner] * (int(sizes.max()) + 1) + inside) >= LENGTH
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out = []
    for a, b in edges.reshape(-1, 2).tolist():
        while a < b:
            k = int(owner[a])
            stop = min(b, int(np.searchsorted(owner, k, side="right")))
            _, doc, tie, start, part, _ = head[k].tolist()
            out.append((part, doc, tie, start + int(inside[a]), start + int(inside[stop - 1]) + LENGTH))
            a = stop
    return out


def cut_out(text: bytes, intervals: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    kept, at, removed, runs = [], 0, 0, 0
    last = -1
    for start, end in sorted(intervals):
        if start > last:
            runs += 1
            kept.append(text[at:start])
            removed += end - start
        elif end > last:
            removed += end - last
        last = max(last, end)
        at = last
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes as ``kept``).

    A byte goes if a 100-byte string that covers it also starts earlier in the corpus, in the order of doc_id and
    position; strings are judged on the input, within documents. The first copy of everything stays.

    Null and empty texts have no bytes. Documents under 100 bytes keep everything. A null doc_id comes last in
    order; different texts with one doc_id are ordered by a hash of the text; rows that repeat a document
    are later copies of its first row. An empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = plain.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts, n_buckets = parts_for(size, PART_BYTES), parts_for(size, BUCKET_BYTES)
    marks = repeated_anchors(anchor_parts(plain, n_parts), n_parts)
    rows = different_texts(plain, n_parts)
    texts = rows.filter("text IS NOT NULL").select("part", "doc_id", "text")
    spans = removed_intervals(marked_runs(texts, marks, n_parts, n_buckets))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    empty = hashlib.sha256(b"").hexdigest()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        held: dict[tuple[int, int], list] = {}
        for doc, tie, start, end in np.frombuffer(b"".join(right.column("blob").to_pylist()), SPAN).tolist():
            held.setdefault((doc, tie), []).append((start, end))
        seen: set[bytes] = set()
        out = []
        for doc, tie, name, text in _named(left):
            if len(text) >= LENGTH and name in seen:
                kept, removed, runs = b"", len(text), 1
            else:
                kept, removed, runs = cut_out(text, held.get((doc, tie), []))
            seen.add(name)
            out.append((None if doc == NO_ID else doc, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + with_text]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]
        return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    first = texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(finish, schema)
    later = rows.filter("text IS NULL").select(
        "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"),
        F.lit(empty).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if with_text else []),
    )
    return first.unionByName(later)
