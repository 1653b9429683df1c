"""Slow, plain versions of what the operators compute, for small inputs."""

import hashlib
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_words(text):
    return PLAIN_WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE_KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),  # noqa: B023
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 10 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def quality(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if SPACE_WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def repeats(texts, length=100):
    """Per text in corpus order: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        mask = bytearray(len(data))
        fresh = []
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                mask[i : i + length] = b"\1" * length
            else:
                seen.add(window)
                fresh.append(window)
        kept = bytes(b for b, m in zip(data, mask) if not m)
        runs = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        out.append((len(data), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return out


def hits(docs, items, window=10):
    """Per document: (n_words, n_hit, n_items, items_sha256, contaminated)."""
    grams = {}
    for item, text in items:
        words = plain_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            grams.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    out = []
    for text in docs:
        words, hit, found = plain_words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(words) - n + 1):
                if (names := grams.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def near_classes(docs, width=5):
    """doc_id -> (class_id, n_links) for distinct doc_ids."""
    ids = [d for d, _ in docs]
    sets = []
    for _, text in docs:
        words = plain_words(text)
        n = min(width, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    parent, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    smallest = {}
    for i, d in enumerate(ids):
        smallest[find(i)] = min(d, smallest.get(find(i), d))
    return {d: (smallest[find(i)], links[i]) for i, d in enumerate(ids)}
