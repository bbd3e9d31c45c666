"""Plain versions of the operators, and rows that are hard on them."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns whose names the operators might use for themselves.
CLASHING = ("size", "shard", "component_id", "fingerprint", "score", "ids", "label", "rows", "start", "item", "p", "count")
WORD, ITEM_WORD = re.compile("[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def odd_documents(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows, and clashing columns."""
    long = " ".join(f"word{i * i % 997}" for i in range(60_000))
    say = "the quick brown fox jumps over the lazy dog and runs away from it all"
    rows = [(1, say, "en", "b", 1), (2, say, "en", "b", 1), (2, say, "en", "b", 1), (3, say.upper(), None, None, None),
            (4, None, "en", "a", None), (5, "", "de", "a", 0), (6, " \t\n", None, "", 3), (7, long, "en", "b", 9),
            (8, "der hund und die katze sind im haus und nicht im garten", "de", "c", 2), (None, say + " again", "en", "c", 2),
            (None, None, None, None, None), (9, "x", "en", "a", 1), (10, "Éa ñandú é\x1fz  ü", "es", "c", 5),
            (11, say[:-4], "en", "b", 1), (12, "!!! ??? 12345 --- ***", "fr", "a", 4)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *[f"cast(doc_id as string) as `{c}`" for c in CLASHING])


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def components(n, pairs):
    """The smallest member of everyone's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(rows):
    """{doc_id: (fingerprint, component)} of (doc_id, text) rows with ids."""
    rows = sorted(rows)
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 4]
    return {rows[i][0]: (f"{fps[i]:016x}", rows[c][0]) for i, c in enumerate(components(len(rows), near))}


def windows(items):
    out = defaultdict(set)
    for item, text in items:
        words = ITEM_WORD.findall(lowered(text))
        for k in range(max(min(1, len(words)), len(words) - 9)):
            out[tuple(words[k:k + 10])].add("" if item is None else str(item))
    return out


def contamination(text, found):
    """Words, hit words and items of one text."""
    words, items = ITEM_WORD.findall(lowered(text)), set()
    hit, lengths = [False] * len(words), {len(w) for w in found}
    for k in range(len(words)):
        for n in lengths:
            if (own := found.get(tuple(words[k:k + n]))) and k + n <= len(words):
                hit[k:k + n] = [True] * n
                items |= own
    return len(words), sum(hit), sorted(items)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def base_scores(rows):
    """(n_tokens, n_known, base) of each (doc_id, text), with N and V."""
    tokens = [WORD.findall(lowered(t)) + [None] for _, t in rows]
    counts = Counter(w for (d, _), own in zip(rows, tokens) if not held_out(d) for w in own)
    n, v = sum(counts.values()), len(counts)
    return [(len(own), sum(w in counts for w in own),
             float(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))) for own in tokens], n
