"""Operator 2: passages of a benchmark in documents, by Wu-Manber multi-pattern search."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import pieces, settled, small_batches, stored

#: Consecutive words of a window; an item of fewer words is one window.
WINDOW_WORDS = 10
#: Bytes of windows that are broadcast at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 16 << 20
#: Shortest strings of the classes that are searched one after another, each with its own skips.
CLASSES = (32, 12, 3)
#: Bits of the shift table's index.
TABLE_BITS = 20
#: Bytes of text that one cursor walks over.
STRETCH = 1024

#: Lower case for A-Z; white space for what is not in a word.
_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def benchmark_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct pairs of window (its words between single spaces) and item (its key as text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                found = []
                for item, body in zip(*(c.to_pylist() for c in piece.columns)):
                    words = split_words(body)
                    found += {(item or "", b" " + b" ".join(words[i:i + WINDOW_WORDS]) + b" ")
                              for i in range(max(min(len(words), 1), len(words) - WINDOW_WORDS + 1))}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary())],
                    ["item", "window"])

    rows = items.select(F.col(key).cast("string").alias("__item"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, "item string, window binary").distinct()


class Matcher:
    """All strings of one class. Text is looked at in blocks of `width` bytes: a block that occurs in
    no string's first `least` bytes moves a cursor on by almost that many; one that ends some of them
    leads to the bucket of its hash, whose strings are compared with the text."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.least = min(255, min(map(len, strings)))
        self.width = 8 if self.least >= 16 else 4 if self.least >= 8 else 3
        firsts = np.frombuffer(b"".join(s[:self.least] for s in strings), np.uint8).reshape(-1, self.least)
        self.shift = np.full(1 << TABLE_BITS, self.least - self.width + 1, np.uint8)
        for end in range(self.width, self.least + 1):  # smaller shifts are set last
            self.shift[self._hash(self._blocks(firsts, end))] = self.least - end
        self.buckets: dict[int, list[int]] = defaultdict(list)
        for i, h in enumerate(self._hash(self._blocks(firsts, self.least)).tolist()):
            self.buckets[h].append(i)

    def _blocks(self, firsts: np.ndarray, end: int) -> np.ndarray:
        out = np.zeros(len(firsts), np.uint64)
        for k in range(self.width):
            out |= firsts[:, end - self.width + k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, text: bytes) -> Iterator[tuple[int, int]]:
        """Places and numbers of all strings that occur in the text."""
        if len(text) < self.least:
            return
        padded = text + bytes(8)
        blocks = np.ndarray((len(text),), "<u8", padded, 0, (1,))  # the 8 bytes from each place on
        mask = np.uint64((1 << 8 * self.width) - 1)
        at = np.arange(self.least - self.width, len(text) - self.width + 1, STRETCH)
        stop = np.minimum(at + STRETCH, len(text) - self.width + 1)
        found = []
        while len(at):
            h = self._hash(blocks[at] & mask)
            shift = self.shift[h].astype(np.int64)
            if len(hit := np.flatnonzero(shift == 0)):
                found += zip((at[hit] + self.width - self.least).tolist(), h[hit].tolist())
            at = at + np.maximum(shift, 1)
            if not (live := at < stop).all():
                at, stop = at[live], stop[live]
        for start, h in found:
            for i in self.buckets.get(h, ()):
                if text.startswith(self.strings[i], start):
                    yield start, i


class Windows:
    """The windows of a block with the items that have them."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        items = defaultdict(list)
        for item, window in rows:
            items[bytes(window)].append(item)
        classes = defaultdict(list)
        for window in sorted(items):
            classes[next(c for c in CLASSES if len(window) >= c)].append(window)
        self.matchers = [(Matcher(s), [(w.count(b" ") - 1, items[w]) for w in s]) for s in classes.values()]

    def find(self, texts: list[list[bytes]]) -> dict[int, tuple[np.ndarray, set[str]]]:
        """For documents with an occurrence: which of their words are hit, and the items."""
        parts = [b" " + b" ".join(words) + b" " for words in texts]
        text = b"".join(parts)  # two spaces between documents are in no window
        ends = np.cumsum([len(p) for p in parts])
        found: dict[int, tuple[np.ndarray, set[str]]] = {}
        spaces: dict[int, np.ndarray] = {}
        for matcher, windows in self.matchers:
            for start, i in matcher.search(text):
                d = int(np.searchsorted(ends, start, side="right"))
                if d not in found:
                    found[d] = np.zeros(len(texts[d]), bool), set()
                    spaces[d] = np.flatnonzero(np.frombuffer(parts[d], np.uint8) == 32)
                word = int(np.searchsorted(spaces[d], start - int(ends[d]) + len(parts[d])))
                found[d][0][word:word + windows[i][0]] = True
                found[d][1].update(windows[i][1])
        return found


def _searched(docs: DataFrame, block) -> DataFrame:
    """One pass: adds this block's hits to __hit (packed) and __items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = block.value
        pack, unpack = zstandard.ZstdCompressor(1).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece in pieces(batch, "__text"):
                texts = [split_words(t) for t in piece.column("__text").to_pylist()]
                found, n_hit, hits, items = windows.find(texts), [], [], []
                for i, (hit, had) in enumerate(zip(piece.column("__hit").to_pylist(), piece.column("__items").to_pylist())):
                    now, names = found.get(i, (None, ()))
                    if hit is not None:
                        before = np.unpackbits(np.frombuffer(unpack(hit), np.uint8), count=len(texts[i])).astype(bool)
                        now = before if now is None else now | before
                    n_hit.append(0 if now is None else int(now.sum()))
                    hits.append(None if now is None else pack(np.packbits(now).tobytes()))
                    items.append(sorted({*(had or ()), *names}))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("__row"), piece.column("__text"), pa.array(hits, pa.binary()),
                     pa.array(items, pa.list_(pa.string())), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(n_hit, pa.int64())], [f.name for f in schema])

    schema = T.StructType([*docs.schema.fields[:4], T.StructField("__n_words", T.LongType()),
                           T.StructField("__n_hit", T.LongType())])
    return docs.mapInArrow(run, schema)


def mark_contamination(docs: DataFrame, items: DataFrame, columns: list[str], text: str = "text",
                       item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The given columns of docs, and of each row __n_words, __n_hit (words inside any occurrence
    of a window) and __items (items with occurring windows, as sorted texts).

    Words are lower-cased runs of ASCII letters and digits and of all that isn't ASCII. NULL texts
    have no words; items without words have no windows; items without a key are named ""; rows of
    one item key are one item; an empty benchmark leaves every row without hits.

    Windows are broadcast in blocks of about BLOCK_BYTES; every block is one narrow pass over the
    documents, which stores what is found so far for the next. Pairs of window and item are dealt out
    to the blocks, so a window that very many items share fills no block either.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = settled(benchmark_windows(items, item_key, item_text))
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item") + 100)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(text).alias("__text"),
                      F.lit(None).cast("binary").alias("__hit"), F.lit(None).cast("array<string>").alias("__items"))
    for b in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b).collect()
        out = _searched(out, spark.sparkContext.broadcast(Windows([(r["item"], r["window"]) for r in rows])))
        if b < blocks - 1:
            out = stored(out.drop("__n_words", "__n_hit"), "searched")  # one block in memory at a time
    return out.select(*[F.col("__row").getField(c).alias(c) for c in columns], "__n_words", "__n_hit", "__items")


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", **keys: str) -> DataFrame:
    """The rows of docs that have no hit, with all columns of docs."""
    return mark_contamination(docs, items, docs.columns, text, **keys).filter(F.col("__n_hit") == 0).select(
        *[F.col(f"`{c}`") for c in docs.columns])


_SQL_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w")
CONTAMINATION_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_SQL_WORDS} from benchmark),
bi as (select item, w, unnest(range(1, greatest(len(w) - {WINDOW_WORDS - 1}, 1) + 1)) as i from b where len(w) > 0),
bw as (select distinct item, w[i:least(i + {WINDOW_WORDS - 1}, len(w))] as win from bi),
di as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
dw as (select doc_id, i, k, w[i:i + k - 1] as win from di, (select distinct len(win) as k from bw) where i + k - 1 <= len(w)),
h as (select doc_id, i, k, item from dw join bw using (win)),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by 1),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""
