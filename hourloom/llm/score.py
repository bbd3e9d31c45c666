"""Operator 10: language-model scores from a log-frequency Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import pieces, small_batches, stored

#: A filter entry takes so many bits in the mean and sets so many of one 64-bit word, so that a lookup
#: touches memory once; about 5 % of lookups find what isn't there.
ENTRY_BITS, PROBES = 8, 3
#: Counts are kept as powers of this.
STEP = 1.5
#: Words of the unigram model that count as much as the pairs seen after a word.
PRIOR = 200.0
#: A pair that is rarer is not kept; 1 keeps all.
LEAST_COUNT = 1
#: Words counted in a task before they are sent, and n-grams a segment of the model has at most, about.
FLUSH_WORDS, SEGMENT_GRAMS = 2_000_000, 2_000_000
#: Bytes of the model that are broadcast at once; a larger model is applied block by block.
BLOCK_BYTES = 128 << 20
#: Segments of a block that the driver collects at once, and bytes of text that a task works on at once.
COLLECTED, READ_BYTES = 16, 2 << 20
#: Different words that a worker keeps numbers for.
KEPT_WORDS = 100_000

_END, _BEGIN = xxhash.xxh3_64_intdigest(b""), xxhash.xxh3_64_intdigest(b"\n")
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mixed(before * _U(0x9E3779B97F4A7C15) + words)


class Words:
    """Numbers of the words met so far in this task, and their hashes; reset() bounds the memory."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[bytes, bytes] = {b"": (0).to_bytes(4, "little")}  # the end of a text
        self.hashes = [_END]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, an end after each text, and where each text begins."""
        if len(self.hashes) > KEPT_WORDS:
            self.reset()
        numbers, hashes = self.numbers, self.hashes
        split = [(t or "").encode().lower().split() for t in texts]  # bytes: A-Z and ASCII white space alone
        for word in set().union(*split).difference(numbers):
            numbers[word] = len(hashes).to_bytes(4, "little")
            hashes.append(xxhash.xxh3_64_intdigest(word))
        for words in split:
            words.append(b"")
        begins = np.concatenate([[0], np.cumsum([len(words) for words in split])[:-1]]).astype(np.int64)
        get = numbers.__getitem__
        return np.frombuffer(b"".join([b"".join(map(get, words)) for words in split]), "<u4"), begins


def _before(words: np.ndarray, begins: np.ndarray, first) -> np.ndarray:
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[begins] = first
    return out


def _segments(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)


_PART = "__kind int, __segment long, __grams binary, __counts binary"


def gram_counts(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """Words (kind 1) and pairs (kind 2) of all texts with their counts so far, as sorted arrays by
    segment, the first bits of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            for kind in (1, 2):
                grams, n = np.unique(np.concatenate([h[kind - 1] for h in held]), return_counts=True)
                ends = np.searchsorted(_segments(grams, bits), np.arange(1 << bits), side="right") if bits < 22 \
                    else None
                if ends is None:  # more segments than grams: cut where the segment changes
                    ends = np.append(np.flatnonzero(np.diff(_segments(grams, bits))) + 1, len(grams))
                cuts = [(a, b) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()) if a < b]
                names = _segments(grams[[a for a, _ in cuts]], bits).tolist()
                n = n.astype("<u4")
                for low in range(0, len(cuts), 256):
                    part = cuts[low:low + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(part), pa.int32()), pa.array(names[low:low + 256], pa.int64()),
                         pa.array([grams[a:b].tobytes() for a, b in part], pa.binary()),
                         pa.array([n[a:b].tobytes() for a, b in part], pa.binary())],
                        ["__kind", "__segment", "__grams", "__counts"])

        for batch in batches:
            for piece in pieces(batch, "__text", READ_BYTES):
                numbers, begins = words.read(piece.column(0).to_pylist())
                hashes = np.array(words.hashes, np.uint64)[numbers]
                held.append((hashes, _pairs(_before(hashes, begins, _BEGIN), hashes)))
                size += len(hashes)
                if size >= FLUSH_WORDS:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    return docs.select(F.col(text).alias("__text")).mapInArrow(run, _PART)


def filter_entry(grams: np.ndarray, level: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word and the bits in it of the entries (gram, level), in filters of so many words."""
    x = _mixed(grams + _U(level * 0xD1B54A32D192ED03 % (1 << 64)))
    at, bits = ((x >> _U(32)) * words) >> _U(32), np.zeros(len(x), np.uint64)
    for k in range(PROBES):
        bits |= _U(1) << (x >> _U(6 * k) & _U(63))
    return at, bits


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for one, one more for every factor STEP."""
    return 1 + np.floor(np.log(counts) / math.log(STEP) + 1e-9).astype(np.int64)


def lowest_count(level: np.ndarray) -> np.ndarray:
    """The smallest count of a level; 0 has none."""
    return np.where(level > 0, np.ceil(STEP ** (np.maximum(level, 1) - 1.0) - 1e-9), 0.0)


def _segment(table: pa.Table) -> pa.Table:
    """One segment of the model from all its partial counts: a sorted table of words, or filter bits of pairs."""
    grams = np.concatenate([np.frombuffer(b, "<u8") for b in table.column("__grams").to_pylist()])
    counts = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("__counts").to_pylist()]).astype(np.int64)
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    grams, counts = grams[first], np.add.reduceat(counts, first)
    kind, total, size = table.column("__kind")[0].as_py(), int(counts.sum()), 0
    if kind == 1:
        narrow = next(n for n in (1, 2, 4, 8) if counts.max() < 1 << 8 * n)
        data, more = grams.tobytes(), counts.astype(f"<u{narrow}").tobytes()
    else:
        grams, counts = grams[counts >= LEAST_COUNT], counts[counts >= LEAST_COUNT]
        level = levels(np.maximum(counts, 1))
        size = max(1, -(-int(level.sum()) * ENTRY_BITS // 64))
        filled = np.zeros(size, np.uint64)
        for j in range(1, int(level.max(initial=0)) + 1):
            at, bits = filter_entry(grams[level >= j], j, _U(size))
            np.bitwise_or.at(filled, at.astype(np.int64), bits)
        data, more = filled.astype("<u8").tobytes(), b""
    return pa.table({"kind": pa.array([kind], pa.int32()), "segment": table.column("__segment").slice(0, 1),
                     "size": [size], "grams": [len(grams)], "total": [total],
                     "bytes": [len(data) + len(more)], "data": pa.array([data], pa.binary()),
                     "more": pa.array([more], pa.binary())})


_MODEL = "kind int, segment long, size long, grams long, total long, bytes long, data binary, more binary"


class Block:
    """Consecutive segments of the model, low <= segment < high, as they were stored."""

    def __init__(self, bits: int, low: int, high: int):
        self.bits, self.low, self.high = bits, low, high
        self.words: list[tuple[bytes, bytes] | None] = [None] * (high - low)
        self.filters: list[bytes | None] = [None] * (high - low)

    def add(self, row: dict) -> None:
        at = row["segment"] - self.low
        if row["kind"] == 1:
            self.words[at] = row["data"], row["more"]
        else:
            self.filters[at] = row["data"]

    def _slices(self, grams: np.ndarray, have: list) -> Iterator[tuple[slice, object]]:
        """The part of sorted grams in each segment that the block has."""
        segment = np.arange(self.low, self.high)
        cuts = np.searchsorted(_segments(grams, self.bits), np.append(segment, self.high)).tolist()
        return ((slice(a, b), own) for a, b, own in zip(cuts, cuts[1:], have) if a < b and own)

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        out, order = np.zeros(len(words)), np.argsort(words)
        words = words[order]
        for part, (known, counts) in self._slices(words, self.words):
            known = np.frombuffer(known, "<u8")
            counts = np.frombuffer(counts, f"<u{len(counts) // len(known)}")
            at = np.minimum(np.searchsorted(known, words[part]), len(known) - 1)
            out[order[part]] = np.where(known[at] == words[part], counts[at], 0)
        return out

    def pair_levels(self, pairs: np.ndarray) -> np.ndarray:
        """Level by level, until a probe finds a bit that isn't set. 0 outside of the block."""
        pairs, back = np.unique(pairs, return_inverse=True)
        out = np.zeros(len(pairs), np.uint8)
        for part, filled in self._slices(pairs, self.filters):
            filled = np.frombuffer(filled, "<u8")
            grams, live, level = pairs[part], np.arange(part.start, part.stop), 0
            while len(live):
                level += 1
                at, bits = filter_entry(grams, level, _U(len(filled)))
                found = filled[at.astype(np.int64)] & bits == bits
                live, grams = live[found], grams[found]
                out[live] = level
        return out[back]


def _scored(docs: DataFrame, block, last: bool, total: int, known: int, begun: int) -> DataFrame:
    """One pass: adds what this block knows to __state; the last pass turns it into scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, have = Words(), np.zeros(0), None
        own: Block = block.value
        pack, unpack = zstandard.ZstdCompressor(1).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece in pieces(batch, "__text", READ_BYTES):
                numbers, begins = words.read(piece.column("__text").to_pylist())
                if have is not words.numbers:
                    have, counts = words.numbers, np.zeros(0)
                counts = np.concatenate([counts, own.word_counts(np.array(words.hashes[len(counts):], np.uint64))])
                hashes = np.array(words.hashes, np.uint64)[numbers]
                count = counts[numbers]
                level = own.pair_levels(_pairs(_before(hashes, begins, _BEGIN), hashes))
                if (state := piece.column("__state").to_pylist()) and state[0] is not None:
                    raw = [unpack(s) for s in state]
                    count = count + np.concatenate([np.frombuffer(r, "<f8", len(r) // 9) for r in raw])
                    level = level + np.concatenate([np.frombuffer(r, np.uint8, offset=len(r) // 9 * 8) for r in raw])
                ends = np.append(begins[1:], len(numbers))
                keep = [piece.column(c) for c in ("__key", "__held")]
                if not last:
                    state = [pack(count[a:b].astype("<f8").tobytes() + level[a:b].tobytes()) for a, b in zip(begins, ends)]
                    yield pa.RecordBatch.from_arrays([*keep, piece.column("__text"), pa.array(state, pa.binary())],
                                                     ["__key", "__held", "__text", "__state"])
                    continue
                base = (count + 0.5) / (total + 0.5 * (known + 1))
                before = _before(count, begins, float(begun))
                # A pair is no more frequent than its words; this also undoes most false finds.
                seen = np.minimum(np.minimum(lowest_count(level), count), before)
                chance = (seen + PRIOR * base) / (before + PRIOR)
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(ends - begins), pa.array(np.add.reduceat((count > 0).astype(np.int64), begins)),
                     pa.array(np.add.reduceat(np.log10(base), begins)), pa.array(np.add.reduceat(np.log10(chance), begins))],
                    ["__key", "__held", "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([docs.schema["__key"], docs.schema["__held"]])
    schema = schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double") \
        if last else schema.add("__text", "string").add("__state", "binary")
    return docs.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Every fifth document or so, by the CRC-32 of its key as text; those without a key are not."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 1, F.lit(False))


def train(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int, int]:
    """The model of all given texts: a row per segment and kind, the bits that name a segment, and
    how many texts there were."""
    small_batches(docs.sparkSession)
    size, texts = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    bits = min(40, max(0, math.ceil(math.log2(max(1, (size or 0) / 5 / SEGMENT_GRAMS)))))
    model = (gram_counts(docs, text, bits).groupBy("__kind", "__segment")
             .applyInArrow(_segment, _MODEL))
    return stored(model, "model"), bits, texts


def score(docs: DataFrame, model: DataFrame, bits: int, texts: int,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probabilities of whole texts: key, held_out, n_tokens, n_known, train_tokens,
    base_score and score, one row per row of docs.

    Lower-case words and one end per text are the tokens. base_score is the smoothed unigram model
    from exact counts; score also has pairs of words: their counts come out of the filter as the
    lower edge of their level, unseen pairs share PRIOR words of the base model. As neither exceeds
    the true counts but for false finds, the chances after a word do not add up to more than one.
    NULL and empty texts are the end alone; an empty training set gives base (0.5 / 0.5).

    The model is broadcast in blocks of at most BLOCK_BYTES; every block is one narrow pass over
    the texts, which stores what is known so far for the next. Nothing is dropped.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sums = {r["kind"]: r for r in model.groupBy("kind").agg(
        F.sum("total").alias("total"), F.sum("grams").alias("grams"), F.sum("bytes").alias("bytes")).collect()}
    total, known = (int(sums[1]["total"]), int(sums[1]["grams"])) if 1 in sums else (0, 0)
    blocks = min(1 << bits, max(1, -(-sum(int(r["bytes"]) for r in sums.values()) // BLOCK_BYTES)))
    out = docs.select(F.col(key).alias("__key"), held_out(F.col(key)).alias("__held"),
                      F.col(text).alias("__text"), F.lit(None).cast("binary").alias("__state"))
    for b in range(blocks):
        low, high = (1 << bits) * b // blocks, (1 << bits) * (b + 1) // blocks
        block = Block(bits, low, high)
        for at in range(low, high, COLLECTED):
            for row in model.filter(F.col("segment").between(at, min(at + COLLECTED, high) - 1)).select(
                    "kind", "segment", "data", "more").collect():
                block.add(row.asDict())
        shared = spark.sparkContext.broadcast(block)
        del block
        out = _scored(out, shared, b == blocks - 1, total, known, texts)
        if b < blocks - 1:
            out = stored(out, "scored")  # each pass with workers of its own, one block in memory
    return out.select(F.col("__key").alias(key), F.col("__held").alias("held_out"), "n_tokens", "n_known",
                      F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents under the model of those that aren't held out."""
    model, bits, texts = train(docs.filter(~held_out(F.col(key))), text)
    return score(docs, model, bits, texts, key, text)
