"""Operator 4: near-duplicate documents by SimHash and bit-sliced comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import pieces, settled, small_batches
from hourloom.llm.components import Forest, components

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints that a bucket has in the mean, and at most before it is cut into tiles.
BUCKET, TILE = 2048, 4096
#: Queries whose counters are held at once.
QUERIES = 256

_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def fingerprint_batch(texts: list[str | None]) -> np.ndarray:
    """Unsigned fingerprints; 0 for texts without words."""
    hashes, sizes, digest = [], [], xxhash.xxh64_intdigest
    for text in texts:
        words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        n = max(min(len(words), 1), len(words) - SHINGLE_WORDS + 1)
        last = ends[SHINGLE_WORDS - 1:] if len(words) >= SHINGLE_WORDS else ends[-1:]
        hashes += [digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], last)]
        sizes.append(n)
    size = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > size[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, key: str, text: str, *also: Column) -> DataFrame:
    """__key, further columns, and __fp, the fingerprint as a bigint with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text", 1 << 20):
                found = fingerprint_batch(piece.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(found.view(np.int64))], names)

    rows = docs.select(F.col(key).alias("__key"), *also, F.col(text).alias("__text"))
    names = [*rows.columns[:-1], "__fp"]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("__fp", T.LongType())]))


def _mark(text: str) -> Column:
    return F.xxhash64(F.col(text))


def _add(total: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save: three bits of one weight become one of it and one of the next."""
    both = x ^ y
    return total ^ both, (x & y) | (total & both)


class Counters:
    """Distances of many pairs, bit by bit in vertical words: ones, twos, fours, and beyond seven."""

    def __init__(self, shape):
        self.ones, self.twos, self.fours, self.over = (np.zeros(shape, np.uint64) for _ in range(4))

    def add_eight(self, d: list[np.ndarray]) -> None:
        twos = []
        for k in range(0, 8, 2):
            self.ones, carry = _add(self.ones, d[k], d[k + 1])
            twos.append(carry)
        self.twos, first = _add(self.twos, twos[0], twos[1])
        self.twos, second = _add(self.twos, twos[2], twos[3])
        self.fours, eights = _add(self.fours, first, second)
        self.over |= eights

    def beyond(self) -> np.ndarray:
        """Bits of the pairs whose distance is over RADIUS, four."""
        return self.over | (self.fours & (self.ones | self.twos))

    def keep(self, live) -> None:
        self.ones, self.twos, self.fours, self.over = (x[live] for x in (self.ones, self.twos, self.fours, self.over))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b has bit b of all values, 64 of them to a word."""
    padded = np.pad(values, (0, -len(values) % 64))
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def near_pairs(left: np.ndarray, right: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in left and in right of all pairs within RADIUS bits, a stretch of left at a time.

    Every word of 64 pairs is given up as soon as all of them are beyond the radius.
    """
    sliced = planes(right)
    valid = np.full(sliced.shape[1], _ALL)
    if len(right) % 64:
        valid[-1] = _U((1 << len(right) % 64) - 1)
    for low in range(0, len(left), QUERIES):
        own = left[low:low + QUERIES]
        flip = np.where((own[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & _U(1), _ALL, _U(0))
        count = Counters((len(own), sliced.shape[1]))
        for at in range(0, 24, 8):
            count.add_eight([flip[b][:, None] ^ sliced[b][None, :] for b in order[at:at + 8]])
        within = ~count.beyond() & valid
        query, word = np.nonzero(within)
        count.keep((query, word))
        for at in range(24, 64, 8):
            if not len(query):
                break
            count.add_eight([flip[b][query] ^ sliced[b][word] for b in order[at:at + 8]])
            within = ~count.beyond() & valid[word]
            live = np.flatnonzero(within)
            query, word = query[live], word[live]
            count.keep(live)
        if len(query):
            bits = np.unpackbits(within[live].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, bit = np.nonzero(bits)
            yield low + query[pair], word[pair] * 64 + bit


def tables(distinct: int) -> list[list[tuple[int, int]]]:
    """For each table the (place, width) of the bits that make its bucket. The fingerprint is cut into
    RADIUS + k blocks; two within the radius agree in k blocks of them, so every choice of k is a
    table. k grows with the number of fingerprints, so that a bucket has about BUCKET of them."""
    need = max(0, math.ceil(math.log2(max(1, distinct / BUCKET))))
    k = next((k for k in range(1, 4) if 64 // (RADIUS + k) * k >= need), 4)
    width = 64 // (RADIUS + k)
    used = min(width, -(-need // k))
    return [[(b * width, used) for b in chosen] for chosen in combinations(range(RADIUS + k), k)]


def _compare(order: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of tiles: each fingerprint with the first of its component here."""
    fp, second = rows["__fp"].to_numpy(np.int64).view(np.uint64), rows["__side"].to_numpy()
    one = not second.any()
    left, right = (fp, fp) if one else (fp[~second], fp[second])
    all_fps = fp if one else np.concatenate([left, right])
    shift, forest = 0 if one else len(left), Forest(len(all_fps))
    for i, j in near_pairs(left, right, order):
        if one:
            i, j = i[i < j], j[i < j]
        if len(i):
            cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            for q, others in zip(i[cuts].tolist(), np.split(j, cuts[1:])):
                forest.link(q, others + shift)
    linked = np.flatnonzero(forest.label != np.arange(len(all_fps)))
    return pd.DataFrame({"a": all_fps[linked].view(np.int64), "b": all_fps[forest.label[linked]].view(np.int64)})


def links(distinct: DataFrame, n: int) -> DataFrame:
    """a, b: links that connect all fingerprints (__fp, n different ones) within RADIUS bits."""
    cut = tables(n)
    bucket = [F.struct(F.lit(t).alias("__table"), sum(
        (F.shiftleft(F.shiftrightunsigned("__fp", place).bitwiseAND(F.lit((1 << width) - 1)), k * width)
         for k, (place, width) in enumerate(blocks)), F.lit(0).cast("long")).alias("__bucket"))
        for t, blocks in enumerate(cut)]
    members = distinct.select("__fp", F.explode(F.array(*bucket)).alias("__at")).select("__fp", "__at.*")
    at = ["__table", "__bucket"]
    large = settled(members.groupBy(*at).agg(F.count("*").alias("__n")).filter(F.col("__n") > TILE)
                    .select(*at, F.ceil(F.col("__n") / TILE).cast("int").alias("__tiles")))
    if large.isEmpty():
        members = members.withColumns({"__low": F.lit(0), "__high": F.lit(0), "__side": F.lit(False)})
    else:  # every two tiles of a large bucket meet in a task of their own
        members = (members.join(large, at, "left").withColumn("__tiles", F.coalesce("__tiles", F.lit(1)))
                   .withColumn("__tile", F.pmod(F.xxhash64("__fp", F.lit(1)), F.col("__tiles")).cast("int"))
                   .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
                   .select("__fp", *at, F.least("__tile", "__other").alias("__low"),
                           F.greatest("__tile", "__other").alias("__high"),
                           (F.col("__tile") > F.col("__other")).alias("__side")))
    # Bits that no table uses for its buckets tell most; they are counted first.
    used = {b for blocks in cut for place, width in blocks for b in range(place, place + width)}
    order = np.array(sorted(range(64), key=lambda b: (b in used, b)))
    return (members.groupBy(*at, "__low", "__high")
            .applyInPandas(lambda rows: _compare(order, rows), "a long, b long"))


def _rooted(rows: DataFrame) -> DataFrame:
    """__fp, __root, the same for all fingerprints of a component, and __least, the fingerprint's smallest key."""
    distinct = settled(rows.groupBy("__fp").agg(F.min("__key").alias("__least")))
    roots = components(links(distinct, distinct.count()), "a", "b")
    linked = distinct.join(roots.withColumnRenamed("__node", "__fp"), "__fp", "left") \
        .withColumn("__root", F.coalesce("__root", "__fp"))
    return settled(linked)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, fingerprint (16 hexadecimal digits) and component_id of every row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are 4 words, or all
    of a shorter text; NULL and empty texts have fingerprint zero. Fingerprints at 4 or fewer
    differing bits are linked; component_id is the smallest key that links lead to, itself included.
    Rows of one text share a fingerprint and so a component; a NULL key is never a component_id but
    where a whole component has no other.
    """
    small_batches(docs.sparkSession)
    rows = settled(fingerprints(docs, key, text))
    linked = _rooted(rows)
    least = settled(linked.groupBy("__root").agg(F.min("__least").alias("component_id")))
    named = settled(linked.join(least, "__root").select("__fp", "component_id"))
    return rows.join(named, "__fp").select(
        F.col("__key").alias(key), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs of which one per component stays: the one with the smallest key, by a hash of
    the text among those that share it, and a row without a key only where no row of the component has
    one. Rows are told apart by key and text, so one key may stand for several texts. Texts without
    words have nothing to compare: beside the one with the smallest key, one without a key stays."""
    small_batches(docs.sparkSession)
    rows = settled(fingerprints(docs, key, text, _mark(text).alias("__mark")))
    apart = F.col("__key").isNull() & (F.col("__fp") == 0)
    kinds = settled(rows.groupBy("__fp", "__key", "__mark").agg(F.count("*").alias("__n")))
    first = F.min(F.struct(F.col("__key").isNull().alias("__null"), "__key", "__mark", "__n")).alias("__first")
    best = kinds.groupBy("__fp", apart.alias("__apart")).agg(first)
    best = settled(best.join(_rooted(rows).select("__fp", "__root"), "__fp")
                   .groupBy("__root", "__apart").agg(F.min("__first").alias("__first")).select("__first.*"))
    same = [F.col("l.__key").eqNullSafe(F.col("r.__key")), F.col("l.__mark") == F.col("r.__mark")]
    away = settled(kinds.alias("l").join(best.alias("r"), same, "left_anti")
                   .select(F.col("__key").alias("__away"), F.col("__mark").alias("__away_mark")))
    again = settled(best.filter("__n > 1").select(F.col("__key").alias("__away"), F.col("__mark").alias("__away_mark")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    here = [F.col(key).eqNullSafe(F.col("__away")), F.col("__mark") == F.col("__away_mark")]
    kept = docs.withColumn("__mark", _mark(text)).join(away, here, "left_anti")
    if again.isEmpty():
        return kept.select(*columns)
    once = kept.join(again, here, "left_semi").dropDuplicates([key, "__mark"])
    return kept.join(again, here, "left_anti").select(*columns).union(once.select(*columns))
