"""Operator 3: shards of bounded size by extendible hashing, with DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import settled, stored

#: Bits of the hash; a bigint holds them without a sign.
HASH_BITS = 60
#: Bytes of text that a shard may hold.
SHARD_BYTES = 16 << 20
#: The first directory is finer than the mean shard by so many bits.
SPARE_BITS = 4
#: Buckets that are still too large are looked at with so many further bits at a time.
STEP_BITS = 8
#: A directory of at most so many slots (about 100 bytes each) is broadcast, a larger one is joined.
BROADCAST_SLOTS = 200_000


def _bits(name: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def hash_bits(key: Column, text: Column) -> Column:
    """The first 60 bits of the key's MD5; a row without a key is placed by its text."""
    return _bits(F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit(""))))))


def _prefix(bits: int) -> Column:
    return F.shiftright(F.col("__h"), HASH_BITS - bits)


def directories(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Directories (bits, slots) of rows with __at (what is split, on its own), __h and __size: __slot,
    the prefix of so many bits, leads to the bucket (__depth, __prefix) with its __bytes, __rows and
    __oversized. The first has all slots that are in use; __depth is NULL in those whose bucket needs
    more bits than that, and the following directories have these alone."""
    total = rows.groupBy("__at").agg(F.sum("__size").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    found, shallow = [], 0
    while True:
        slots = settled(
            rows.groupBy("__at", _prefix(bits).alias("__slot"))
            .agg(F.sum("__size").alias("__bytes"), F.count("*").alias("__rows"),
                 F.min("__h").alias("__low"), F.max("__h").alias("__high")))
        paths = slots.withColumn("__depth", F.explode(F.sequence(F.lit(shallow), F.lit(bits)))) \
            .withColumn("__prefix", F.expr(f"shiftright(__slot, {bits} - __depth)"))
        nodes = (paths.groupBy("__at", "__depth", "__prefix")
                 .agg(F.sum("__bytes").alias("__bytes"), F.sum("__rows").alias("__rows"),
                      (F.min("__low") == F.max("__high")).alias("__single"))
                 .filter((F.col("__bytes") <= limit) | F.col("__single"))
                 .withColumn("__oversized", F.col("__bytes") > limit).drop("__single"))
        # Bytes fall along a path: the first bucket on it that fits is where splitting ended.
        ends = (paths.select("__at", "__slot", "__depth", "__prefix").join(nodes, ["__at", "__depth", "__prefix"])
                .groupBy("__at", "__slot")
                .agg(F.min(F.struct("__depth", "__prefix", "__bytes", "__rows", "__oversized")).alias("__end"))
                .select("__at", "__slot", "__end.*"))
        slots = settled(slots.select("__at", "__slot").join(ends, ["__at", "__slot"], "left"))
        found.append((bits, slots))
        deeper = slots.filter(F.col("__depth").isNull()).select("__at", "__slot")
        if bits == HASH_BITS or deeper.isEmpty():
            return found
        rows = rows.withColumn("__slot", _prefix(bits)).join(deeper, ["__at", "__slot"], "left_semi")
        shallow, bits = bits + 1, min(HASH_BITS, bits + STEP_BITS)


def _led(rows: DataFrame, found: list[tuple[int, DataFrame]]) -> DataFrame:
    """__end of each row: the bucket that the directories lead it to; NULL where __at is in none."""
    ends = []
    for k, (bits, slots) in enumerate(found):
        side = slots.select(F.col("__at").alias(f"__at{k}"), F.col("__slot").alias(f"__slot{k}"), F.when(
            F.col("__depth").isNotNull(), F.struct("__depth", "__prefix", "__bytes", "__rows", "__oversized"))
            .alias(f"__end{k}"))
        small = slots.count() <= BROADCAST_SLOTS
        rows = rows.join(F.broadcast(side) if small else side, (F.col("__at") == F.col(f"__at{k}")) & (
            _prefix(bits) == F.col(f"__slot{k}")), "left").drop(f"__at{k}", f"__slot{k}")
        ends.append(f"__end{k}")
    return rows.withColumn("__end", F.coalesce(*[F.col(c) for c in ends])).drop(*ends)


def _too_large(found: list[tuple[int, DataFrame]]) -> bool:
    """Whether a bucket of several rows that share all bits is over the limit."""
    return any(not slots.filter(F.col("__oversized") & (F.col("__rows") > 1)).isEmpty() for _, slots in found)


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  limit: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs with shard ("depth-prefix"), shard_depth, shard_bytes, shard_rows and
    oversized; columns of docs with one of these names are replaced.

    A bucket that holds more than `limit` bytes of text is split on one more bit of the hash, until
    it fits. Rows of one key share all its bits: where they are over the limit by themselves, their
    bucket is split on by the bits of key and text, and rows that agree in these too by the bits of
    a row number (shards "depth-prefix.depth-prefix" and so on, shard_depth all bits looked at). Only
    one text that is over the limit keeps a bucket of its own, marked oversized. NULL text has no
    bytes; a NULL key is placed by its text; an empty table gives no rows. Every row of docs is in the
    result once.
    """
    new = ["shard", "shard_depth", "shard_bytes", "shard_rows", "oversized"]
    name, said = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.lit("").alias("__at"),
                       F.lit(0).alias("__passed"), hash_bits(name, said).alias("__h"), F.coalesce(
                           F.octet_length(said), F.lit(0)).cast("long").alias("__size"))
    said = F.coalesce(F.col("__row").getField(text), F.lit(""))
    again = _bits(F.concat_ws(" ", F.lit("again"), F.col("__row").getField(key).cast("string"), F.md5(said)))
    done, end, level = [], F.col("__end"), 0
    while True:
        found = directories(rows.select("__at", "__h", "__size"), limit)
        rows = _led(rows, found)
        bucket = F.concat(F.col("__at"), end["__depth"].cast("string"), F.lit("-"), end["__prefix"].cast("string"))
        shard = rows.select("__row", bucket.alias("__at"), (F.col("__passed") + end["__depth"]).alias("__passed"),
                            "__size", "__end")
        if level == 2 or not _too_large(found):
            done.append(shard)
            break
        stays = ~end["__oversized"] | (end["__rows"] == 1)
        done.append(shard.filter(stays))
        rows = shard.filter(~stays).drop("__end").withColumn("__at", F.concat("__at", F.lit(".")))
        if level == 0:
            rows = rows.withColumn("__h", again)
        else:  # numbers that stay the same need rows that are kept
            rows = stored(rows.withColumn("__number", F.monotonically_increasing_id()), "repeated").withColumn(
                "__h", _bits(F.concat(F.lit("row "), F.col("__number").cast("string")))).drop("__number")
        level += 1
    out = reduce(DataFrame.union, done)
    return out.select(
        *[F.col("__row").getField(c).alias(c) for c in docs.columns if c not in new], F.col("__at").alias("shard"),
        F.col("__passed").alias("shard_depth"), end["__bytes"].alias("shard_bytes"),
        end["__rows"].alias("shard_rows"), end["__oversized"].alias("oversized"))


def fine_limit(docs: DataFrame, text: str = "text", shards: int = 64) -> int:
    """SHARD_BYTES, or less where that would make fewer than so many shards."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, min(SHARD_BYTES, total // shards))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard; a shard's rows are brought together first, so that it is one file."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)


SHARDS_SQL = f"""
with d as (
  select doc_id, coalesce(strlen(text), 0) as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'text ' || md5(coalesce(text, '')))), 1, 15))::bigint as h
  from documents),
l as (select greatest(1, least({SHARD_BYTES}, (select sum(size) from d) // 64)) as most),
n as (
  select k.k as depth, h >> ({HASH_BITS} - k.k) as prefix, sum(size) as bytes, count(*) as rows,
         min(h) = max(h) as single
  from d, range({HASH_BITS} + 1) k(k) group by 1, 2),
f as (
  select d.doc_id, d.size, d.h, min(n.depth) as depth
  from d, n, l where n.prefix = d.h >> ({HASH_BITS} - n.depth)
   and (n.bytes <= l.most or n.single) group by all)
select f.doc_id, cast(f.size as bigint) as doc_bytes, n.depth || '-' || n.prefix as shard,
       cast(n.depth as integer) as shard_depth, cast(n.bytes as bigint) as shard_bytes,
       n.rows as shard_rows, n.bytes > l.most as oversized
from f join n on n.depth = f.depth and n.prefix = f.h >> ({HASH_BITS} - f.depth), l
"""
