"""Operator 9: token ids of whole documents in compressed files that decode in parallel."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import pieces, shared_folder, small_batches, stored
from hourloom.llm.rans import Coder, frequencies
from hourloom.llm.words import encoder

#: A container takes whole documents until it has so many ids.
CONTAINER_IDS = 1 << 20


def encode_texts(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """__key and __ids of every row: the ids of its whole text and the end id, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        end, pack = np.array([end_id], words.dtype).tobytes(), zstandard.ZstdCompressor(1).compress
        for batch in batches:
            for piece in pieces(batch, "__text"):
                ids = [pack(i + end) for i in words.encode(piece.column("__text"))]
                yield pa.RecordBatch.from_arrays([piece.column("__key"), pa.array(ids, pa.binary())], ["__key", "__ids"])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["__key"], T.StructField("__ids", T.BinaryType())]))


def count_ids(packed: DataFrame, dtype: str, size: int) -> np.ndarray:
    """How often each id occurs; the vocabulary bounds the rows that reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, counts = zstandard.ZstdDecompressor().decompress, np.zeros(size, np.int64)
        for batch in batches:
            for piece in pieces(batch, "__ids"):
                ids = b"".join(map(unpack, piece.column(0).to_pylist()))
                counts += np.bincount(np.frombuffer(ids, dtype), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["__id", "__n"])

    rows = (packed.select("__ids").mapInArrow(run, "__id long, __n long")
            .groupBy("__id").agg(F.sum("__n").alias("__n")).toPandas())
    counts = np.zeros(size, np.int64)
    counts[rows["__id"].to_numpy(np.int64)] = rows["__n"].to_numpy(np.int64)
    return counts


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                      key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents, in ascending order of their key, to a new folder.

    `path`/shares has the frequency table that all blocks share, `path`/ids the containers: part and
    first (ids before it in its part), n_ids, the keys and id counts of its documents, and its coded
    blocks. A document is never in two containers. NULL and empty texts are the end id alone; NULL
    keys come first; rows of one key follow each other; an empty table gives no containers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = encoder(tokenizer)
    dtype, size = words.dtype, words.tokenizer.get_vocab_size() + 1
    packed = stored(encode_texts(docs, key, text, tokenizer, end_id), "ids")
    shares = frequencies(count_ids(packed, dtype, max(size, end_id + 1)))
    table = spark.createDataFrame([(json.dumps({"dtype": dtype, "shares": shares.tolist()}),)], "table string")
    table.coalesce(1).write.parquet(f"{path}/shares")
    shared = spark.sparkContext.broadcast(shares)  # bounded by the vocabulary
    kind = packed.schema["__key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, unpack = Coder(shared.value), zstandard.ZstdDecompressor().decompress
        part, first, held, keys, counts = TaskContext.get().partitionId(), 0, [], [], []

        def container() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype)
            row = {"part": [part], "first": [first], "n_ids": [len(ids)],
                   "keys": [pa.concat_arrays(keys)], "counts": [counts], "blocks": [coder.encode(ids)]}
            return pa.RecordBatch.from_arrays(
                [pa.array(row["part"]), pa.array(row["first"]), pa.array(row["n_ids"]),
                 pa.ListArray.from_arrays([0, len(counts)], row["keys"][0]),
                 pa.array(row["counts"], pa.list_(pa.int64())), pa.array(row["blocks"], pa.list_(pa.binary()))],
                names=list(row))

        total = 0
        for batch in batches:
            ids, start = batch.column("__ids"), 0
            for i in range(batch.num_rows):
                held.append(unpack(ids[i].as_py()))
                counts.append(len(held[-1]) // np.dtype(dtype).itemsize)
                total += counts[-1]
                if total >= CONTAINER_IDS:
                    keys.append(batch.column("__key").slice(start, i + 1 - start))
                    yield container()
                    first, start = first + total, i + 1
                    held, keys, counts, total = [], [], [], 0
            if start < batch.num_rows:
                keys.append(batch.column("__key").slice(start))
        if counts:
            yield container()

    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("keys", T.ArrayType(kind)), T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("blocks", T.ArrayType(T.BinaryType()))])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("__ids").alias("__tie")  # rows of one key may go to several parts
    (packed.select("__key", "__ids", tie).repartitionByRange(parts, "__key", "__tie")
     .sortWithinPartitions("__key", "__tie").drop("__tie")
     .mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/ids"))


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row per document of a folder: its key, start (ids of all documents before it),
    n_tokens and ids (bytes of little-endian unsigned 32-bit integers), or with `digest` their
    unsigned CRC-32 as ids_crc32. Containers are decoded wherever Spark puts them; block checksums
    are verified."""
    row = spark.read.parquet(f"{path}/shares").first()
    shares = np.array(json.loads(row["table"])["shares"])
    shared = spark.sparkContext.broadcast(shares)
    files = spark.read.parquet(f"{path}/ids")
    before, starts = 0, []
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_ids")).collect()):  # a number per part
        starts.append((part, before))
        before += n
    kind = files.schema["keys"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.array(batch.column("counts")[i].as_py(), np.int64)
                data = coder.decode(batch.column("blocks")[i].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                begin = ends - counts
                base = batch.column("start")[i].as_py()
                keys = batch.column("keys")[i].values
                for low in range(0, len(counts), 4096):
                    part = slice(low, low + 4096)
                    own = [data[4 * a:4 * b] for a, b in zip(begin[part].tolist(), ends[part].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [keys[part], pa.array(begin[part] + base), pa.array(counts[part]),
                         pa.array([zlib.crc32(o) for o in own], pa.int64()) if digest else pa.array(own, pa.binary())],
                        [f.name for f in schema])

    schema = T.StructType([T.StructField("key", kind), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.BinaryType())])
    placed = spark.createDataFrame(starts, "part long, before long")
    return (files.join(F.broadcast(placed), "part")
            .select("keys", "counts", "blocks", (F.col("before") + F.col("first")).alias("start"))
            .mapInArrow(run, schema).withColumnRenamed("key", key))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
