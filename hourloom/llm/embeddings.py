"""Operator 6: near-duplicate embeddings by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import settled
from hourloom.llm.components import Forest, components

COSINE = 0.93
#: Coordinates of a block.
BLOCK_DIMS = 8
#: Widths of a slab in ranges of its block; vectors nearer than one range to its lower end also meet the slab before.
SLAB_RANGES = 4.0
#: Vectors of a tile; slabs with more are cut.
TILE = 2048
#: Rotated coordinates are kept as floats; so much of squared distance is added to the budget for that.
SLACK = 1e-4
#: Rows of a tile that are compared with all of the other at once.
QUERIES = 256


def _usable(vector: str):
    """A vector of finite numbers that is not zero; NULL counts as unusable."""
    v = F.col(vector)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(plain & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of extreme numbers finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(classes: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The principal axes of all unit vectors, by falling variance, and the variances. A matrix of
    dims x dims is all that tasks send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([_unit(_matrix(batch.column(0), dims)), np.ones((batch.num_rows, 1))])
                total += x.T @ x
        at = np.arange(dims + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, dims + 1)), pa.array(np.tile(at, dims + 1)),
                                          pa.array(total.reshape(-1))], ["i", "j", "s"])

    rows = (classes.select("__v").mapInArrow(run, "i long, j long, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas())
    total = np.zeros((dims + 1, dims + 1))
    total[rows["i"].to_numpy(int), rows["j"].to_numpy(int)] = rows["s"].to_numpy(float)
    mean = total[:-1, -1] / max(1.0, total[-1, -1])
    spread, axes = np.linalg.eigh(total[:-1, :-1] / max(1.0, total[-1, -1]) - np.outer(mean, mean))
    return axes[:, ::-1].copy(), np.maximum(spread[::-1], 0)


def budgets(spread: np.ndarray, distance: float) -> np.ndarray:
    """Shares of the squared distance by block, in proportion to the block's variance; a block
    without any gets a little."""
    own = np.add.reduceat(spread, np.arange(0, len(spread), BLOCK_DIMS))
    own = np.maximum(own, own.max() * 1e-3 if own.max() > 0 else 1.0)
    return distance * own / own.sum()


def _rotated(classes: DataFrame, dims: int, axes: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (_unit(_matrix(batch.column("__v"), dims)) @ axes).astype(np.float32)
            offsets = np.arange(0, y.size + 1, dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(y.reshape(-1)))],
                                             [*batch.schema.names, "__y"])

    kept = classes.select("__class", "__label", "__rows", "__v")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("__y", T.ArrayType(T.FloatType()))]))


def _compare(shares: np.ndarray, least: float, rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of tiles of one slab: for each vector the rows it is linked to here, and the
    first of its component here."""
    second = rows["__side"].to_numpy()
    rows = rows.iloc[np.argsort(second, kind="stable")]
    second, guest = rows["__side"].to_numpy(), rows["__guest"].to_numpy()
    block = int(rows["__block"].iloc[0])
    y, v = np.stack(rows["__y"].to_numpy()).astype(float), np.stack(rows["__v"].to_numpy()).astype(float)
    unit = _unit(v)
    ids, weight = rows["__class"].to_numpy(), rows["__rows"].to_numpy()
    one = not second.any()
    right = 0 if one else int(np.argmax(second))
    begins = np.arange(0, y.shape[1], BLOCK_DIMS)
    own = slice(begins[block], begins[block] + BLOCK_DIMS)
    square, links, forest = (y[:, own] ** 2).sum(axis=1), np.zeros(len(y), np.int64), Forest(len(y))
    for low in range(0, len(y) if one else right, QUERIES):
        a = np.arange(low, min(low + QUERIES, len(y) if one else right))
        b = np.arange(low if one else right, len(y))
        near = square[a][:, None] + square[b][None, :] - 2 * (y[a][:, own] @ y[b][:, own].T) <= shares[block] + 1e-9
        near &= ~(guest[a][:, None] & guest[b][None, :])
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        if one:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):  # the pigeonholes of a pair, always computed alike
            p, q = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            holes = np.add.reduceat((y[p] - y[q]) ** 2, begins, axis=1) <= shares
            p, q = p[f := holes.argmax(axis=1) == block], q[f]  # each pair belongs to its first hole
            hole = holes[f][:, block] if len(p) else np.zeros(0, bool)
            p, q = p[hole], q[hole]
            true = (unit[p] * unit[q]).sum(axis=1) >= least
            p, q = p[true], q[true]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            order = np.argsort(p, kind="stable")
            p, q = p[order], q[order]
            cuts = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, int)
            for k, others in zip(p[cuts].tolist(), np.split(q, cuts[1:]) if len(cuts) else []):
                forest.link(k, others)
    some = np.flatnonzero(links)
    return pd.DataFrame({"a": ids[some], "b": ids[forest.label[some]], "links": links[some]})


def class_links(classes: DataFrame, dims: int, least: float) -> DataFrame:
    """a, b, links: parts of how many rows the vectors of class a are linked to, and a class b that
    they are connected with. All classes have `dims` coordinates.

    With the squared distance 2 - 2 least shared out over the blocks of rotated coordinates, two
    linked vectors are within its share in one block at least. Each block is a range join: slabs of
    its first coordinate, tiles within a slab, then the distance in the block.
    """
    axes, spread = rotation(classes, dims)
    shares = budgets(spread, 2 - 2 * least + SLACK)
    rotated = _rotated(classes, dims, axes)
    wide = F.array(*[F.lit(float(math.sqrt(s))) for s in shares])
    held = rotated.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1)))) \
        .withColumn("__range", wide[F.col("__block")]) \
        .withColumn("__place", F.element_at("__y", F.col("__block") * BLOCK_DIMS + 1) / (F.col("__range") * SLAB_RANGES)) \
        .withColumn("__slab", F.floor("__place"))
    # A margin keeps rounding from parting two vectors that are a range apart.
    low = (F.col("__place") - F.col("__slab")) * SLAB_RANGES <= 1.001
    at = ["__label", "__block", "__slab"]
    slabs = F.when(low, F.array("__slab", F.col("__slab") - 1)).otherwise(F.array("__slab"))
    sent = held.select("__class", "__label", "__rows", "__v", "__y", "__block", F.posexplode(slabs).alias("__guest", "__slab")) \
        .withColumn("__guest", F.col("__guest") > 0)
    large = settled(sent.groupBy(*at).agg(F.count("*").alias("__n")).filter(F.col("__n") > TILE)
                    .select(*at, F.ceil(F.col("__n") / TILE).cast("int").alias("__tiles")))
    if large.isEmpty():
        sent = sent.withColumns({"__low": F.lit(0), "__high": F.lit(0), "__side": F.lit(False)})
    else:  # every two tiles of a large slab meet in a task of their own
        sent = (sent.join(large, at, "left").withColumn("__tiles", F.coalesce("__tiles", F.lit(1)))
                .withColumn("__tile", F.pmod(F.xxhash64("__class"), F.col("__tiles")).cast("int"))
                .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
                .withColumn("__low", F.least("__tile", "__other")).withColumn("__high", F.greatest("__tile", "__other"))
                .withColumn("__side", F.col("__tile") > F.col("__other")).drop("__tiles", "__tile", "__other"))
    return (sent.groupBy(*at, "__low", "__high")
            .applyInPandas(lambda rows: _compare(shares, least, rows), "a long, b long, links long"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    least: float = COSINE) -> DataFrame:
    """Key, n_links, component_id and kept of every row of vectors.

    Two rows of one label, not NULL, are linked if their cosine in double precision is `least` or
    more. NULL and zero vectors, such with NULL, NaN or infinite numbers, rows without a label, and
    vectors of different length link with nothing: no links, a component of their own. Equal vectors
    are compared once, as a class with its number of rows. A NULL key is never a component_id where
    the component has another.
    """
    rows = vectors.select(F.col(key).alias("__key"), F.col(label).alias("__label"), F.col(vector).alias("__v"),
                          (_usable(vector) & F.col(label).isNotNull()).alias("__ok"))
    equal = settled(rows.filter("__ok").groupBy("__label", "__v")
                    .agg(F.count("*").alias("__rows"), F.min("__key").alias("__least")))
    classes = settled(equal.withColumn("__class", F.monotonically_increasing_id()))
    sizes = [r[0] for r in classes.select(F.size("__v")).distinct().collect()]
    parts = [class_links(classes.filter(F.size("__v") == n), n, least) for n in sizes]
    found = parts[0] if parts else classes.select(F.col("__class").alias("a"), F.col("__class").alias("b"),
                                                  F.lit(0).cast("long").alias("links"))
    for part in parts[1:]:
        found = found.union(part)
    found = settled(found)
    near = found.groupBy(F.col("a").alias("__class")).agg(F.sum("links").alias("__links"))
    roots = components(found, "a", "b").withColumnRenamed("__node", "__class")
    named = settled(classes.select("__class", "__label", "__v", "__rows", "__least").join(near, "__class", "left")
                    .join(roots, "__class", "left").withColumn("__root", F.coalesce("__root", "__class")))
    least_of = settled(named.groupBy("__root").agg(F.min("__least").alias("__component")))
    named = settled(named.join(least_of, "__root").select(
        "__label", "__v", "__component", (F.col("__rows") - 1 + F.coalesce("__links", F.lit(0))).alias("__links")))
    linked = rows.filter("__ok").join(named, ["__label", "__v"]).select("__key", "__links", "__component")
    alone = rows.filter("not __ok").select("__key", F.lit(0).cast("long").alias("__links"),
                                           F.col("__key").alias("__component"))
    return linked.union(alone).select(
        F.col("__key").alias(key), F.col("__links").alias("n_links"),
        F.col("__component").alias("component_id"),
        F.coalesce(F.col("__key") == F.col("__component"), F.col("__component").isNull()).alias("kept"))
