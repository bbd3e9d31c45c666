"""Ridge regression from sums of products, for many series and all folds at once.

One grouped aggregation gives every group the sums of its features and of their products. Sums of
folds are added up to the training set of each fold, so all fits of a cross-validation cost one scan
(after one for the means); and each group's equations are solved by Cholesky steps written as array expressions, so thousands
of series are fitted side by side without a Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RidgeSettings, ScaleSettings
from ..operators.scale import attach, settle


def product_sums(df: DataFrame, columns: Sequence[str], keys: Sequence[str], stage: str | None = None,
                 scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """Of each series (and stage): ``__n``, ``__centre``, and the vectors ``__sums`` (each column, then
    the products of column i with columns i, i + 1, ...), ``__low`` and ``__high``.

    All values are taken from the series' mean, its centre, so that products are small and
    subtracting means later loses nothing. Rows with a missing value are left out.
    """
    rows = df.dropna(subset=list(columns)).select(*keys, *([stage] if stage else []), *dict.fromkeys(columns))
    one = list(keys) or ["__one"]
    if not keys:
        rows = rows.withColumn("__one", F.lit(1))
    middle = settle(rows.groupBy(*one).agg(F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("__centre")))
    rows = attach(rows, middle, one, scale, "inner")
    x = F.array(*[F.col(c).cast("double") - F.col("__centre")[i] for i, c in enumerate(columns)])
    products = F.expr("flatten(transform(__x, (a, i) -> transform(slice(__x, i + 1, size(__x)), b -> a * b)))")
    by = [*keys, *([stage] if stage else [])]
    vectors = rows.select(*by, "__centre", x.alias("__x")).select(
        *by, "__centre", array_to_vector("__x").alias("__x"), array_to_vector(F.concat("__x", products)).alias("__v"))
    return vectors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), Summarizer.sum(F.col("__v")).alias("__sums"), F.first("__centre").alias("__centre"),
        Summarizer.min(F.col("__x")).alias("__low"), Summarizer.max(F.col("__x")).alias("__high"))


def before_folds(sums: DataFrame, by: Sequence[str], n_splits: int, stage: str = "test_fold") -> DataFrame:
    """Sums of the training rows of every ``fold``: those of all stages before it, added up."""
    rows = sums.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits)))).where(F.col(stage) < F.col("fold"))
    return rows.groupBy(*by, "fold").agg(
        F.sum("__n").alias("__n"), Summarizer.sum(F.col("__sums")).alias("__sums"), F.first("__centre").alias("__centre"),
        Summarizer.min(F.col("__low")).alias("__low"), Summarizer.max(F.col("__high")).alias("__high"))


def cholesky_weights(matrix: str, p: int) -> Column:
    """Solution w of A w = b. ``matrix`` names a flat array of p + 1 rows and columns: A, and b as the
    last row. Each step takes one column out of what is right of and below it; the last row becomes
    the forward solution by itself, and backward steps give w."""
    q = p + 1
    i, j, d = f"(t div {q})", f"(t % {q})", f"get(m, k * {q + 1})"
    steps = f"""aggregate(sequence(0, {p - 1}), {matrix}, (m, k) -> transform(m, (v, t) -> case
        when {j} < k or {i} < {j} then v
        when {j} = k then if({i} = k, sqrt({d}), v / sqrt({d}))
        else v - get(m, {i} * {q} + k) * get(m, {j} * {q} + k) / {d} end))"""
    back = f"""transform(array({steps}), m -> aggregate(sequence({p - 1}, 0, -1), array_repeat(0D, {p}),
        (w, k) -> transform(w, (v, i) -> if(i = k, (get(m, {p * q} + k) - aggregate(sequence(0, {p - 1}), 0D,
            (s, r) -> s + get(m, r * {q} + k) * get(w, r))) / {d}, v))))[0]"""
    return F.expr(back)


def solve_ridge(sums: DataFrame, p: int, by: Sequence[str],
                settings: RidgeSettings = RidgeSettings()) -> DataFrame:
    """``weights`` (array, in the order of the p features), ``intercept`` and ``n`` of every group.

    The last of the columns summed is the target. Features are standardised, the intercept is free
    of penalty; a feature that is constant in a group has weight zero there.
    """
    q = p + 1
    at = lambda i, j: f"__s[{q} + {i} * {q} - {i} * ({i} - 1) div 2 + {j} - {i}]"
    rows = sums.select(*by, "__centre", F.col("__n").cast("double").alias("__n"), *[
        vector_to_array(F.col(c)).alias(c.replace("sums", "s")) for c in ("__sums", "__low", "__high")])
    # Products of deviations from the group's own means.
    rows = rows.withColumn("__dev", F.expr(f"""transform(sequence(0, {q * q - 1}), t -> transform(
        array(named_struct('a', least(t div {q}, t % {q}), 'b', greatest(t div {q}, t % {q}))),
        x -> {at('x.a', 'x.b')} - __s[x.a] * __s[x.b] / __n)[0])"""))
    rows = rows.withColumn("__sd", F.expr(f"""transform(sequence(0, {p - 1}), i ->
        if(__low[i] < __high[i] and __dev[i * {q + 1}] > 0, sqrt(__dev[i * {q + 1}] / __n), 0D))"""))
    i, j = f"(t div {q})", f"(t % {q})"
    scaled = f"""transform(sequence(0, {q * q - 1}), t -> case
        when {i} = {p} and {j} = {p} then __dev[t]
        when {i} = {p} or {j} = {p} then coalesce(try_divide(__dev[t], __sd[least({i}, {j})]), 0D)
        else coalesce(try_divide(__dev[t], __sd[{i}] * __sd[{j}]), 0D)
             + if({i} = {j}, if(__sd[{i}] = 0, 1D, {float(settings.alpha)}D), 0D) end)"""
    rows = rows.withColumn("__m", F.expr(scaled)).withColumn("__w", cholesky_weights("__m", p))
    rows = rows.withColumn("weights", F.expr("zip_with(__w, __sd, (w, s) -> coalesce(try_divide(w, s), 0D))"))
    pull = F.expr("aggregate(zip_with(weights, slice(__means, 1, size(weights)), (w, m) -> w * m), 0D, (a, b) -> a + b)")
    return rows.withColumn("__means", F.zip_with(F.slice("__s", 1, q), F.col("__centre"), lambda s, c: s / F.col("__n") + c)).select(
        *by, F.col("__n").cast("bigint").alias("n"), "weights", (F.col("__means")[p] - pull).alias("intercept"))


def series_ridge(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str,
                 settings: RidgeSettings = RidgeSettings()) -> DataFrame:
    """One ridge model per series: keys, ``n``, ``weights`` and ``intercept``."""
    return solve_ridge(product_sums(df, [*features, target], keys), len(features), keys, settings)


def fold_ridge(folded: DataFrame, features: Sequence[str], target: str, n_splits: int = 5,
               keys: Sequence[str] = (), settings: RidgeSettings = RidgeSettings()) -> DataFrame:
    """The ridge model of every ``fold`` (and series, with ``keys``) from one pass over the rows."""
    sums = product_sums(folded, [*features, target], keys, "test_fold")
    return solve_ridge(before_folds(sums, keys, n_splits), len(features), [*keys, "fold"], settings)


def with_prediction(df: DataFrame, models: DataFrame, on: Sequence[str], features: Sequence[str],
                    name: str = "prediction", scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """Adds the prediction of each row's model; rows without a model have none."""
    table = settle(models.select(*on, "weights", "intercept"))
    dot = reduce(add, [F.col("weights")[i] * F.col(f) for i, f in enumerate(features)])
    return attach(df, table, on, scale).withColumn(name, F.col("intercept") + dot).drop("weights", "intercept")
