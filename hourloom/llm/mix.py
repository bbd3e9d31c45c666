"""Operator 7: mixing sources to target weights by fitting word budgets as subset sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hourloom.llm.common import settled, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix takes so many times all words, and at most so many times those of a source.
SHARE, REPEAT = 1.5, 2
SEED = 7
#: The last so many words of a budget are fitted exactly at first.
FITTED_WORDS = 1 << 15
#: If that misses the budget, up to so many words are fitted, in about so many steps times words.
WIDEST_WORDS, FITTED_BITS = 1 << 26, 1 << 37
#: Sets of reachable sums that are kept at once while a budget is fitted.
KEPT_BYTES = 64 << 20
#: Documents of one length and source are counted in hash ranges of about so many.
RANGE_ROWS = 512
#: A plan of at most so many rows (about 100 bytes each) is broadcast, a larger one is joined.
BROADCAST_ROWS = 200_000


def _keyed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The rows of docs as __row, with __null and __source (joinable without NULL), __size and the seeded __h."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(source).isNull().alias("__null"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"),
        word_count(F.col(text)).alias("__size"),
        F.xxhash64(F.lit(SEED), F.col(key), F.col(text)).alias("__h"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Position of every source in code point order, NULL last, without one task for all."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(sources.repartitionByRange(n, "__null", "__source")
                     .sortWithinPartitions("__null", "__source")
                     .withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, []
    for p, count in counts:  # one number per partition
        offsets.append((p, before))
        before += count
    if not offsets:
        return placed.withColumn("__position", F.lit(0).cast("long")).drop("__id")
    side = sources.sparkSession.createDataFrame(offsets, "__part long, __before long")
    return (placed.withColumn("__part", part).join(F.broadcast(side), "__part")
            .withColumn("__position", F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__part", "__before", "__id"))


def source_targets(keyed: DataFrame) -> DataFrame:
    """__null, __source, __source_size, __target. The share of all words is dealt out by weight; a
    source that would get more than REPEAT times its words stops there, the rest is dealt again."""
    sizes = keyed.groupBy("__null", "__source").agg(F.sum("__size").alias("__source_size"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    sources = settled(_numbered(sizes).select(
        "__null", "__source", "__source_size",
        weights[(F.col("__position") % len(WEIGHTS)).cast("int")].alias("__weight")))
    cap = F.col("__source_size") * REPEAT
    total = sources.agg(F.sum("__source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        reached = F.col("__weight") * level > cap
        done, given, open_weight = sources.agg(
            F.count_if(reached), F.sum(F.when(reached, cap)), F.sum(F.when(~reached, F.col("__weight")))).first()
        if done == full or not open_weight:
            break
        full, level = done, (SHARE * total - (given or 0)) / open_weight
    return sources.select("__null", "__source", "__source_size",
                          F.least(cap.cast("double"), F.col("__weight") * level).alias("__target"))


def _parts(open_: int) -> list[int]:
    """1, 2, 4, ... and a rest: sums of some of them give every number up to open_."""
    out, part = [], 1
    while open_ > 0:
        out.append(min(part, open_))
        open_, part = open_ - out[-1], part * 2
    return out


def _choose(lengths: list[int], counts: list[int], bound: int) -> list[int]:
    """How many of each length (ascending) come as close to `bound` from below as any do. Reachable
    sums are the bits of an integer; where that is large, only some are kept and the others made again."""
    unit = math.gcd(*[n for n, c in zip(lengths, counts) if c]) or 1  # all sums are multiples of it
    lengths, bound = [n // unit for n in lengths], bound // unit
    steps = [(i, part, part * n) for i, (n, c) in enumerate(zip(lengths, counts)) if n and c
             for part in _parts(min(c, bound // n))]
    every = 1 if len(steps) * bound // 8 <= KEPT_BYTES else math.isqrt(len(steps)) + 1
    mask, reach, saved, done = (1 << (bound + 1)) - 1, 1, [], 0
    for _, _, words in steps:
        if reach >> bound:
            break
        if done % every == 0:
            saved.append(reach)
        reach, done = reach | reach << words & mask, done + 1
    taken, at = [0] * len(lengths), reach.bit_length() - 1
    for k in reversed(range(len(saved))):
        block, befores = steps[k * every:min(done, (k + 1) * every)], [saved.pop()]
        for _, _, words in block[:-1]:
            befores.append(befores[-1] | befores[-1] << words & mask)
        for (i, part, words), before in zip(reversed(block), reversed(befores)):
            if not before >> at & 1:
                taken[i] += part
                at -= words
    return taken


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: int, shared: int, window: int) -> np.ndarray:
    """Every length gets its share of the first `shared` words. The rest is taken from the longest
    downwards until it lies in the window, and what is left there is fitted exactly."""
    words = int((lengths * counts).sum())
    taken = np.array([int(c) * shared // words for c in counts], np.int64)
    left = budget - int((taken * lengths).sum())
    order = np.argsort(lengths, kind="stable")
    for i in order[::-1]:
        length = int(lengths[i])
        if left <= window or not length:
            break
        k = min(int(counts[i] - taken[i]), max(0, left - window // 2) // length)
        taken[i] += k
        left -= k * length
    taken[order] += np.array(_choose(lengths[order].tolist(), (counts - taken)[order].tolist(), min(left, window)), np.int64)
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come to the budget or as
    close below it as whole documents can.

    Every length gets its share and the last FITTED_WORDS are fitted. If that misses the budget by
    any words, the window is widened, to all that the shares leave or as far as FITTED_BITS allow, and
    no less than two of the longest documents; then shares are given up by halves, as a share of the
    short documents can be in the way of a long one. The first that comes to the budget is taken, else
    the closest; without shares, and with the whole budget in the window, nothing is closer.
    """
    words = int((lengths * counts).sum())
    if budget <= 0 or not words:
        return np.zeros(len(lengths), np.int64)
    if budget >= words:
        return counts.copy()

    def missed(taken: np.ndarray) -> int:
        return budget - int((taken * lengths).sum())

    best, longest = _fill(lengths, counts, budget, budget, FITTED_WORDS), int(lengths[counts > 0].max())
    if not missed(best):
        return best
    steps = sum(min(int(c), budget // int(n)).bit_length() for n, c in zip(lengths, counts) if n)
    window = max(FITTED_WORDS, 2 * longest, min(WIDEST_WORDS, FITTED_BITS // max(1, steps)))
    for shared in (budget, budget // 2, 0):
        best = min(best, _fill(lengths, counts, budget, shared, window), key=missed)
        if not missed(best):
            break
    return best


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("__size").reset_index(drop=True)
    size, target = int(rows["__source_size"].iloc[0]), float(rows["__target"].iloc[0])
    whole = int(target // size) if size else 0
    rows["__whole"] = np.int64(whole)
    rows["__extra"] = fit_budget(rows["__size"].to_numpy(), rows["__count"].to_numpy(), round(target - whole * size))
    return rows


def mix_plan(keyed: DataFrame) -> DataFrame:
    """For each source and length: __source_size, __target, __whole (copies that every document
    gets) and __bound: documents whose hash is not above it get one more."""
    at = ["__null", "__source", "__size"]
    targets = source_targets(keyed)
    lengths = settled(keyed.groupBy(*at).agg(F.count("*").alias("__count"))
                      .join(targets, ["__null", "__source"]))
    schema = ("__null boolean, __source string, __size long, __count long, __source_size long, "
              "__target double, __whole long, __extra long")
    fitted = settled(lengths.groupBy("__null", "__source").applyInPandas(_fit, schema).withColumn(
        "__bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("__count") / RANGE_ROWS))).cast("int")))
    # The hash below which `__extra` documents lie: first the range it is in, then its place there.
    part = F.col("__extra").between(1, F.col("__count") - 1)
    open_rows = keyed.select(*at, "__h").join(fitted.filter(part).select(*at, "__extra", "__bits"), at)
    ranged = settled(open_rows.withColumn(
        "__range", F.when(F.col("__bits") > 0, F.expr("shiftrightunsigned(__h, 64 - __bits)")).otherwise(0)))
    up = Window.partitionBy(*at).orderBy("__range")
    there = (ranged.groupBy(*at, "__extra", "__range").agg(F.count("*").alias("__here"))
             .withColumn("__before", F.sum("__here").over(up) - F.col("__here"))
             .filter((F.col("__before") < F.col("__extra"))
                     & (F.col("__extra") <= F.col("__before") + F.col("__here")))
             .select(*at, "__range", (F.col("__extra") - F.col("__before")).alias("__need")))
    # Ties of the hash are rows that agree in key and text; those stay together, below the need.
    inside = Window.partitionBy(*at, "__range").orderBy(_unsigned("__h"))
    bounds = (ranged.join(there, [*at, "__range"])
              .withColumn("__upto", F.count("*").over(inside))
              .filter(F.col("__upto") <= F.col("__need"))
              .groupBy(*at).agg(F.max(_unsigned("__h")).alias("__bound")))
    lowest = there.select(*at, F.col("__range").alias("__from"))
    return settled(
        fitted.join(bounds, at, "left").join(lowest, at, "left")
        .select(*at, "__source_size", "__target", "__whole", F.when(
            F.col("__extra") >= F.col("__count"), F.lit(_TOP)).when(
            F.col("__extra") <= 0, F.lit(_NONE)).otherwise(F.coalesce("__bound", F.when(
                F.col("__from") > 0, F.expr("shiftleft(__from, 64 - __bits)").bitwiseXOR(F.lit(_LOW)) - 1)
                .otherwise(F.lit(_NONE)))).alias("__bound")))


_LOW = -(1 << 63)
_NONE, _TOP = _LOW, (1 << 63) - 1


def _unsigned(name: str) -> Column:
    """A bigint in the order of its bits without a sign."""
    return F.col(name).bitwiseXOR(F.lit(_LOW))


def _mixed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """__row, __size, __source_size, __target and __copies."""
    keyed = _keyed(docs, key, text, source)
    at = ["__null", "__source", "__size"]
    slim = settled(keyed.select(*at, "__h"))
    plan = mix_plan(slim)
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    picked = (_unsigned("__h") <= F.col("__bound")) & (F.col("__bound") != _NONE)
    return keyed.join(plan, at).select(
        "__row", "__size", "__source_size", "__target",
        (F.col("__whole") + F.when(picked, 1).otherwise(0)).alias("__copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs with __size, __source_size, __target and __copies, how often the mix has them;
    columns of docs with one of these names are replaced.

    NULL text has no words; NULL sources are one source, after all others; rows that agree in key
    and text are taken or left together; an empty table gives no rows. Each source is fitted to
    its target from below by whole documents; no document is taken more than REPEAT times.
    """
    new = ["__size", "__source_size", "__target", "__copies"]
    return _mixed(docs, key, text, source).select(
        *[F.col("__row").getField(c).alias(c) for c in docs.columns if c not in new], *new)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix with the columns of docs; repeated ones are repeated rows."""
    return (_mixed(docs, key, text, source).filter(F.col("__copies") > 0)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))
