"""Operator 11: ranked lexical search by bundles that pass the owners of terms one after another."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.config import ScaleSettings
from hourloom.llm.common import pieces, small_batches, stored
from hourloom.llm.decontaminate import split_words
from hourloom.operators.scale import attach

#: Documents an item gets.
TOP = 20
#: Documents of a block, and words looked for in it, about.
BLOCK_DOCS, BLOCK_WORDS = 8192, 1 << 22
#: A long text is cut into words in slices of so many bytes.
SLICE_BYTES = 1 << 20
#: Terms looked for that each task of the index may know; more are told apart by a join.
KNOWN_BYTES = 32 << 20
#: Items of a bundle, about, and pairs of item and term.
BUNDLE_ITEMS, BUNDLE_TERMS = 256, 16_384
#: The owners are visited from the rarest terms on; after each, this share of all postings is done.
OWNERS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)
# The scale of a contribution, and how it falls with a document's length.
UNIT, SATURATION, LENGTH_PERCENT = 1_000_000_000, 12, 25


def _words(text: str | None) -> Iterator[list[bytes]]:
    raw = (text or "").encode()
    if len(raw) <= SLICE_BYTES:
        yield split_words(text)
        return
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE_BYTES)
        end = len(raw) if end < 0 else end
        yield split_words(raw[at:end].decode())
        at = end


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """__item, __term and __times of the terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                rows = [(i, w.decode()) for i, t in zip(*(c.to_pylist() for c in piece.columns))
                        for words in _words(t) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())],
                    ["__item", "__term"])

    said = items.select("__item", F.col(text).alias("__text")).mapInArrow(run, "__item long, __term string")
    return said.groupBy("__item", "__term").agg(F.count("*").alias("__times"))


def index(docs: DataFrame, key: str, text: str, known: set[bytes] | None) -> DataFrame:
    """The documents in blocks: for each term in a block a row with the places of its documents and
    its times in each; and a row without term with the keys and lengths of the block's documents.

    Documents without terms are left out. `known` are the terms to list; None: all.
    """
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number = {w: i for i, w in enumerate(sorted(known))} if known is not None else {}
        names = sorted(known) if known is not None else []
        block, keys, lengths, where, what, arrow = 0, [], [], array("I"), array("I"), None

        def done() -> pa.RecordBatch:
            code = np.frombuffer(what, np.uint32).astype(np.int64) * BLOCK_DOCS + np.frombuffer(where, np.uint32)
            code, times = np.unique(code, return_counts=True)
            term, place = np.divmod(code, BLOCK_DOCS)
            cuts = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1]))[:len(term)], len(term))
            out: list[list] = [[] for _ in range(7)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = times[a:b]
                for column, value in zip(out, (names[term[a]].decode(), place[a:b].astype("<u2").tobytes(),
                                               own.astype("<u4").tobytes(), b - a, int(own.max()), None, None)):
                    column.append(value)
            for column, value in zip(out, (None, None, np.array(lengths, "<u4").tobytes(), len(keys), 0, sum(lengths), keys)):
                column.append(value)
            types = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(arrow))
            return pa.RecordBatch.from_arrays(
                [pa.array([first + block] * len(out[0]), pa.int64()), *(pa.array(c, t) for c, t in zip(out, types))],
                ["__block", "__term", "__places", "__times", "__docs", "__most", "__words", "__keys"])

        for batch in batches:
            arrow = arrow or batch.schema.field("__key").type
            for piece in pieces(batch, "__text"):
                for name, body in zip(*(c.to_pylist() for c in piece.columns)):
                    at, n = len(what), 0
                    for words in _words(body):
                        n += len(words)
                        if known is None:
                            for w in words:
                                if w not in number:
                                    number[w] = len(names)
                                    names.append(w)
                            what.extend(map(number.__getitem__, words))
                        else:
                            what.extend([i for i in map(number.get, words) if i is not None])
                    if not n:
                        continue
                    where.extend([len(keys)] * (len(what) - at))
                    keys.append(name)
                    lengths.append(n)
                    if len(keys) == BLOCK_DOCS or len(what) >= BLOCK_WORDS:
                        yield done()
                        block, keys, lengths, where, what = block + 1, [], [], array("I"), array("I")
                        if known is None:
                            number, names = {}, []
        if keys:
            yield done()

    schema = T.StructType().add("__block", "long").add("__term", "string").add("__places", "binary").add(
        "__times", "binary").add("__docs", "long").add("__most", "long").add("__words", "long").add(
        "__keys", T.ArrayType(kind))
    return rows.mapInArrow(run, schema)


_BUNDLE = "__group int, __block long, __item long, __places binary, __scores binary, __best array<long>"
_BUNDLE_ARROW = pa.schema([("__group", pa.int32()), ("__block", pa.int64()), ("__item", pa.int64()),
                           ("__places", pa.binary()), ("__scores", pa.binary()), ("__best", pa.list_(pa.int64()))])


def _owner(n_docs: int, n_words: int):
    """What an owner does with the bundle of a block: adds what its terms give to the accumulators."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        group, block = (k.as_py() for k in key)
        blank = right.column("__term").is_null()
        lengths = np.frombuffer(right.filter(blank).column("__times")[0].as_py(), "<u4")
        wide = 25 * int(lengths.max()) * n_docs >= 1 << 62
        spread = (LENGTH_PERCENT * lengths.astype(object if wide else np.int64) * n_docs) // n_words
        m = 100 - LENGTH_PERCENT + spread.astype(np.int64)
        sums, bounds = {}, {}
        carried = {r["__item"]: r for r in left.to_pylist()}

        def accumulator(item: int) -> np.ndarray:
            if item not in sums:
                sums[item] = np.zeros(len(m), np.int64)
                if item in carried:
                    row = carried[item]
                    sums[item][np.frombuffer(row["__places"], "<u2")] = np.frombuffer(row["__scores"], "<i8")
            return sums[item]

        posts = right.filter(right.column("__term").is_valid())
        for places, times, weight, asks in zip(*(posts.column(c) for c in ("__places", "__times", "__weight", "__asks"))):
            places = np.frombuffer(places.as_py(), "<u2")
            tf = np.frombuffer(times.as_py(), "<u4").astype(np.int64)
            gives = weight.as_py() * ((UNIT * tf) // (1000 * tf + SATURATION * m[places]))
            for ask in asks.as_py():
                accumulator(ask["item"])[places] += ask["times"] * gives
                bounds[ask["item"]] = ask["floor"], ask["rest"]
        out: list[list] = [[], [], [], []]
        for item in carried.keys() | sums.keys():
            if item in sums:
                score, (floor, rest) = sums[item], bounds[item]
                places = np.flatnonzero(score)
                best = np.sort(np.partition(score[places], -TOP)[-TOP:] if len(places) > TOP else score[places])[::-1]
                if len(best) == TOP:
                    floor = max(floor, int(best[-1]))
                places = places[score[places] + rest >= floor]  # the others can't come among the first any more
                row = item, places.astype("<u2").tobytes(), score[places].tobytes(), best.tolist()
            else:
                row = item, *(carried[item][c] for c in ("__places", "__scores", "__best"))
            for column, value in zip(out, row):
                column.append(value)
        columns = [[group] * len(out[0]), [block] * len(out[0]), *out]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BUNDLE_ARROW)], schema=_BUNDLE_ARROW)

    return run


def _choose(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The best documents of a block for each item: by score, then key, NULL first."""
    keys = right.column("__keys")[0].values if right.num_rows else None
    items, chosen, scores = [], [], []
    for row in left.to_pylist():
        places, score = np.frombuffer(row["__places"], "<u2"), np.frombuffer(row["__scores"], "<i8")
        if len(places) > TOP:
            sure = score >= np.partition(score, -TOP)[-TOP]
            places, score = places[sure], score[sure]
        named = pa.table([pa.array(-score), keys.take(pa.array(places.astype(np.int32)))], ["s", "k"])
        order = pa.compute.sort_indices(named, [("s", "ascending"), ("k", "ascending")], null_placement="at_start")[:TOP]
        items += [row["__item"]] * len(order)
        chosen.append(named.column("k").take(order))
        scores.append(score[np.asarray(order)])
    kind = keys.type if keys is not None else pa.int64()
    flat = [c for column in chosen for c in column.chunks]
    return pa.table([pa.array(items, pa.int64()), pa.chunked_array(flat, kind),
                     pa.array(np.concatenate(scores) if scores else [], pa.int64())], ["__item", "__key", "__score"])


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """The TOP documents of every item: item, rank (from 1), key and score, scores above 0 only.

    Terms belong to owners, the rarest to the first. The items travel in bundles, one for each block
    of documents, from owner to owner: a cogroup of bundles and the owner's postings adds whole-number
    contributions to sparse accumulators, so the order of the sum doesn't matter. Between two owners
    each item's floor is known, the TOP-th best sum so far of all blocks; an accumulator that can't
    reach it with all that the later owners could give at most is left behind, which changes no result.

    NULL texts have no terms. Every row is a document or item of its own, also with a repeated or
    NULL key; equal scores are in order of key, NULL first. Items without hits have no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scale = ScaleSettings()
    asked = stored(items.select(F.col(item).alias("__name"), F.col(item_text).alias("__said")).withColumn(
        "__item", F.monotonically_increasing_id()), "items")
    terms = stored(item_terms(asked, "__said"), "terms")
    looked_for = terms.select("__term").distinct()
    size, pairs, n_items = (x or 0 for x in (
        looked_for.agg(F.sum(F.octet_length("__term") + 80)).first()[0], *terms.agg(
            F.count("*"), F.count_distinct("__item")).first()))
    known = {r[0].encode() for r in looked_for.collect()} if size <= KNOWN_BYTES else None
    found = index(docs, key, text, known)
    if known is None:
        found = found.join(looked_for.withColumn("__wanted", F.lit(True)), "__term", "left").filter(
            "__term is null or __wanted").drop("__wanted")
    found = stored(found, "index")
    posts, blocks = found.filter("__term is not null"), found.filter("__term is null")
    n_docs, n_words = (x or 0 for x in blocks.agg(F.sum("__docs"), F.sum("__words")).first())
    schema = T.StructType([T.StructField("__item", T.LongType()),
                           T.StructField("__key", docs.schema[key].dataType), T.StructField("__score", T.LongType())])
    if not n_docs or not pairs:
        best = spark.createDataFrame([], schema)
    else:
        best = _travel(posts, blocks, terms, n_docs, n_words, pairs, n_items, schema, scale)
    by = Window.partitionBy("__item").orderBy(F.desc("__score"), F.asc_nulls_first("__key"))
    ranked = best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP)
    return attach(ranked, asked.select("__item", "__name"), ["__item"], scale, "inner").select(
        F.col("__name").alias(item), "rank", F.col("__key").alias(key), F.col("__score").alias("score"))


def _travel(posts: DataFrame, blocks: DataFrame, terms: DataFrame, n_docs: int, n_words: int, pairs: int,
            n_items: int, schema: T.StructType, scale: ScaleSettings) -> DataFrame:
    """Every block's best documents for every item."""
    spark = posts.sparkSession
    counted = posts.groupBy("__term").agg(F.sum("__docs").alias("__df"), F.max("__most").alias("__most"))
    tf = F.col("__most")
    weighed = counted.withColumn("__weight", F.floor(
        1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("__df") + 1))).cast("long")).withColumn(
        "__cap", F.col("__weight") * F.expr(f"({UNIT} * __most) div (1000 * __most + {SATURATION * (100 - LENGTH_PERCENT)})"))
    weighed = stored(weighed, "weights")
    # At most 1000 ln(2 n_docs + 2) / 100 rows.
    loads = sorted(((r[0], r[1]) for r in weighed.groupBy(F.floor(F.col("__weight") / 100)).agg(F.sum("__df")).collect()),
                   reverse=True)
    whole, passed, cuts = sum(n for _, n in loads), 0, []
    for step, n in loads:
        passed += n
        if len(cuts) < len(OWNERS) - 1 and passed >= OWNERS[len(cuts)] * whole:
            while len(cuts) < len(OWNERS) - 1 and passed >= OWNERS[len(cuts)] * whole:
                cuts.append(step * 100)
    cuts = sorted(set(cuts), reverse=True)
    owner = sum((F.when(F.col("__weight") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    groups = max(-(-pairs // BUNDLE_TERMS), -(-n_items // BUNDLE_ITEMS))
    after = Window.partitionBy("__item").orderBy(F.desc("__owner")).rangeBetween(Window.unboundedPreceding, -1)
    demand = stored(attach(terms, weighed, ["__term"], scale, "inner").withColumns({
        "__owner": owner, "__group": F.pmod(F.hash("__item"), F.lit(groups))}).withColumn(
        "__rest", F.coalesce(F.sum(F.col("__times") * F.col("__cap")).over(after), F.lit(0)).cast("long")), "demand")
    lengths = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__group"), "__block", "__times")
    bundles, floors = spark.createDataFrame([], _BUNDLE), None
    for number in range(len(cuts) + 1):
        own = demand.filter(F.col("__owner") == number)
        own = own.withColumn("__floor", F.lit(0).cast("long")) if floors is None else attach(own, floors, ["__item"], scale)
        asks = stored(own.groupBy("__term", "__group", "__weight").agg(F.collect_list(F.struct(
            F.col("__item").alias("item"), F.col("__times").alias("times"),
            F.coalesce("__floor", F.lit(0)).alias("floor"), F.col("__rest").alias("rest"))).alias("__asks")), "asks")
        right = attach(posts.select("__block", "__term", "__places", "__times"), asks, ["__term"], scale, "inner")
        right = right.unionByName(lengths, allowMissingColumns=True)
        bundles = stored(bundles.groupBy("__group", "__block").cogroup(right.groupBy("__group", "__block")).applyInArrow(
            _owner(n_docs, n_words), _BUNDLE), "bundles")
        rank = F.row_number().over(Window.partitionBy("__item").orderBy(F.desc("__sum")))
        floors = stored(bundles.select("__item", F.explode("__best").alias("__sum")).withColumn("__n", rank).filter(
            F.col("__n") == TOP).select("__item", F.col("__sum").alias("__floor")), "floors")
    return bundles.groupBy("__block").cogroup(blocks.select("__block", "__keys").groupBy("__block")).applyInArrow(
        _choose, schema)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = f"""
with words as (select doc_id, unnest({_TERMS}) w from documents),
asked as (select item_id, w, count(*) q from (select item_id, unnest({_TERMS}) w from benchmark) group by all),
tf as (select doc_id, w, count(*) tf from words group by all),
sizes as (select doc_id, sum(tf)::bigint n from tf group by all),
total as (select count(*) n, sum(n)::bigint l from sizes),
weights as (select w, floor(1000 * ln((2.0::double * t.n + 2) / (2 * count(*) + 1)))::bigint weight
            from tf, total t group by w, t.n),
scored as (
  select a.item_id, f.doc_id, sum(a.q * g.weight * ((1000000000 * f.tf)
    // (1000 * f.tf + 12 * (100 - 25 + ((25 * s.n * t.n) // t.l)))))::bigint score
  from asked a join tf f using (w) join weights g using (w) join sizes s using (doc_id), total t
  group by a.item_id, f.doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) r from scored where score > 0)
select item_id, r::int as rank, doc_id, score from ranked where r <= {TOP}
"""
