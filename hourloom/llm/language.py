"""Operator 1: languages by Bayesian fusion of text, declaration, address and host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import pieces, settled, small_batches

#: Labelled texts that the likelihoods of a language are fitted on, about. Languages with fewer than
#: LEAST_ROWS are not told apart by text; all of them together are one class.
SAMPLE_ROWS, LEAST_ROWS = 1000, 5
#: Classes whose likelihoods are broadcast at once (256 KB each); more are applied block by block.
BLOCK = 128
#: Share of the declared languages that texts must bear out before a declaration alone is believed.
TRUSTED = 0.8
#: Byte trigrams are counted in so many classes; a share of each distribution is even over them.
CLASSES, EVEN = 1 << 16, 0.2
#: A text's trigrams depend on each other: it counts as at most so many.
EFFECTIVE = 200
#: Rows' worth that a group's distribution of languages is drawn towards that of the group above it.
DRAWN = 10.0
#: Chance of no known language beforehand, and chance from which a language is accepted.
UNKNOWN, ACCEPTED = 0.01, 0.5
#: A lookup of at most so many rows (about 200 bytes each) is broadcast, a larger one is joined.
BROADCAST_ROWS = 100_000

_SUBTAG = r"^\s*([a-z]{2,3})(?![a-z])"
_HIDING = re.compile(r"<(script|style|head)\b", re.IGNORECASE)
_HIDDEN_ENDS = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "head")}


@dataclass
class Model:
    """Languages, and for each class of trigrams their log chances against an even distribution.

    The last row, no known language, is that distribution and so zero. If there are labels too rare
    to be told apart, the row before is what their texts have in common: `rare` lists those labels.
    """

    names: list[str]
    table: np.ndarray
    rare: list[str] = field(default_factory=list)

    @property
    def results(self) -> list[str | None]:
        """The language that each row stands for."""
        return [*self.names, *[None] * (len(self.table) - len(self.names))]


def language_tag(label: Column) -> Column:
    """The primary subtag of a language label (en of en-US), lower-cased; NULL if it has none."""
    tag = F.regexp_extract(F.lower(label), _SUBTAG, 1)
    return F.when(tag != "", tag)


def visible(source: str) -> str:
    """A page without tags, comments, scripts, styles and head; a space for each. In one pass: an end
    that is missing once is not looked for again."""
    out, at, missing = [], 0, set()

    def end_of(kind: str, start: int) -> int:
        if kind in missing:
            return -1
        if kind in _HIDDEN_ENDS:
            found = _HIDDEN_ENDS[kind].search(source, start)
            end = found.end() if found else -1
        else:
            end = source.find(kind, start) + len(kind)
            end = -1 if end < len(kind) else end
        if end < 0:
            missing.add(kind)
        return end

    while (start := source.find("<", at)) >= 0:
        end, hiding = -1, _HIDING.match(source, start)
        if hiding:
            end = end_of(hiding[1].lower(), hiding.end())
        elif source.startswith("<!--", start):
            end = end_of("-->", start + 4)
        if end < 0 and (end := end_of(">", start)) < 0:
            break
        out += (source[at:start], " ")
        at = end
    return "".join([*out, source[at:]])


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all byte trigrams of the lower-cased texts, and how many each text has."""
    parts = [(t or "").lower().encode() for t in texts]
    sizes = np.array([max(0, len(p) - 2) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), sizes
    grams = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    inside = np.ones(len(data), bool)  # no trigram starts at the last two bytes of a text
    inside[ends[lengths > 0] - 1] = inside[ends[lengths > 1] - 2] = False
    return grams[inside[:-2]].astype(np.int64), sizes


def train(labelled: DataFrame, text: str, label: str, key: str) -> Model:
    """Fitted on a bounded sample: of each language the rows whose hash is in a range that holds
    about SAMPLE_ROWS. Labels count by their primary subtag, of which there are 18,252 at most."""
    named = labelled.select(language_tag(F.col(label)).alias("__l"), F.col(text).alias("__t"),
                            F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("__h")).filter("__l is not null and __t != ''")
    counts = {r["__l"]: r["count"] for r in named.groupBy("__l").count().collect()}
    names = sorted(n for n, c in counts.items() if c >= LEAST_ROWS)
    rare = sorted(set(counts) - set(names))
    if not names:
        return Model([], np.zeros((1, CLASSES), np.float32))
    rows = len(names) + bool(rare)
    drawn = [(n, min(1.0, SAMPLE_ROWS / counts[n]), k) for k, n in enumerate(names)]
    drawn += [(n, min(1.0, SAMPLE_ROWS / sum(counts[r] for r in rare)), len(names)) for n in rare]
    shares = named.sparkSession.createDataFrame(drawn, "__l string, __s double, __k int")
    taken = named.join(F.broadcast(shares), "__l").filter(F.col("__h") / float(1 << 64) + 0.5 <= F.col("__s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__t", 1 << 20):
                grams, sizes = trigrams(piece.column("__t").to_pylist())
                language = np.repeat(piece.column("__k").to_numpy().astype(np.int64), sizes)
                found, n = np.unique(language * CLASSES + grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found // CLASSES), pa.array(found % CLASSES), pa.array(n)], ["k", "gram", "n"])

    counted = np.zeros((rows, CLASSES), np.float32)
    found = (taken.select("__k", "__t").mapInArrow(run, "k long, gram long, n long")
             .groupBy("k", "gram").agg(F.sum("n").alias("n")).toPandas())  # classes of languages x trigrams at most
    counted[found["k"].to_numpy(int), found["gram"].to_numpy(int)] = found["n"].to_numpy(float)
    chance = (1 - EVEN) * counted / np.maximum(counted.sum(axis=1, keepdims=True), 1) + EVEN / CLASSES
    return Model(names, np.vstack([np.log(chance * CLASSES), np.zeros((1, CLASSES))]).astype(np.float32), rare)


def text_evidence(model: Model, texts: list[str | None]) -> np.ndarray:
    """Log likelihoods of the texts, a column for each row of the model."""
    return _likelihoods(model.table, texts)


def _likelihoods(table: np.ndarray, texts: list[str | None]) -> np.ndarray:
    grams, sizes = trigrams(texts)
    out = np.zeros((len(texts), len(table)))
    some = np.flatnonzero(sizes)
    if len(some):
        begins = (np.cumsum(sizes) - sizes)[some]
        for k, row in enumerate(table):
            out[some, k] = np.add.reduceat(row[grams], begins, dtype=np.float64)
        out *= np.minimum(1.0, EFFECTIVE / np.maximum(sizes, 1))[:, None]
    return out


def _with_evidence(rows: DataFrame, model: Model, markup: bool) -> DataFrame:
    """__row, __host, __domain, __suffix, __declared and __text as __evidence.

    Likelihoods of at most BLOCK classes are broadcast at once; with more, the rows are kept
    between the blocks."""
    kept = ["__row", "__host", "__domain", "__suffix", "__declared"]
    blocks = [model.table[k:k + BLOCK] for k in range(0, len(model.table), BLOCK)]
    for k, block in enumerate(blocks):
        rows = _one_block(rows, rows.sparkSession.sparkContext.broadcast(block), markup,
                          [*kept, *(["__text"] if k + 1 < len(blocks) else [])], k > 0)
        if k + 1 < len(blocks):
            rows = settled(rows)
    return rows


def _one_block(rows: DataFrame, block, markup: bool, kept: list[str], more: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text", 1 << 20):
                texts = piece.column("__text").to_pylist()
                if markup:
                    texts = [visible(t) if t else t for t in texts]
                found = _likelihoods(block.value, texts)
                if more:
                    found = np.hstack([np.array(piece.column("__evidence").to_pylist()).reshape(len(texts), -1), found])
                offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept), pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))],
                    [*kept, "__evidence"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("__evidence", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Of each value of a column, how much of its rows each language has by text alone."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(_summed(n).alias("__c"))


def _summed(n: int) -> Column:
    """Sums of the elements of __p, as columns while those are few."""
    if n <= BLOCK:
        return F.array(*[F.sum(F.col("__p")[k]) for k in range(n)])
    return vector_to_array(Summarizer.sum(array_to_vector("__p")))


def _drawn(counts: str, towards: Column) -> Column:
    """Counts smoothed to a distribution: DRAWN rows of another one are added."""
    total = F.aggregate(F.col(counts), F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(F.col(counts), towards, lambda c, p: (c + DRAWN * p) / (total + DRAWN))


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    table = settled(table)
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, key, "left")


def fuse(rows: DataFrame, model: Model, columns: list[str], text: str, declared: Column, host: Column,
         domain: Column, suffix: Column, markup: bool = False, slim: bool = True) -> DataFrame:
    """The given columns of every row, __language (NULL for none), __chance and __accepted.

    The chance of a language is in proportion to its share at the host (drawn to that of the
    domain, which is drawn to that of all rows), to its share at the address suffix against that of
    all rows, to how often the declared language goes with it, and to the text's likelihood. Shares
    are sums of what the texts alone say, by grouped aggregation over all rows. Evidence that is NULL
    says nothing; a NULL or empty text leaves the rest to decide, so it is accepted where that is
    sure enough. A row is accepted if its best language has at least ACCEPTED; of equal chances the
    first language by name is taken, none last.

    A text that is most like those with rare labels, or like no known language, has the language it
    declares if that is one of the rare labels and declarations are borne out elsewhere (TRUSTED),
    else none. `slim`: the columns are few, so evidence is kept, not computed twice. An empty table
    gives no rows; without a known language nothing is accepted.
    """
    small_batches(rows.sparkSession)
    names, n = model.results, len(model.table)
    known_n, none_n = len(model.names), n - len(model.names)
    base = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), host.alias("__host"),
                       domain.alias("__domain"), suffix.alias("__suffix"), language_tag(declared).alias("__declared"),
                       F.col(text).alias("__text"))
    known = _with_evidence(base, model, markup)
    if slim:
        known = settled(known)
    first = F.array(*[F.lit(float(np.log(p))) for p in [(1 - UNKNOWN) / max(1, known_n)] * known_n + [UNKNOWN / none_n] * none_n])
    alone = known.select("__host", "__domain", "__suffix", "__declared",
                         _softmax(F.zip_with("__evidence", first, lambda a, b: a + b)).alias("__p"))
    if not slim:
        alone = settled(alone)
    place = F.array_position(F.array(*[F.lit(x) for x in model.names]), F.col("__declared")).cast("int") \
        if model.names else F.lit(0)
    sums = alone.agg(F.count("*"), F.count_if(place > 0), F.sum(F.when(place > 0, F.get("__p", place - 1))),
                     _summed(n)).first()
    total, trusted = sums[0] or 0, bool(sums[1]) and (sums[2] or 0.0) >= TRUSTED * sums[1]
    shares = [((s or 0.0) + DRAWN / n) / (total + DRAWN) for s in (sums[3] if total else [0.0] * n)]
    everywhere = F.array(*[F.lit(float(s)) for s in shares])
    domains = _counts(alone, "__domain", n).select("__domain", _drawn("__c", everywhere).alias("__d"))
    of_host = alone.filter(F.col("__host").isNotNull()).groupBy("__host").agg(F.min("__domain").alias("__domain"))
    hosts = (_counts(alone, "__host", n).join(of_host, "__host").join(domains, "__domain", "left")
             .select("__host", _drawn("__c", F.coalesce("__d", everywhere)).alias("__at_host")))
    suffixes = _counts(alone, "__suffix", n).select("__suffix", _drawn("__c", everywhere).alias("__at_suffix"))
    said = _counts(alone, "__declared", n).select("__declared", F.zip_with(
        F.col("__c"), everywhere, lambda c, p: (c + DRAWN / 100) / (p * max(1, total) + DRAWN)).alias("__if_declared"))
    out = _looked_up(_looked_up(_looked_up(known, hosts, "__host"), suffixes, "__suffix"), said, "__declared")
    nothing = F.array(*[F.lit(1.0)] * n)
    logs = F.col("__evidence")
    for part in (F.coalesce("__at_host", everywhere),
                 F.coalesce(F.zip_with("__at_suffix", everywhere, lambda a, b: a / b), nothing),
                 F.coalesce("__if_declared", nothing)):
        logs = F.zip_with(logs, part, lambda a, b: a + F.log(b))
    out = out.withColumn("__chances", _softmax(logs))
    best = F.array_position("__chances", F.array_max("__chances")).cast("int")
    language = F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), best)
    if model.rare and trusted:
        language = F.coalesce(language, F.when(F.col("__declared").isin(model.rare), F.col("__declared")))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in columns], language.alias("__language"),
                      F.array_max("__chances").alias("__chance"),
                      (language.isNotNull() & (F.array_max("__chances") >= ACCEPTED)).alias("__accepted"))


def _labels(host: Column, n: int) -> Column:
    """The last n labels of a host name that has a dot."""
    return F.when(host.contains("."), F.substring_index(F.lower(host), ".", -n))


def identify_documents(docs: DataFrame, model: Model, columns: list[str], slim: bool = True, text: str = "text",
                       declared: str = "lang", source: str = "source") -> DataFrame:
    """fuse() for documents: their source is the host, its address parts count if it has any."""
    host = F.col(source)
    return fuse(docs, model, columns, text, F.col(declared), host, _labels(host, 2), _labels(host, 1), slim=slim)


def identify_pages(pages: DataFrame, model: Model, columns: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """fuse() for web pages: the markup's lang attribute and the address."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    host = F.when(host != "", host)
    lang = F.regexp_extract(F.col(html), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    return fuse(pages, model, columns, html, F.when(lang != "", lang), host, _labels(host, 2), _labels(host, 1), markup=True)


def accepted_documents(docs: DataFrame, text: str = "text", declared: str = "lang", source: str = "source",
                       key: str = "doc_id") -> DataFrame:
    """The rows of docs with an accepted language, with all their columns."""
    model = train(docs, text, declared, key)
    found = identify_documents(docs, model, docs.columns, False, text, declared, source)
    return found.filter("__accepted").select(*[F.col(f"`{c}`") for c in docs.columns])
