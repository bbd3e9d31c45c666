"""Operator 12: secrets in texts, by fixed patterns and by a battery of randomness tests."""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import pieces, small_batches, stored

# The patterns of the base kinds and the lengths that their matches need.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{14,}"), re.compile("[0-9a-f]{16,}")
ASSIGNED_CHARS = 12
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

#: The shortest run of key characters that is tested, and the length classes' lower ends.
CLASSES = (20, 24, 32, 40, 56, 80, 128)
RUN = re.compile(f"[A-Za-z0-9+/_-]{{{CLASSES[0]},}}")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The alphabets that are inferred, in order of size.
ALPHABETS = (("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"),
             ("base36", _DIGITS + _LOWER), ("base62", _DIGITS + _UPPER + _LOWER),
             ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"))
#: Share of false ones among what a class adds, at most, and the levels below which a single test
#: and the combined one reject randomness.
FALSE_SHARE, LEVEL, COMBINED_LEVEL = 0.05, 0.001 / 3, 0.01
#: Steps of a score's logit on either side of zero.
STEPS, STEP = 100, 8.0

_CODES = np.full((len(ALPHABETS), 256), 255, np.uint8)
for _row, (_, _letters) in zip(_CODES, ALPHABETS):
    _row[np.frombuffer(_letters.encode(), np.uint8)] = np.arange(len(_letters))
_SIZES = np.array([len(a) for _, a in ALPHABETS])
_PLAIN = bytes(c if chr(c).isascii() and chr(c).isalnum() else 0x20 for c in range(256))


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Chance of a larger value."""
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])


def battery(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Inferred alphabet (-1: none) of each string, and its three chances to be as odd as it is if
    its letters were drawn evenly: chi-squared evenness, runs about the alphabet's middle, and serial
    correlation of neighbours (round the end). Chi-squared is brought to the mean and variance that few
    letters give and taken by the cube-root approximation; the others are normal."""
    flat = np.frombuffer(b"".join(strings), np.uint8)
    n = np.array([len(s) for s in strings])
    starts = np.cumsum(n) - n
    fits = np.array([np.maximum.reduceat(codes[flat], starts) < 255 for codes in _CODES])
    kind = np.where(fits.any(0), fits.argmax(0), -1)
    owner = np.repeat(np.arange(len(strings)), n)
    value = _CODES[kind[owner], flat].astype(np.int64)
    k = _SIZES[kind]
    counts = np.bincount(owner * 64 + np.minimum(value, 63), minlength=64 * len(strings)).reshape(-1, 64)
    uneven = (counts.astype(float) ** 2).sum(1) * k / n - n
    mean, variance = k - 1.0, 2.0 * (k - 1) * (n - 1) / n
    scale = variance / (2 * mean)
    df = mean / scale
    cubed = ((uneven / scale / df).clip(min=0) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    chances = [_normal_tail(cubed)]

    high = value >= (k // 2)[owner]
    last = np.zeros(len(flat), bool)
    last[starts + n - 1] = True
    runs = np.add.reduceat((np.append(high[1:] != high[:-1], False) & ~last).astype(float), starts) + 1
    a = np.add.reduceat(high.astype(float), starts)
    b = n - a
    even = 2 * a * b / n + 1
    spread = np.maximum((even - 1) * (even - 2) / (n - 1), 1e-9)
    chances.append(np.where((a > 0) & (b > 0), 2 * _normal_tail(np.abs(runs - even) / np.sqrt(spread)), 0))

    after = np.append(value[1:], 0)
    after[starts + n - 1] = value[starts]
    total, square, product = (np.add.reduceat(v.astype(float), starts) for v in (value, value * value, value * after))
    below = n * square - total ** 2
    serial = np.where(below > 0, (n * product - total ** 2) / np.where(below > 0, below, 1), 1.0)
    sd = n / (n - 1) / np.sqrt(n - 2)
    chances.append(2 * _normal_tail(np.abs(serial + 1 / (n - 1)) / sd))
    return kind, np.array(chances).T


def scores(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class (alphabet and length; -1: no alphabet) of each string, and the step of its score: the
    logit of the chances combined by Fisher's method, least where the tests reject randomness."""
    if not strings:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    kind, chances = battery(strings)
    half = -np.log(chances.clip(1e-300, 1)).sum(1)  # chi-squared with six degrees, halved
    combined = np.exp(-half) * (1 + half + half * half / 2)
    logit = np.log(combined.clip(1e-300)) - np.log1p(-combined.clip(max=1 - 1e-12))
    rejected = (chances.min(1) < LEVEL) | (combined < COMBINED_LEVEL)
    step = np.where(rejected, -STEPS, np.clip(np.floor(STEP * logit), 1 - STEPS, STEPS))
    length = np.searchsorted(CLASSES, [len(s) for s in strings], "right") - 1
    return np.where(kind < 0, -1, kind * len(CLASSES) + length).astype(np.int32), step.astype(np.int32)


def ordinary_strings(text: str) -> list[bytes]:
    """What people make of ordinary words: each word of the text goes into one string of several
    words, put together as in identifiers, paths and slugs. Only long enough ones are returned."""
    words = [w for w in text.encode().translate(_PLAIN).split() if len(w) < CLASSES[0]]
    out, at = [], 0
    while at < len(words):
        pick = zlib.crc32(words[at])
        own = words[at:at + 3 + pick % 16]
        at += len(own)
        way = (pick >> 8) % 6
        out.append(b"".join(own).lower() if way == 0 else b"".join(w.capitalize() for w in own) if way == 1
                   else b"".join(own).upper() if way == 2 else (b"-", b"/", b"_")[way - 3].join(own))
    return [s for s in out if len(s) >= CLASSES[0]]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed kinds in a text, in order."""
    low, out = text.lower(), []
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED_CHARS]
    out += [(m.start(), kind, m.end()) for kind, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of key characters that lie in no base span."""
    out, covered, at = [], 0, 0
    for m in RUN.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            covered, at = max(covered, base[at][2]), at + 1
        if m.end() > covered:
            out.append(m.span())
    return out


_FOUND = [("__base", pa.list_(pa.int32())), ("__starts", pa.list_(pa.int32())), ("__ends", pa.list_(pa.int32())),
          ("__classes", pa.list_(pa.int32())), ("__steps", pa.list_(pa.int32())),
          ("__class", pa.int32()), ("__step", pa.int32()), ("__ordinary", pa.int64()), ("__tested", pa.int64())]


def _scan(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """A row per document with its spans and tested runs, and rows that count scores by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                texts = [t or "" for t in piece.column("__text").to_pylist()]
                spans = [base_spans(t) for t in texts]
                runs = [candidates(t, own) for t, own in zip(texts, spans)]
                classes, steps = scores([t[a:b].encode() for t, own in zip(texts, runs) for a, b in own])
                tally: dict = defaultdict(lambda: [0, 0])
                for own, column in ((scores([s for t in texts for s in ordinary_strings(t)]), 0), ((classes, steps), 1)):
                    for (c, s), n in _counted(*own):
                        tally[c, s][column] += n
                rows: list[list] = [[] for _ in _FOUND]
                at = 0
                for base, own in zip(spans, runs):
                    till = at + len(own)
                    for column, value in zip(rows, ([x for s in base for x in s], [a for a, _ in own], [b for _, b in own],
                                                    classes[at:till].tolist(), steps[at:till].tolist(), None, None, None, None)):
                        column.append(value)
                    at = till
                for (c, s), (ordinary, tested) in tally.items():
                    for column, value in zip(rows, (None, None, None, None, None, c, s, ordinary, tested)):
                        column.append(value)
                blank = len(rows[0]) - len(texts)
                kept = [pa.concat_arrays([c, pa.nulls(blank, c.type)]) for c in piece.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(c, t) for c, (_, t) in zip(rows, _FOUND))], [*names, *(n for n, _ in _FOUND)])

    names = [f"__keep{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("__text"))
    schema = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)]).schema
    for field in schema:
        field.nullable = True
    for name, kind in _FOUND:
        schema = schema.add(name, T.ArrayType(T.IntegerType()) if pa.types.is_list(kind)
                            else T.IntegerType() if kind == pa.int32() else T.LongType())
    return rows.mapInArrow(run, schema)


def _counted(classes: np.ndarray, steps: np.ndarray) -> Iterator[tuple[tuple[int, int], int]]:
    wide = 2 * STEPS + 1
    code, n = np.unique(classes[classes >= 0].astype(np.int64) * wide + steps[classes >= 0] + STEPS, return_counts=True)
    for c, k in zip(code.tolist(), n.tolist()):
        yield (c // wide, c % wide - STEPS), k


def cuts(tallies: Sequence[tuple[int, int, int, int]], share: float = FALSE_SHARE) -> dict[int, int]:
    """For each class the least step that is taken as random, from (class, step, ordinary, tested).

    A run's chance is the share of ordinary strings of its class, so of its length, that score as
    high. By Benjamini and Hochberg's rule the cut is the lowest at which the expected number of
    false ones is within `share` of what is found. A class without ordinary strings finds nothing.
    """
    by: dict[int, list] = defaultdict(list)
    for c, *rest in tallies:
        by[c].append(rest)
    out = {}
    for c, rows in by.items():
        tests, ordinary = sum(t for _, _, t in rows), sum(o for _, o, _ in rows)
        above = found = 0
        for step, o, t in sorted(rows, reverse=True):
            above, found = above + o, found + t
            if step > -STEPS and found and (1 + above) / (1 + ordinary) * tests <= share * found:
                out[c] = step
    return out


def find_secrets(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in `keep` and __spans: array of (start, kind, end) in code points, end exclusive,
    in order of start, then kind (a number in KINDS).

    Base kinds are the fixed patterns. Beside them every maximal run of at least 20 key characters that
    no base span covers is tested: an alphabet is inferred, three tests give its chances if it were
    random, and their combination is a score. What ordinary text scores is counted over all documents
    from strings of their own words, by alphabet and length, and the cut of each class is drawn from
    both counts (a few thousand numbers). NULL texts are empty; every row has one result.
    """
    small_batches(docs.sparkSession)
    found = stored(_scan(docs, text, keep), "secrets")
    tallies = found.filter("__class is not null").groupBy("__class", "__step").agg(
        F.sum("__ordinary"), F.sum("__tested")).collect()
    drawn = cuts([tuple(r) for r in tallies])
    least = F.create_map(*[F.lit(x) for c in drawn.items() for x in c]) if drawn else None

    def span(start: Column, kind: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"))

    spans = F.transform(
        F.filter("__base", lambda x, i: i % 3 == 0),
        lambda start, i: span(start, F.get("__base", 3 * i + 1), F.get("__base", 3 * i + 2)))
    if least is not None:
        tested = F.arrays_zip("__starts", "__ends", "__classes", "__steps")
        taken = F.filter(tested, lambda r: F.coalesce(r["__steps"] >= least[r["__classes"]], F.lit(False)))
        spans = F.array_sort(F.concat(spans, F.transform(
            taken, lambda r: span(r["__starts"], F.lit(KINDS.index("random")), r["__ends"]))))
    return found.filter("__class is null").select(
        *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], spans.alias("__spans"))


def n_spans(spans: Column, kind: str) -> Column:
    """How many spans are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
