"""Operator 5: main text of web pages by gradient-boosted trees over DOM nodes."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm import dom
from hourloom.llm.common import pieces, settled

#: Pages whose texts training pages are made of, and training pages for each.
SAMPLE_PAGES, COPIES = 200, 16
ROUNDS, DEPTH, SEED = 40, 5, 5


@dataclass
class Trees:
    """A boosted model as arrays: for each node of each tree the feature (-1: a leaf), threshold,
    children and value. The log-odds of a row are twice the weighted sum of its leaves."""

    weights: list[float]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for weight, (feature, threshold, left, right, value) in zip(self.weights, self.trees):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, np.where(rows[every, f] <= threshold[at], left[at], right[at]))
            total += weight * value[at]
        return 2 * total


_IF = re.compile(r"\s*If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


def _arrays(lines: Iterator[str]) -> tuple[np.ndarray, ...]:
    """One tree from the lines of its printed form: If, left, Else, right."""
    feature, threshold, left, right, value = [], [], [], [], []

    def node() -> int:
        line, n = next(lines), len(feature)
        for column in (feature, threshold, left, right, value):
            column.append(0)
        if leaf := _LEAF.match(line):
            feature[n], value[n] = -1, float(leaf[1])
        else:
            split = _IF.match(line)
            feature[n], threshold[n] = int(split[1]), float(split[2])
            left[n] = node()
            next(lines)  # Else
            right[n] = node()
        return n

    node()
    return tuple(np.array(c) for c in (feature, threshold, left, right, value))


def _blocks(page: dom.Page) -> list[str]:
    """Texts that training pages are made of: what the page says in paragraphs."""
    paragraphs = [i == 8 for i in page.tag]
    text = dom.text_of(page, [True] * len(paragraphs)).split("\n")
    return [t for t in text if len(t) > 1][:60] or ["a few words of text.", "and some more words, here."]


_SEMANTIC = {"nav": ("nav", "menu"), "header": ("header",), "footer": ("footer",), "side": ("aside",)}
_JUNK = {  # names of parts of pages, by what they are; indexes of dom.WORD_GROUPS
    "nav": 1, "header": 2, "footer": 3, "side": 4, "ad": 5, "comments": 6, "notice": 7, "share": 8, "form": 9}
_MAIN_NAMES = sorted(dom.WORD_GROUPS[0])
_OTHER_NAMES = sorted(set().union(*dom.WORD_GROUPS[1:]) - dom.WORD_GROUPS[0])
_AFFIXES = ("has", "no", "with", "without", "category", "tag", "type", "is", "in")


def training_page(blocks: list[str], seed: int) -> str:
    """A page of the given texts in a made-up layout; main text is marked."""
    rng = random.Random(seed)
    own = blocks[: rng.randint(1, max(1, len(blocks)))]
    words = " ".join(blocks).split() or ["word"]

    def esc(text: str) -> str:
        return html.escape(text, quote=False)

    def some(low: int, high: int) -> str:
        k, at = rng.randint(low, high), rng.randrange(len(words))
        return esc(" ".join((words * 2)[at:at + k]))

    def made_up() -> str:
        """A name in no list, as in other languages or from a build tool."""
        return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) \
            + rng.choice(["", "", str(rng.randrange(99)), "-" + rng.choice("abcxyz") + str(rng.randrange(99))])

    def main_names() -> str:
        """Names of a container of main text: telling ones, made-up ones, and any word beside them."""
        kind, parts = rng.random(), []
        if kind < 0.5:
            parts.append(rng.choice(_MAIN_NAMES) + rng.choice(["", "", "-body", "-area", "-wrap"]))
        elif kind < 0.75:
            parts.append(made_up())
        if not parts or rng.random() < 0.5:
            for _ in range(rng.randint(1, 2)):
                word = rng.choice(_OTHER_NAMES)
                parts.append(rng.choice([word, f"{rng.choice(_AFFIXES)}-{word}", f"{word}-{rng.choice(_MAIN_NAMES)}",
                                         f"{rng.choice(_MAIN_NAMES)}-{word}", f"{word}-{made_up()}"]))
        rng.shuffle(parts)
        return f' {rng.choice(["class", "class", "class", "id", "itemprop"])}="{" ".join(parts)}"'

    def names(kind: str) -> str:
        if rng.random() < 0.3:
            return rng.choice(["", f' {rng.choice(["class", "id"])}="{made_up()}"'])
        words_of = sorted(dom.WORD_GROUPS[_JUNK[kind]])
        name = rng.choice(words_of)
        if rng.random() < 0.2:
            name = rng.choice(_MAIN_NAMES) + "-" + name
        if rng.random() < 0.4:
            name += rng.choice(["-", "_", " "]) + rng.choice(["box", "wrap", "list", "area", "item", "top", rng.choice(words_of)])
        return f' {rng.choice(["class", "class", "id", "role"])}="{name}"'

    def junk(kind: str, inner: str) -> str:
        plain = rng.random() < 0.75
        tag = rng.choice(_SEMANTIC[kind]) if kind in _SEMANTIC and plain else rng.choice(["div", "div", "section"])
        if kind == "form" and plain:
            tag = "form"
        named = names(kind) if tag in ("div", "section") or rng.random() < 0.4 else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def links(k: int, short: bool = True) -> str:
        items = [f'<a href="/{rng.randrange(999)}">{some(1, 2 if short else 9)}</a>' for _ in range(k)]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return rng.choice([" ", " | ", ""]).join(items)

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{esc(rng.choice(blocks))}</p>" if rng.random() < 0.7 else f"<p>{some(1, 60)}</p>"
                       for _ in range(rng.randint(low, high)))

    def nav() -> str:
        return junk("nav", links(rng.randint(2, 12)))

    def comments() -> str:
        items = "".join(
            f"<{tag}{names('comments') if rng.random() < 0.4 else ''}><b>{some(1, 2)}</b>" + paragraphs(1, 2)
            + (f"<a href='#'>{some(1, 1)}</a>" if rng.random() < 0.5 else "") + f"</{tag}>"
            for tag in rng.choices(["div", "div", "li"], k=rng.randint(1, 5)))
        form = junk("form", f"<input name=a><textarea></textarea><button>{some(1, 2)}</button>") if rng.random() < 0.4 else ""
        return junk("comments", f"<h3>{some(1, 3)}</h3>" * rng.randint(0, 1) + items + form)

    def advert() -> str:
        return junk("ad", rng.choice([some(2, 40), f"<p>{some(3, 40)}</p>", f"<a href='x'>{some(2, 9)}</a>"]))

    def share() -> str:
        return junk("share", links(rng.randint(2, 5)))

    def notice() -> str:
        return junk("notice", rng.choice([some(5, 40), f"<p>{some(5, 40)}</p>"]) + f"<button>{some(1, 2)}</button>" * rng.randint(0, 1))

    def form() -> str:
        return junk("form", f"<label>{some(1, 3)}</label><input><button>{some(1, 2)}</button>")

    def side() -> str:
        return junk("side", f"<h3>{some(1, 3)}</h3>" + rng.choice([links(rng.randint(2, 8), False), paragraphs(1, 3), f"<p>{some(5, 50)}</p>"]))

    body = [f"<h1 data-main-text>{some(1, 12)}</h1>"] if rng.random() < 0.8 else []
    if body and rng.random() < 0.15:
        body = [f"<header data-main-text>{body[0]}</header>"]
    for text in own:
        shape = rng.random()
        text = esc(text)
        if shape < 0.06:
            body.append(f"<h2 data-main-text>{some(1, 8)}</h2>")
        elif shape < 0.1:
            body.append("<ul data-main-text>" + "".join(f"<li data-main-text>{some(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif shape < 0.13:
            body.append(f"<blockquote data-main-text><p data-main-text>{text}</p></blockquote>")
        elif shape < 0.16:
            text = f'{text} <a href="/x">{some(1, 4)}</a>'
        elif shape < 0.2:
            text = some(1, 3)
        elif shape < 0.23:
            row = lambda: "<tr data-main-text>" + "".join(f"<td data-main-text>{some(1, 6)}</td>" for _ in range(2)) + "</tr>"
            body.append(f"<table data-main-text>{row()}{row()}</table>")
        body.append(f"<p data-main-text><b>{text}<br>" if rng.random() < 0.1 else f"<{(t := rng.choice(['p', 'p', 'p', 'p', 'div']))} data-main-text>{text}</{t}>")
    if rng.random() < 0.3:  # sections below the title
        cuts = sorted(rng.sample(range(1, len(body) + 1), min(len(body), rng.randint(1, 3))))
        groups = ["".join(body[a:b]) for a, b in zip(cuts, [*cuts[1:], len(body)]) if a < b]
        tag = rng.choice(["section", "div"])
        body = body[:cuts[0]] + [f"<{tag}{rng.choice(['', '', main_names()])} data-main-text>{g}</{tag}>" for g in groups]
    inside = [make() for make in (advert, share, side, notice, form) for _ in range(rng.choice([0, 0, 0, 1]))]
    for part in inside:
        body.insert(rng.randint(0, len(body)), part)
    if rng.random() < 0.35:
        body.append(comments())
    if rng.random() < 0.2:
        body.append(junk("footer", rng.choice([some(1, 9), links(2), f"{some(1, 3)} {links(1)}"])))
    if rng.random() < 0.12:  # a page of nothing but its text
        return "".join(body) if rng.random() < 0.5 else f"<html><body><div>{''.join(body)}</div></body></html>"
    tag = rng.choice(["article", "article", "article", "main", "div", "div", "div", "div", "section"])
    plain = rng.random() < (0.5 if tag in ("article", "main") else 0.25)
    main = f"<{tag}{'' if plain else main_names()} data-main-text>{''.join(body)}</{tag}>"
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        main = f"<div{rng.choice(['', main_names(), ' class=' + made_up()])} data-main-text>{main}</div>"
    if rng.random() < 0.06:
        main = f"<table data-main-text><tr data-main-text><td>{links(rng.randint(2, 6))}</td><td data-main-text>{main}</td></tr></table>"
    around = [make() for make in (side, advert, side, comments, form, share) for _ in range(rng.choice([0, 0, 1]))]
    cut = rng.randint(0, len(around))
    main = "".join(around[:cut]) + main + "".join(around[cut:])
    for _ in range(rng.randint(0, 2)):
        main = f"<div{rng.choice(['', ' class=wrapper', ' id=page', ' class=' + made_up(), main_names()])}>{main}</div>"
    top = [make() for make in (notice, lambda: junk("header", nav() + some(1, 6)), nav, advert) if rng.random() < 0.5]
    tail = [make() for make in (nav, notice, lambda: junk("footer", rng.choice([some(2, 20), links(4), f"<p>{some(2, 20)}</p>"]))) if rng.random() < 0.5]
    return (f"<html><head><title>{some(1, 9)}</title><script>var a='<p>';</script></head><body>"
            + "".join(top) + main + "".join(tail) + "</body></html>")


def training_rows(pages: DataFrame, key: str, source: str) -> DataFrame:
    """features and label of the nodes of COPIES training pages for each of SAMPLE_PAGES pages, the
    ones with the smallest seeded hash of their key and markup. Only nodes whose parent holds main
    text are asked about, as the others are never chosen."""
    sample = (pages.select(F.coalesce(F.col(source), F.lit("")).alias("__html"),
                           F.xxhash64(F.lit(SEED), F.col(key), F.col(source)).alias("__hash"))
              .orderBy("__hash", "__html").limit(SAMPLE_PAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source_text, seed in zip(*(c.to_pylist() for c in batch.columns)):
                blocks = _blocks(dom.parse(source_text))
                made = [dom.parse(training_page(blocks, seed + k)) for k in range(COPIES)]
                known = [dom.labels(p) for p in made]
                asked = np.array([n > 0 and own[p.parent[n]] > 0 for p, own in zip(made, known) for n in range(len(own))])
                label = np.array([float(y) for own in known for y in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(dom.features(made)[asked])), pa.array(label[asked])], ["features", "label"])

    return sample.mapInArrow(run, "features array<double>, label double")


def train(pages: DataFrame, key: str, source: str) -> Trees:
    """The model, fitted by Spark on the bounded sample."""
    rows = settled(training_rows(pages, key, source).coalesce(2))
    if rows.isEmpty():
        return Trees([], [])
    fitted = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED, stepSize=0.3, maxBins=64).fit(
        rows.select(array_to_vector("features").alias("features"), "label"))
    trees = []
    for tree in fitted.trees:
        trees.append(_arrays(iter(tree.toDebugString.strip().split("\n")[1:])))
    return Trees(list(fitted.treeWeights), trees)


def main_text(pages: list[str | None], model: Trees) -> list[str]:
    parsed = [dom.parse(p) for p in pages]
    scores = model.log_odds(dom.features(parsed)).tolist()
    out, at = [], 0
    for page in parsed:
        n = len(page.tag)
        out.append(dom.text_of(page, dom.kept_nodes(page, scores[at:at + n])))
        at += n
    return out


def extract(pages: DataFrame, columns: list[str], key: str = "page_id", source: str = "html") -> DataFrame:
    """The given columns of every row of pages, its main text and n_chars (its code points).

    A page is read as a tree of elements; boosted trees give each node the log-odds of holding main
    text if their parent does; of all choices of nodes that have no node without its parent, the
    likeliest is taken. Its text is a line per block, character references decoded, white space single. NULL and
    empty pages have empty text; repeated rows get the same text; an empty table gives no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(pages, key, source))  # ROUNDS trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__html", 1 << 20):
                texts = main_text(piece.column("__html").to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("__row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["__row", "__text", "__n_chars"])

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(source).alias("__html"))
    schema = T.StructType([rows.schema["__row"], T.StructField("__text", T.StringType()), T.StructField("__n_chars", T.LongType())])
    return rows.mapInArrow(run, schema).select(
        *[F.col("__row").getField(c).alias(c) for c in columns], F.col("__text").alias("text"), F.col("__n_chars").alias("n_chars"))
