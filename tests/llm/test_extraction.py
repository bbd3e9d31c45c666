import html
import random
import re
import time

import numpy as np
import pytest

from article_pages import PAGES
from hourloom.llm import dom, extract

TEXT = "Ordinary article text that goes on for a while, with commas and full stops. It has some length."
LINES = f"Title & more\n{TEXT}\nShort.\n{TEXT} x <b>"
PARAGRAPHS = f"<p>{TEXT}</p><p>Short.</p><p>{TEXT}<br>x &lt;b&gt;</p>"
COMMENTS = ('<section id="comments" class="comments"><h3>2 comments</h3><div class="comment"><b>anna</b>'
            '<p>I really liked this text, it was long and good. Thank you.</p></div><div class="comment"><p>Me too.</p></div></section>')


def framed(main):
    return f"""<!doctype html><html><head><title>T</title><style>x{{}}</style></head><body>
<div class="cookie-banner"><p>We use cookies to make this site work. Accept?</p><button>OK</button></div>
<header class="site-header"><a href="/">Home</a><nav class="main-nav"><ul><li><a href="/a">News</a></li></ul></nav></header>
{main}<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">Another story that is popular today</a></li></ul>
<p>Popular text in the sidebar, longer than a line. It has sentences too.</p></aside>
<form class="newsletter"><label>Email</label><input name="e"><button>Subscribe</button></form>
<footer><p>&copy; 2024 The Site. All rights reserved.</p></footer><script>track("<p>x</p>")</script></body></html>"""


@pytest.fixture(scope="module")
def model(spark, folder):
    return extract.train(spark.read.parquet(f"{folder}/pages.parquet"), "page_id", "html")


def test_pages(spark, folder, model):
    def plain(page):
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inside)
        return "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)))

    pages = spark.read.parquet(f"{folder}/pages.parquet").toPandas()
    assert extract.main_text(list(pages.html), model) == [plain(p) for p in pages.html]


@pytest.mark.parametrize("main", [
    f'<article><h1>Title &amp; more</h1>{PARAGRAPHS.replace("<p>Short", "<div class=ad>Buy now!</div><p>Short")}<div class="share"><a href="#">Tweet</a></div>{COMMENTS}</article>',
    f'<div id="content"><h1>Title &amp; more</h1>{PARAGRAPHS}</div><div class="comment-list">{COMMENTS}</div>',
    f'<div class="wrap"><div class="col"><h1>Title &amp; more</h1>{PARAGRAPHS}</div></div>',
    f'<main><article class="post"><header><h1>Title &amp; more</h1></header><section>{PARAGRAPHS}</section><footer class="post-footer">Posted in <a href=x>y</a></footer></article></main>',
])
def test_layouts_that_the_tables_do_not_have(model, main):
    assert extract.main_text([framed(main)], model) == [LINES]


def test_held_out_layouts(spark, folder, model):
    pages, right = spark.read.parquet(f"{folder}/pages.parquet").toPandas().html, 0
    for k in range(100):
        source = extract.training_page(extract._blocks(dom.parse(pages[k % len(pages)])), 10**6 + k)
        page = dom.parse(source)
        right += extract.main_text([source], model)[0] == dom.text_of(page, [bool(x) for x in dom.labels(page)])
    assert right >= 85


@pytest.mark.parametrize("start, seen", [
    ("<object data=x>", True), ("<select name=s><option>a", True), ("<svg viewBox='0 0 1 1'>", True), ("<math>", True),
    ("<noscript>", True), ("<template>", True), ("<object data=x />", True), ("<svg/>", True), ("<svg-icon>", True),
    ("<svg><path></svg>", True), ("<svg>a<svg>b</svg>c</svg>", True), ("<svg><svg>b</svg>", True),
    ("<object><!-- <object> --></object>", True), ("<script>", False), ("<style>", False), ("<textarea>", False)])
def test_end_tags_that_are_missing(start, seen):
    for after in ("", "<svg>icon</svg><object>o</object><select><option>a</select><noscript>n</noscript>"):
        said = [text for _, _, text in dom.parse(f"<body><p>Before</p>{start}<p>{TEXT}</p>{after}</body>").texts]
        assert "Before" in said and (TEXT in said) == seen and "icon" not in said and "c" not in said


def test_broken_and_empty_pages(model):
    pages = [None, "", "plain text", "<p>one<p>two<br>three", "<b>a<i>b</b>c", "a < b & c &amp;amp; d", "<p title='>'>x", "<!-- x",
             "<script>no", "<div><p>x</div>y</p>z", "<p a=\"1>x</p>", "</div></p>t", "<" * 50, "<p>" * 3000 + "deep"]
    texts = extract.main_text(pages, model)
    assert len(texts) == len(pages) and texts[:5] == ["", "", "plain text", "one\ntwo three", "abc"]
    assert texts[5] == "a < b & c &amp; d" and texts[6] == "x" and texts[8] == ""


def test_choice_is_the_likeliest_without_contradiction():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 9
        page = dom.Page(tag=[0] * n, parent=[0] + [int(rng.integers(0, k)) for k in range(1, n)])
        scores = (2 * rng.normal(size=n)).tolist()

        def likelihood(keep):
            if not keep[0] or any(keep[k] and not keep[page.parent[k]] for k in range(n)):
                return -np.inf
            return sum(-np.log1p(np.exp(-s if keep[k] else s)) for k, s in enumerate(scores) if k and keep[page.parent[k]])

        best = max(likelihood([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert np.isclose(likelihood(dom.kept_nodes(page, scores)), best)


@pytest.mark.parametrize("name, source, text", PAGES, ids=[p[0] for p in PAGES])
def test_pages_written_by_hand(model, name, source, text):
    assert extract.main_text([source], model) == [text]


def test_an_article_is_never_lost_for_its_name(model):
    rng, words = random.Random(4), sorted(set().union(*dom.WORD_GROUPS))
    paragraphs = "".join(f"<p>{TEXT * 3}</p>" for _ in range(8))
    for _ in range(150):
        name = " ".join(rng.choice(["", "has-", "no-", "post-"]) + rng.choice(words) for _ in range(rng.randint(1, 3)))
        tag = rng.choice(["article", "main", "div", "section"])
        own = rng.choice(["post ", "content ", "x7 ", "article "]) + name
        page = f"<nav><a href=/>Home</a></nav><{tag} class='{own}'><h1>Title</h1>{paragraphs}</{tag}><footer>Imprint</footer>"
        assert TEXT in extract.main_text([page], model)[0], page[:200]


@pytest.mark.parametrize("unit", ["<!-- ", "<script>", "<a ", "<li>", "<b>", "</i>", "<p>", "<div>", "<a x=\"", "<a x=\">\"",
                                  "<svg ", "</script", "<select><option>", "<td>", "<"])
def test_hostile_pages_take_no_long(unit):
    start = time.perf_counter()
    dom.parse(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 8
    half = 200_000
    for a, b in (("<b>", "</i>"), ("<div>", "<li>"), ("<b>", "<p>")):
        start = time.perf_counter()
        dom.parse(a * (half // len(a)) + b * (half // len(b)))
        assert time.perf_counter() - start < 5


def test_trees_are_read_back_exactly(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(r.tolist(), float(r[0] * r[1] > 0.2)) for r in x], "f array<double>, label double")
    fitted = GBTClassifier(maxIter=5, maxDepth=extract.DEPTH, seed=1).fit(df.select(array_to_vector("f").alias("features"), "label"))
    own = extract.Trees(list(fitted.treeWeights), [extract._arrays(iter(t.toDebugString.strip().split("\n")[1:])) for t in fitted.trees])
    p = [r[0][1] for r in fitted.transform(df.select(array_to_vector("f").alias("features"))).select(vector_to_array("probability")).collect()]
    assert np.allclose(1 / (1 + np.exp(-own.log_odds(x))), p)


def test_odd_rows(spark):
    rows = [(1, "u", "<p>some words, here.</p>"), (1, "u", "<p>some words, here.</p>"), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long words " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as text", "page_id as label", "url as features")
    got = extract.extract(df, ["page_id", "url"]).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 17), (1, 17), (2, 0), (3, 549_999)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract.extract(df.limit(0), ["page_id", "url"]).count() == 0
