"""Web pages as flat trees of nodes with features, for operator 5."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np

#: A tag, and one whose attributes are not read for quotes.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements without content, elements whose content is not text of the page,
# elements within a line, and what a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg object xmp select annotation".split())
#: Of these, all to the end of the page is content if the end tag is missing; of the others none is.
TO_THE_END = frozenset("script style title textarea xmp iframe".split())
SELF_CLOSING = frozenset("svg object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
                   "meter q s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo mrow ms "
                   "msup msub msubsup mfrac msqrt mroot mtext mspace mstyle mover munder munderover".split())
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_BOUND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}, "body": {"html"}}

TAG_GROUPS = [frozenset(g.split()) for g in (
    "article main", "nav menu", "header", "footer", "aside", "form button fieldset input label dialog",
    "ul ol dl", "li dt dd", "p", "h1 h2 h3 h4 h5 h6", "div section", "table tr td th tbody thead", "blockquote pre figure figcaption",
    "a", "span ins small time")]
#: Words in class, id, role, itemprop and aria-label that tell what a part of a page is for.
WORD_GROUPS = [frozenset(g.split()) for g in (
    "article content post entry story main body text articlebody prose",
    "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toolbar tabs skip toc",
    "header masthead topbar branding logo banner hero",
    "footer foot bottom copyright colophon legal imprint contentinfo",
    "sidebar side aside related recommended recommendations popular trending widget widgets rail complementary more",
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promoted promotion adsbygoogle teaser",
    "comment comments reply replies respond discussion disqus feedback reader thread",
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall privacy warning message",
    "share sharing social follow like meta tags byline rating vote",
    "form search login register input field contact")]
HIDDEN = len(WORD_GROUPS)
_WORDS: dict[str, int] = {}
for _k, _group in enumerate(WORD_GROUPS):
    for _word in _group:
        _WORDS[_word] = _WORDS.get(_word, 0) | 1 << _k
_GROUP_OF = {tag: k for k, group in enumerate(TAG_GROUPS) for tag in group}


@dataclass
class Page:
    """Nodes in page order; a node's subtree is start..end. Texts are (node, block, text)."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    tags_above: list[int] = field(default_factory=list)
    names: list[int] = field(default_factory=list)
    other: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    elements: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    marked: list[int] = field(default_factory=list)
    first_title: list[int] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def _attributes(rest: str) -> tuple[int, int, int, bool]:
    """Word groups and hiding of an element; how many words its names have, and how many of them are
    in groups that aren't main text's; whether it is marked as main text of a training page."""
    groups, named, other, marked = 0, 0, 0, False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role", "itemprop", "aria-label", "itemtype"):
            for word in _NAME.findall(value):
                own = _WORDS.get(word.lower(), 0)
                groups |= own
                named += 1
                other += own > 1
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" \
                or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            groups |= 1 << HIDDEN
            named += 1
        elif key == "data-main-text":
            marked = True
    return groups, named, other, marked


def _ends(tag: str, source: str, at: int, limit: int) -> dict[int, int]:
    """Where the elements of one name that start at or after a place end; without those that have no end tag."""
    opened, ends = [], {}
    for found in re.compile(rf"<!--.*?(?:-->|\Z)|<(/?){tag}(?=[\s/>])[^>]*>", re.I | re.S).finditer(source, at, limit):
        if found[1]:
            if opened:
                ends[opened.pop()] = found.end()
        elif found[1] is not None and not (tag in SELF_CLOSING and found[0].endswith("/>")):
            opened.append(found.start())
    return ends


class _Tags:
    """The tags of a page one after another. A page without further > has no more tags; once quotes
    in a tag have hidden all that follow, quotes are not heeded any more. So no text is read often."""

    def __init__(self, source: str):
        self.source, self.pattern = source, _TAG
        self.limit = source.rfind(">") + 1

    def next(self, at: int) -> tuple[int, int, re.Match | None] | None:
        """Start and end of the next tag, comment or other markup, and the tag's match."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(source), None
            if start >= self.limit:
                return None
            kind = source[start + 1:start + 2]
            if kind.isascii() and kind.isalpha() or kind == "/" and source[start + 2:start + 3].isascii() \
                    and source[start + 2:start + 3].isalpha():
                found = self.pattern.match(source, start)
                if not found and self.pattern is _TAG:
                    self.pattern = _PLAIN_TAG
                    found = self.pattern.match(source, start)
                if found:
                    return start, found.end(), found
            elif kind in ("!", "?", "/"):
                return start, source.find(">", start) + 1, None
            at = start + 1
        return None


def _raw_end(tag: str, source: str, at: int) -> int:
    """Past the end tag of an element whose content is no markup; the end of the page without one."""
    found = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
    end = source.find(">", found.end()) if found else -1
    return end + 1 if end >= 0 else len(source)


def parse(source: str | None) -> Page:
    """The tree of a page, however broken its markup is. Elements within a line are nodes only if
    they are named; scripts, styles and the like are left out with their content."""
    page = Page()
    children = [0]

    def open_node(tag: str, parent: int, groups: int, named: int, other: int, marked: bool) -> int:
        n = len(page.tag)
        group = _GROUP_OF.get(tag, len(TAG_GROUPS))
        page.tag.append(group)
        page.parent.append(parent)
        page.end.append(0)
        page.depth.append(page.depth[parent] + 1 if n else 0)
        page.place.append(children[parent] if n else 0)
        if n:
            children[parent] += 1
            children.append(0)
        page.words.append(groups)
        page.above.append(groups | (page.above[parent] if n else 0))
        page.tags_above.append(1 << group | (page.tags_above[parent] if n else 0))
        page.names.append(named)
        page.other.append(other)
        for column in (page.chars, page.linked, page.stops, page.elements, page.controls):
            column.append(0)
        page.marked.append(int(marked))
        page.first_title.append(int(tag == "h1"))
        return n

    open_node("html", 0, 0, 0, 0, False)
    stack: list[tuple[str, int]] = [("html", 0)]  # element, node that its text belongs to
    places: dict[str, list[int]] = {}  # where the open elements of a name are on the stack
    blocks = [0]  # where those are that are not within a line
    block = at = links = 0
    ends: dict[str, dict[int, int]] = {}
    source = source or ""
    tags, size = _Tags(source), len(source)

    def enter(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, node))

    def leave(count: int) -> None:
        nonlocal block, links
        while len(stack) > count:
            tag, node = stack.pop()
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()
                block += 1
            if tag == "a":
                links -= 1
            if node != stack[-1][1]:
                page.end[node] = len(page.tag)

    def say(text: str) -> None:
        node = stack[-1][1]
        if "&" in text:
            text = html.unescape(text)
        page.texts.append((node, block, text))
        n = len(text) if not text.isspace() else 0
        page.chars[node] += n
        page.stops[node] += text.count(".") + text.count(",")
        if links:
            page.linked[node] += n

    while at < size:
        markup = tags.next(at)
        if not markup:
            say(source[at:])
            break
        start, end, found = markup
        if start > at:
            say(source[at:start])
        at = end
        if found is None:
            continue
        tag, rest = found[2].lower(), found[3]
        if found[1]:
            open_ones = places.get(tag)
            if open_ones and (tag not in INLINE or open_ones[-1] > blocks[-1]):
                leave(open_ones[-1])
            continue
        if tag in RAW:
            if tag in TO_THE_END:
                at = _raw_end(tag, source, at)
            elif not rest.endswith("/") or tag not in SELF_CLOSING:
                if tag not in ends:
                    ends[tag] = _ends(tag, source, start, tags.limit)
                at = ends[tag].get(start, at)
            if tag in ("textarea", "select"):
                page.controls[stack[-1][1]] += 1
            continue
        if closed := CLOSED_BY.get(tag):
            # The lowest of what it ends, above the nearest element that bounds it.
            bound = max((p[-1] for name in _BOUND.get(tag, ()) if (p := places.get(name))), default=0)
            lowest = [p[k] for name in (*closed, "p") if (p := places.get(name)) and (k := bisect_right(p, bound)) < len(p)]
            if lowest:
                leave(min(lowest))
        elif tag not in INLINE and stack[blocks[-1]][0] == "p":
            leave(blocks[-1])
        node = stack[-1][1]
        page.elements[node] += 1
        if tag in VOID:
            if tag == "br" and page.texts:
                say(" ")
            elif tag == "hr":
                block += 1
            elif tag == "input":
                page.controls[node] += 1
            continue
        groups, named, other, marked = _attributes(rest) if rest.strip(" /\n\t") else (0, 0, 0, False)
        if tag not in INLINE:
            block += 1
            if tag in ("button", "form"):
                page.controls[node] += 1
        if tag == "a":
            links += 1
        if tag not in INLINE or named and groups:
            node = open_node(tag, node, groups, named, other, marked)
        enter(tag, node)
    leave(1)
    page.end[0] = len(page.tag)
    return page


FEATURES = 28 + 2 * (len(TAG_GROUPS) + 1) + 2 * (len(WORD_GROUPS) + 1)


def features(pages: list[Page]) -> np.ndarray:
    """A row per node of all pages, one page after another."""
    if not pages:
        return np.zeros((0, FEATURES))
    sizes = [len(p.tag) for p in pages]
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = int(sum(sizes))

    def column(name: str) -> np.ndarray:
        return np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])

    parent, end, chars = column("parent") + base, column("end") + base, column("chars")
    me = np.arange(total)

    def subtree(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return (sums[end] - sums[me]).astype(float)

    tag, words, above, tags_above = column("tag"), column("words"), column("above"), column("tags_above")
    text, linked = subtree(chars), subtree(column("linked"))
    whole, around = text[base], text[parent]
    before = np.concatenate([[0], np.cumsum(chars)[:-1]])
    start = before - before[base]
    brothers = np.bincount(parent, minlength=total) - np.bincount(base[me == base], minlength=total)
    alike = subtree((tag == 8).astype(np.int64))
    following = np.where((end < total) & (parent[np.minimum(end, total - 1)] == parent), np.minimum(end, total - 1), -1)
    after = np.where(following >= 0, text[following], 0.0)
    earlier = np.zeros(total)
    earlier[following[following >= 0]] = text[following >= 0]
    density = linked / np.maximum(text, 1)
    titles, first_titles = subtree((tag == 9).astype(np.int64)), subtree(column("first_title"))
    names, other = column("names"), column("other")
    telling = other / np.maximum(names, 1)  # share of a node's name that says it isn't main text
    paragraphs = subtree(np.where(tag == 8, np.log1p(text), 0.0))
    most = np.maximum.reduceat(np.where(tag == 8, text, 0.0), np.flatnonzero(me == base)) if total else np.zeros(0)
    longest = np.repeat(most, sizes)
    titled = (np.maximum.reduceat(np.where(tag == 9, me, -1), np.flatnonzero(me == base)) if total else np.zeros(0, int))
    first_title = np.minimum.reduceat(np.where(tag == 9, me, total), np.flatnonzero(me == base)) if total else np.zeros(0, int)
    behind = (me > np.repeat(first_title, sizes)) & (np.repeat(titled, sizes) >= 0)
    numbers = np.stack([
        column("depth"), np.log1p(text), np.log1p(chars), density, density[parent], subtree(column("elements")) / (text + 20) * 100,
        text / np.maximum(whole, 1), text / np.maximum(around, 1), np.log1p(brothers[parent]), column("place") / np.maximum(brothers[parent], 1),
        start / np.maximum(whole, 1), subtree(column("stops")) / np.maximum(text, 1), np.log1p(alike), np.log1p(subtree(column("controls"))),
        np.log1p(earlier), np.log1p(after), np.log1p(end - me), (start + text) / np.maximum(whole, 1),
        names, telling, telling[parent], titles, titles[parent], first_titles, first_titles[parent], np.log1p(paragraphs), np.log1p(longest), behind], axis=1)
    flags = [(tag == k) for k in range(len(TAG_GROUPS) + 1)] \
        + [(tags_above[parent] >> k & 1) * (parent != me) for k in range(len(TAG_GROUPS) + 1)] \
        + [words >> k & 1 for k in range(len(WORD_GROUPS) + 1)] \
        + [(above[parent] >> k & 1) * (parent != me) for k in range(len(WORD_GROUPS) + 1)]
    return np.hstack([numbers, np.stack(flags, axis=1).astype(float)])


def labels(page: Page) -> list[int]:
    """Of a training page: 1 for nodes with main text in their subtree. A node is main text if it is
    marked; what is marked is never inside of something else that is not main text."""
    out = list(page.marked)
    for n in range(len(out) - 1, 0, -1):
        if out[n]:
            out[page.parent[n]] = 1
    return out


def kept_nodes(page: Page, scores: list[float]) -> list[bool]:
    """The likeliest choice of nodes in which every chosen node's parent is chosen too. A score is the
    log-odds that a node holds main text if its parent does; nodes below one that is left out say nothing."""
    scores = np.asarray(scores, float)
    left_out, taken = -np.logaddexp(0, scores), (-np.logaddexp(0, -scores)).tolist()
    left_out = left_out.tolist()
    for n in range(len(taken) - 1, 0, -1):
        taken[page.parent[n]] += max(taken[n], left_out[n])
    kept = [True] * min(1, len(taken))  # the page itself
    for n in range(1, len(taken)):
        kept.append(kept[page.parent[n]] and taken[n] > left_out[n])
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    """The texts of the kept nodes: a line per block, with single spaces."""
    lines: list[str] = []
    now, parts = None, []
    for node, block, text in page.texts:
        if block != now:
            lines.append("".join(parts))
            now, parts = block, []
        if kept[node]:
            parts.append(text)
    lines.append("".join(parts))
    return "\n".join(filter(None, (" ".join(line.split()) for line in lines)))
