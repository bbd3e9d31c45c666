"""Pages written by hand: (name, markup, main text). None is made by the operator's own layouts."""

P = ["The council met on Tuesday to decide how the old harbour should be used once the last ferry has gone.",
     "Residents had asked for a park, while the port authority, short of money, would rather sell the land.",
     "“We have waited long enough,” said one of them. “Another year of plans, and nothing will be left to plan.”",
     "A vote is expected in spring; until then, the fences stay where they are, and the gulls have the place to themselves."]
G = ["Der Gemeinderat hat am Dienstag beraten, was aus dem alten Hafen werden soll, wenn die letzte Fähre abgelegt hat.",
     "Die Anwohner wünschen sich einen Park, die Hafenverwaltung möchte das Gelände dagegen lieber verkaufen.",
     "Eine Entscheidung wird im Frühjahr erwartet; bis dahin bleiben die Zäune stehen, und die Möwen haben ihre Ruhe."]
H = "What becomes of the harbour"
BODY = "".join(f"<p>{p}</p>" for p in P)
TEXT = "\n".join([H, *P])
NAV = "<nav><a href='/'>Home</a> <a href='/news'>News</a> <a href='/sport'>Sport</a> <a href='/weather'>Weather</a></nav>"
FOOT = "<footer><p>© 2024 The Harbour Post. All rights reserved.</p><a href='/imprint'>Imprint</a></footer>"


def page(main, before=NAV, after=FOOT):
    return f"<!doctype html><html><head><title>{H} | The Harbour Post</title></head><body>{before}{main}{after}</body></html>"


def inside(start, end, before=NAV, after=FOOT):
    return page(f"{start}<h1>{H}</h1>{BODY}{end}", before, after)


PAGES = [(start, inside(start, end), TEXT) for start, end in [
    # Words that also name what is not main text.
    ("<article class='has-ad'>", "</article>"), ("<article class='post has-comments'>", "</article>"),
    ("<article class='story premium paywall'>", "</article>"), ("<article class='entry category-cookies'>", "</article>"),
    ("<article class='post type-post tag-search-engines'>", "</article>"), ("<div class='content with-sidebar'>", "</div>"),
    ("<div id='main' class='no-ads'>", "</div>"), ("<main class='more'>", "</main>"),
    ("<div class='article'><div class='more-text'>", "</div></div>"),
    ("<article itemprop='articleBody' aria-label='Contact us at Reader'>", "</article>"),
    ("<div class='post-content comments-open'>", "</div>"), ("<section class='story-follow-up'>", "</section>"),
    ("<div class='page-with-footer'><div class='text'>", "</div></div>"), ("<article id='privacy-law-news'>", "</article>"),
    ("<div class='hero-story'>", "</div>"), ("<div class='layout sidebar-left'><article>", "</article></div>"),
    # No telling names, names in other languages, names made by machines.
    ("<div>", "</div>"), ("<div class='css-1x2y3z'>", "</div>"), ("<div class='inhalt'>", "</div>"), ("<div id='contenu'>", "</div>"),
    ("<section>", "</section>"), ("<div class='c12'><div class='c7'>", "</div></div>"), ("<div><div><div><div>", "</div></div></div></div>"),
]]

PAGES += [
    ("german", page(f"<div id='inhalt'><h1>Was wird aus dem Hafen</h1>{''.join(f'<p>{g}</p>' for g in G)}</div>",
                    "<div id='navi'><ul><li><a href='/'>Start</a></li><li><a href='/mehr'>Mehr</a></li></ul></div>",
                    "<div id='fuss'><a href='/i'>Impressum</a> und <a href='/d'>Datenschutz</a></div>"),
     "\n".join(["Was wird aus dem Hafen", *G])),
    ("no names at all", page(f"<div><h1>{H}</h1>{BODY}</div>", "<div><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/s'>Sport</a></div>",
                             "<div><a href='/imprint'>Imprint</a> | <a href='/privacy'>Privacy</a></div>"), TEXT),
    ("layout table", page(f"<table><tr><td><a href='/'>Home</a><br><a href='/n'>News</a></td><td><h1>{H}</h1>{BODY}</td></tr></table>", "", ""), TEXT),
    ("comments after", page(f"<article><h1>{H}</h1>{BODY}</article><section class='comments'><h3>2 comments</h3><div class='comment'><b>anna</b>"
                            "<p>Sell it, and use the money for the school. The roof there leaks, as everyone knows.</p></div>"
                            "<div class='comment'><b>tom</b><p>No, a park.</p></div></section>"), TEXT),
    ("advert inside", page(f"<article><h1>{H}</h1><p>{P[0]}</p><p>{P[1]}</p><div class='advert'><a href='/buy'>Boats at half the price</a></div>"
                           f"<p>{P[2]}</p><p>{P[3]}</p></article>"), TEXT),
    ("sidebar", page(f"<div class='row'><div class='col main-col'><h1>{H}</h1>{BODY}</div><aside><h3>Most read</h3><ul>"
                     "<li><a href='/1'>Ferry sold to a Greek line</a></li><li><a href='/2'>Fog stops trains again</a></li></ul></aside></div>"), TEXT),
    ("cookie notice", page(f"<div class='cookie-consent'><p>We use cookies. By going on you agree to that.</p><button>OK</button></div>"
                           f"<main><h1>{H}</h1>{BODY}</main>"), TEXT),
    ("newsletter form", page(f"<article><h1>{H}</h1>{BODY}</article><form class='newsletter'><label>Your address</label><input name='m'>"
                             "<button>Subscribe</button></form>"), TEXT),
    ("share bar", page(f"<article><h1>{H}</h1><div class='share-buttons'><a href='#'>Share</a> <a href='#'>Tweet</a></div>{BODY}</article>"), TEXT),
    ("markup in a line", page(f"<article><h1>{H}</h1><p>The <b>old</b> harbour, <a href='/h'>built in 1880</a>, is <em>empty</em>; "
                              f"depth <math><mi>d</mi><mo>=</mo><mn>9</mn></math>&nbsp;m &amp; more.</p>{BODY}</article>"),
     "\n".join([H, "The old harbour, built in 1880, is empty; depth d=9 m & more.", *P])),
    ("lists and quotes", page(f"<article><h1>{H}</h1><p>{P[0]}</p><ul><li>a park,</li><li>flats, or</li><li>nothing at all.</li></ul>"
                              f"<blockquote><p>{P[2]}</p></blockquote><h2>What comes next</h2><p>{P[3]}</p></article>"),
     "\n".join([H, P[0], "a park,", "flats, or", "nothing at all.", P[2], "What comes next", P[3]])),
    ("bare", f"<h1>{H}</h1>{BODY}", TEXT),
]
