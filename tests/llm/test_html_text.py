import html
import random
import re
import time

import pytest

from sonolith.llm.html_text import LINKS, LONG, SHORT, STOP_HIGH, STOP_LOW, STOP_WORDS, _inside, classify, extract, main_text, parse

PROSE = "The rain in the town falls on the roofs of the houses that are by the river and it is not going to stop for some days."

CASES = {
    "template": ('<!DOCTYPE html><html><head><title>T x</title><style>p{}</style><script>var t="</p>";track(0);</script></head><body><nav><ul><li><a href="/a">The</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy the thing.</div><article><h1>T x</h1><p><b>T x<br><p>Is it.</p><p>One &amp; two&nbsp;&copy;\n three</p></article><footer>&copy; x</footer></body></html>', "T x\nT x\nIs it.\nOne & two © three"),
    "cut": ("<body><article><p>One</p><p>Two &am", "One\nTwo &am"),
    "cut tag": ("<body><article><p>One</p><p>Two</p><foo", "One\nTwo"),
    "inside": (f"<article><p>{PROSE}</p><div class='advert-box'>Buy now</div><aside>More</aside><form><p>Name</p></form><section id='comments'><p>{PROSE}</p></section><p>End.</p></article>", PROSE + "\nEnd."),
    "inline": ("<main><p>foo<b>bar</b> <i>baz</i><span>qux</span></p></main>", "foobar bazqux"),
    "plain": (f"<body><div class='menu'><a href=x>Home</a> <a href=y>About</a></div><h2>Head</h2><div>{PROSE}</div><div>Short one.</div><div>{PROSE}</div><div><a href=z>Read more of this</a></div></body>", f"Head\n{PROSE}\nShort one.\n{PROSE}"),
    "hidden": (f"<article><p>{PROSE}</p><p hidden>No</p><p style='display: none'>No</p><p>Yes</p></article>", PROSE + "\nYes"),
    "header in article": (f"<header><p>Site</p></header><div id=content><p>{PROSE}</p></div><div class=cookie-notice>We use</div>", PROSE),
    "entities": ("<article><p>&lt;b&gt; &#233; &#x4e2d; &quot;q&quot;</p></article>", '<b> é 中 "q"'),
    "empty": ("", ""),
    "none": (None, ""),
    "only menu": ("<nav>The menu</nav>", ""),
    "article in main": (f"<main><h2>Section</h2><div class='teaser-list'><p>More</p></div><article><p>{PROSE}</p></article><p>Sign up for our mail.</p></main>", PROSE),
    "named parts": (f"<div id='main-content'><h1>Head</h1><p>{PROSE}</p><ins class='adsbygoogle'></ins></div><div id='disqus_thread'><p>{PROSE}</p></div><div class='reader-comments'>{PROSE}</div>", "Head\n" + PROSE),
    "unclosed ad": (f"<article><div class=ad>Buy<p>it</div><p>{PROSE}</p></article>", PROSE),
    "uppercase": ("<ARTICLE><P>One</P><SCRIPT>x</SCRIPT></ARTICLE>", "One"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_long_page():
    page = "<article>" + "".join(f"<p>word {i}</p>" for i in range(20000)) + "</article>"
    assert main_text(page).count("\n") == 19999
    assert main_text("<" * 50000) is not None and main_text("<a " * 20000) is not None


def test_operator_on_templates(spark):
    """Against a plain reading of the pages whose article is well marked."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_rows(spark):
    rows = [(1, "u", "<article>x</article>", "t"), (1, "u", "<article>x</article>", "t"), (None, None, None, None), (2, "u", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(str, (tuple(r) for r in extract(df).collect()))) == sorted(map(str, [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, "u", "", 0)]))
    assert extract(df.where("false")).count() == 0


LAYOUTS = [
    f'<html class="no-ads"><body class="has-sidebar"><article><p>{PROSE}</p></article><p>Out</p></body></html>',
    f'<body class="single-post comments-open"><article><p>{PROSE}</p></article></body>',
    f'<body class="sidebar"><main class="search" role="form"><p>{PROSE}</p></main></body>',
    f'<div class="content-with-sidebar"><article><p>{PROSE}</p></article><div class="sidebar"><p>Out</p></div></div>',
    f'<article class="post header-image"><p>{PROSE}</p><div class="top-ad">Out</div></article>',
    f'<article class="header"><p>{PROSE}</p></article>',
    f'<div class="sidebar"><p>Out</p><article><p>{PROSE}</p></article></div>',
    f'<div class="widget"><main><div class="share">Out</div><p>{PROSE}</p></main></div>',
    f'<div class="widget"><main><div class="side"><article><p>{PROSE}</p></article></div></main></div>',
    f'<article><p>{PROSE}</p></article><div class="related-posts"><article><p>Out</p></article></div>',
    f'<div class="has-sidebar"><p>{PROSE}</p><div class="social-links">Out</div></div>',
    f'<article><p>{PROSE}</p><div class="sidebar"><aside><article><p>Out</p></article></aside></div></article>',
]


LAYOUTS += [
    f'<body class="single-post has-sidebar"><article><p>{PROSE}</p></article></body>',
    f'<div class="layout no-sidebar"><article><p>{PROSE}</p></article></div>',
    f'<article class="post category-social"><p>{PROSE}</p></article>',
    f'<div class="header-box"><p>{PROSE}</p></div><p>Short</p><a href=x>More</a>',
    f'<form action="/post"><div><p>{PROSE}</p></div><input type=text></form>',
    f'<article><p>{PROSE}</p><article><p>{PROSE}</p></article></article>',
    f'<article><p class="x>{PROSE}</p></article>',
    f"<article><p title=it's>{PROSE}</p></article>",
    f"<article><p title='a > b' data-x=\"<i>\">{PROSE}</p></article>",
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_names_of_layouts_do_not_hide_the_article(page):
    assert main_text(page) == PROSE


def test_header_of_an_article_is_a_part_of_it():
    assert main_text(f"<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>{PROSE}</p><footer>Tags</footer></article>") == "Head\n" + PROSE


def test_a_teaser_is_not_the_article():
    page = f'<div class="content"><h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><article><h2>Other</h2><p>It is a teaser.</p></article>'
    assert main_text(page) == f"Head\n{PROSE}\nShort.\n{PROSE}"


def test_text_decides_inside_an_article():
    link = '<p><a href="x">The other things that you may read of</a></p>'
    page = f"<article><h1>Head</h1><p>Short.</p><p>{PROSE}</p>{link}<p>After the links.</p><p>{PROSE}</p></article><div>{PROSE} We use it.</div>"
    assert main_text(page) == f"Head\nShort.\n{PROSE}\nAfter the links.\n{PROSE}"


def naive(found, inside):
    """The two passes by the definition: every block against every other one."""
    scores = []
    for k, b in enumerate(found):
        words = b.text.split()
        links = b.link_chars / max(1, sum(len(w) for w in words))
        stop = sum(w.strip(".,;:!?").lower() in STOP_WORDS for w in words) / max(1, len(words))
        prose = not b.heading and links <= LINKS and (len(words) >= LONG and stop >= STOP_LOW or len(words) >= SHORT and stop >= STOP_HIGH)
        score = -2 if not b.heading and SHORT <= len(words) < LONG and stop < STOP_LOW else 0
        score = (3 if len(words) >= LONG and stop >= STOP_HIGH else 2) if prose else score
        score = -3 if links > LINKS and not (inside and inside[k] and len(words) > LONG) else score
        scores.append(score + (0 if not inside else 1 if inside[k] else -2))
    first = [False if b.side or s <= -2 else True if s >= 2 else None for b, s in zip(found, scores)]
    out = []
    for k, b in enumerate(found):
        if first[k] is not None:
            out.append(first[k])
            continue
        own = [j for j in range(len(found)) if not inside or inside[j] == inside[k] and not found[j].side]
        prior = inside[k] if inside else None
        near = {}
        for j in own:
            if first[j] is not None:
                step = abs(own.index(j) - own.index(k))
                side = (near.get(j < k) or (len(found), None))[0]
                if step < side:
                    near[j < k] = (step, first[j])
        far = {side: (step * (3 if prior is not None and said != prior else 1), said) for side, (step, said) in near.items()}
        least = min((step for step, _ in far.values()), default=None)
        said = {x for step, x in far.values() if step == least}
        out.append(prior is not False if not said else said.pop() if len(said) == 1 else prior if prior is not None else b.heading and far[False][1])
    return out


def test_two_passes_against_the_definition():
    rng, ways = random.Random(3), set()
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 14)):
            words = " ".join(rng.choice(["the", "of", "it", "stone", "river", "cloud", "blue", "seven"][rng.choice([0, 3]) :]) for _ in range(rng.choice([2, 5, 12, 20, 40])))
            parts.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<h2>{}</h2>", "<div><a href=x>{}</a></div>", "<div class=ad>{}</div>", "<div>{}</div>", "<article><p>{}</p></article>", "</div><div class=content>{}"]).format(words))
        page = parse("".join(parts))
        got = classify(page)
        inside = _inside(page)
        assert got == naive(page.blocks, inside)
        ways.add((inside is None, tuple(got)))
    assert len(ways) > 100


@pytest.mark.parametrize("junk", ["<a ", '<a href="', "<p class='x", "<div class=ad>", "<div></ul>", "<script ", "&am", "</", "<article><p>a ", "<!-", '<a b="c" ', "<p title=it's>"])
def test_time_in_proportion(junk):
    """3 MB of malformed input; a step that went back over it would take an hour."""
    began = time.monotonic()
    main_text(junk * (3_000_000 // len(junk)) + '"')
    assert time.monotonic() - began < 60
