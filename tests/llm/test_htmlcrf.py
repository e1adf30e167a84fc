import itertools

import numpy as np
import pytest

from millrace.llm import htmlcrf as H


def texts(html):
    return [b.text for b in H.blocks(html)]


@pytest.fixture(scope="module")
def model():
    return H.default_model()


def test_blocks():
    assert texts("<p>a <b>b</b>c<p>d&amp;e&nbsp;&eacute;&#65;&lt;x&gt; &amp f") == ["a bc", "d&e éA<x> & f"]
    assert texts("<ul><li>x<li>y</ul><dl><dt>t<dd>d</dl><table><tr><td>1<td>2<tr><td>3</table>") == ["x", "y", "t", "d", "1", "2", "3"]
    assert texts("<head><title>no</title><style>p{}</style></head><script>var a='</p><p>x';</script>a\n\t b<!-- <p>no --><br>c<script>never ends <p>") == ["a b c"]
    assert texts(None) == texts("") == texts("<p></p>") == []
    assert texts("plain < text > here </p></div> more") == ["plain < text > here", "more"]
    assert texts('<p title="a > b">q</p><P CLASS=x>r</P') == ["q", "r"]
    assert texts("<svg><text>no</text></svg>yes<textarea>no</textarea>") == ["yes"]
    assert len(texts("<div>" * 20000 + "deep")) == 1
    b = H.blocks('<nav class="top Menu"><a href=x>one</a> two</nav>')[0]
    assert b.tags == {"nav"} and b.classes == {"menu"} and b.links == 3


def test_omitted_ends_swallow_nothing():
    assert texts("<head><title>x</title><p>one<p>two") == ["one", "two"]
    assert texts("<html><head><meta charset=a><style>p{}</style>\n<link href=b>\nbare <div>three</div>") == ["bare", "three"]
    assert texts("<div><svg><path d=x><g></div><p>after") == texts("<div><template><p>no</div><p>after") == texts("<div><object data=x></div><p>after") == ["after"]
    assert texts("<body><svg><text>no</text><p>yes</p>") == ["yes"] and texts("<math><mi>x</mi><div>yes</div>") == ["x", "yes"]
    assert texts("<svg><foreignObject><div>no</div></foreignObject><title>no</title></svg><p>yes") == ["yes"]
    assert texts("<div><template><script>'</div>'</script>no<div>no</div></template>yes</div>") == ["yes"]
    assert texts("<div><object><object></object>no</object>yes</div>") == ["yes"]


def test_no_depth_is_too_deep_and_formulas_stay():
    assert texts("<p>We know that <math><semantics><mi>x</mi><mo>&gt;</mo><mn>1</mn><annotation encoding=tex>x > 1</annotation></semantics></math> holds.") == ["We know that x>1 holds."]
    deep = "".join(f"<div class=k{i}>t{i}" for i in range(30_000)) + "</p></span></li>" * 30_000 + "</div>" * 30_000 + "<p>end"
    assert texts(deep) == [*(f"t{i}" for i in range(30_000)), "end"]
    assert H.features(H.blocks("<p>" + "word " * 200 + "| x | y"))[0, H.NAMES.index("symbols")] == 1


#: Written by hand, unlike the made pages: (page, main text).
PAGES = [
    ("""<!DOCTYPE html><html><head><title>Rain returns - The Daily</title><body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div>
<header class="site-header"><a href="/">The Daily</a><nav><ul><li><a href="/w">World</a><li><a href="/s">Sport</a></ul></nav></header>
<main><article><h1>Rain returns to the valley</h1><p>After six dry weeks, rain fell on Tuesday night, farmers said.<p>The river rose by <b>twelve</b> centimetres &mdash; less than feared.
<div class="ad">Buy two boots, get one free!</div><h2>What comes next</h2><p>More rain is expected on Friday, and the weekend will be cool.</article></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Bridge closed</a><li><a href="/2">New mayor</a></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Finally some rain, my garden was dying out there.</p></div><div class="comment"><p>They said that last week as well.</p></div></section>
<footer>&copy; 2024 The Daily. All rights reserved.</footer></body></html>""",
     "Rain returns to the valley After six dry weeks, rain fell on Tuesday night, farmers said. The river rose by twelve centimetres — less than feared. What comes next More rain is expected on Friday, and the weekend will be cool."),
    ("""<html><body><div id="nav" class="menu"><a href="/">Home</a> | <a href="/about">About</a></div><div class="content"><h1>Baking bread</h1><p>Mix flour, water and salt, then wait for an hour.</p>
<ul><li>500 g of flour<li>350 g of water</ul><p>Bake it in a hot oven until the crust is dark.</p><table><tr><td>Time<td>45 min</table></div>
<form action="/search"><label>Search</label><input name=q><button>Go</button></form><div class="footer">Contact us by mail</div></body></html>""",
     "Baking bread Mix flour, water and salt, then wait for an hour. 500 g of flour 350 g of water Bake it in a hot oven until the crust is dark. Time 45 min"),
    ("""<nav><a href=a>One</a> <a href=b>Two</a></nav><h1>Notes</h1><p>The first note is short, but it is a sentence.<p>The second note goes on for somewhat longer, with a comma.<script>track()</script><footer>Copyright someone</footer>""",
     "Notes The first note is short, but it is a sentence. The second note goes on for somewhat longer, with a comma."),
    ("", ""), ("<nav><ul><li><a href=/x>Only</a><li><a href=/y>Menus</a></ul></nav>", ""),
]


def test_pages_labelled_by_hand(model):
    for page, text in PAGES:
        assert H.main_text(page, model) == text


def article_text(html):
    """What the tables' layout says: all text of the article element, by another parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        inside, out = 0, ""

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.out += " " if tag in ("p", "h1", "br") else ""

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.out += " " if tag in ("p", "h1") else ""

        def handle_data(self, data):
            self.out += data if self.inside else ""

    r = Reader()
    r.feed(html or "")
    return " ".join(r.out.split())


def test_query_against_the_article_elements(spark):
    from millrace.llm.queries import op9_html_extraction

    folder = "/root/testdata/sf0.01"
    want = {r.page_id: article_text(r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op9_html_extraction(spark, folder).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want) and all(r.n_chars == len(r.text) for r in got)


def test_gradient_and_viterbi_against_enumeration():
    rng = np.random.default_rng(0)
    m = H.Crf()
    m.w, m.t, m.s = rng.normal(size=m.w.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    for n in (1, 2, 6):
        x, y = rng.random((n, len(H.NAMES))), rng.integers(0, 2, n)

        def total(path, x=x):
            e = x @ m.w
            return m.s[path[0]] + sum(e[i, k] for i, k in enumerate(path)) + sum(m.t[a, b] for a, b in zip(path, path[1:]))

        paths = list(itertools.product((0, 1), repeat=n))
        assert tuple(m.decode(x)) == max(paths, key=total)
        like, gw, gt, gs = m.gradient(x, y)
        z = np.logaddexp.reduce([total(p) for p in paths])
        assert np.isclose(like, total(tuple(y)) - z)
        for v, g, i in ((m.w, gw, (3, 1)), (m.t, gt, (0, 1)), (m.s, gs, (1,))):
            v[i] += 1e-6
            assert np.isclose((m.gradient(x, y)[0] - like) / 1e-6, g[i], atol=1e-3)
            v[i] -= 1e-6


def test_held_out_pages(model):
    pages = [(p, y) for p, y in H.labelled_pages(150, 77) if p]
    right = np.concatenate([model.decode(H.features(p)) == y for p, y in pages])
    assert right.mean() > 0.97


def test_whole_page(model):
    page = """<html><body><header><h1>Site</h1></header><nav><a href=1>Home</a> <a href=2>News</a></nav><div class="cookie-notice">We use cookies. <button>OK</button></div>
    <article><h1>The &amp; title</h1><p><b>Lead text here.<br><p>Second   paragraph, with a <a href=x>link</a> in it.</p><aside class="related"><a href=y>Read more</a></aside><p>Last one.</p></article>
    <section id="comments"><h3>3 comments</h3><p>I do not agree at all with this.</p></section><form><label>Name</label><input></form><footer>&copy; site &middot; all rights reserved</footer></body></html>"""
    assert H.main_text(page, model) == "The & title Lead text here. Second paragraph, with a link in it. Last one."


def test_query(spark, model):
    rows = [(1, "u", "<article><h1>A</h1><p>Some text of the article, long enough.</p></article><footer>&copy; x</footer>"), (2, None, None), (None, "v", ""), (3, "w", "<nav><a>x</a></nav>"), (4, "x", "<article>" + "<p>Many words go here, in every one.</p>" * 20000 + "</article>")]
    df = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[0]]], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract(df).collect()), key=str)
    assert got == sorted(((p, u, H.main_text(h, model), len(H.main_text(h, model))) for p, u, h in [*rows, rows[0]]), key=str)
    by = {r[0]: r for r in got}
    assert by[1][2] == "A Some text of the article, long enough." and by[2][2] == by[3][2] == "" and by[4][3] == 20000 * 34 - 1
    assert H.extract(df.limit(0)).collect() == []
