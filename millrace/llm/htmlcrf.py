"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of the tree.

A page is cut into leaf blocks, runs of text with the same innermost block element. Features are the
ancestors' tags and the words of their class, id and role, and the text itself (length, links, stops,
symbols); labels are main text or not. Weights and transitions are trained on labelled pages by
gradient ascent and decoded by Viterbi. The labelled pages are made here, from varied layouts with
menus, notices, adverts, forms, sidebars and comments whose blocks are known.

Cases with a defined result: null, empty and non-HTML input give the text that a browser would show as
blocks, or an empty text; unclosed, stray and cut tags are mended as browsers do; repeated rows give
equal texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"[ \t\n\r\f\v  -     　 \x85]+")
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "object", "textarea", "title", "annotation", "annotation-xml"}
_RAW_TEXT = {"script", "style", "textarea", "title", "iframe", "noscript"}
#: Start tags that end an unclosed svg, unless one of the elements that may hold HTML is open in it.
_BREAKS = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
_HOLDS = ("foreignobject", "desc", "title")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul label".split())
_ENDS_P = _BLOCK - {"button", "label", "option", "optgroup", "td", "th", "caption", "legend"}
_ALONE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_GOES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_NAMES = {
    "ad": "ad ads advert advertisement advertising adv sponsor sponsored promo promoted banner adsense", "menu": "nav menu navigation navbar breadcrumb breadcrumbs toc tabs pagination pager skip toolbar", "foot": "footer foot copyright bottom legal colophon", "head": "header masthead topbar site brand logo",
    "side": "sidebar aside side related recommended widget popular trending more rail", "note": "cookie cookies consent gdpr notice alert popup modal overlay paywall subscribe subscription newsletter signup banner message", "talk": "comment comments discussion reply replies disqus responses respond thread", "form": "form search login signin register contact field",
    "share": "share social sharing follow tweet facebook", "main": "article content main post entry story body text page prose",
}
_CLASS = {w: k for k, ws in _NAMES.items() for w in ws.split()}
_SAYS = {t: frozenset({k}) for t, k in {"article": "main", "main": "main", "nav": "menu", "aside": "side", "header": "head", "footer": "foot", "form": "form"}.items()}
_TAGS = "nav header footer aside form article main section div p ul ol li h1 h2 h3 h4 table td blockquote pre figure figcaption button label dl dialog select".split()


class Block:
    __slots__ = ("classes", "links", "near", "tags", "text")

    def __init__(self, tags: frozenset, classes: frozenset, near: frozenset, text: str, links: int) -> None:
        self.tags, self.classes, self.near, self.text, self.links = tags, classes, near, text, links


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks in page order, their text with character references decoded and white space closed up."""
    out: list[Block] = []
    # tag, ancestors' tags, ancestors' class kinds, kinds of the nearest ancestor that has any
    stack: list[tuple[str, frozenset, frozenset, frozenset]] = [("", frozenset(), frozenset(), frozenset())]
    opened: Counter = Counter()  # how many of each tag are on the stack: it is searched only for those that are
    parts: list[str] = []
    linked = 0
    link_depth = 0
    skip = ""
    inner: list[str] = []  # elements open inside the skipped one, and how many of each
    held: Counter = Counter()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip(" ")
            if text:
                out.append(Block(*stack[-1][1:], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close_to(i: int) -> None:
        nonlocal link_depth
        flush()
        opened.subtract(s[0] for s in stack[i:])
        del stack[i:]

    pos, n, source = 0, len(html or ""), html or ""
    while pos < n:
        m = _TOKEN.match(source, pos)
        pos = m.end()
        text = m[4]
        if text is not None:
            if not skip:
                parts.append(text)
                if link_depth:
                    linked += len(text.strip())
            continue
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if skip:
            foreign = skip == "svg"
            if closing and held[tag]:
                while inner and (gone := inner.pop()):
                    held[gone] -= 1
                    if gone == tag:
                        break
                continue
            if closing and tag == skip:
                skip = ""
                continue
            if closing and opened[tag] or not closing and foreign and tag in _BREAKS and not any(held[t] for t in _HOLDS):
                skip = ""  # the parent ends, or HTML begins: the tag counts as one outside
            else:
                if not closing and tag in _RAW_TEXT and not (foreign and tag == "title"):
                    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, pos)
                    pos = end.end() if end else pos if foreign else n
                elif not closing and tag not in _VOID and not (foreign and m[3].rstrip().endswith("/")):
                    inner.append(tag)
                    held[tag] += 1
                continue
        if not closing and tag in _RAW:
            if tag in _RAW_TEXT:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, pos)
                pos = end.end() if end else n
            elif not m[3].rstrip().endswith("/"):
                skip, inner, held = tag, [], Counter()
            continue
        if tag == "a":
            link_depth = 0 if closing else 1
            continue
        if tag == "br" or tag == "hr" or tag in ("img", "input"):
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag != "img" else "")
            continue
        if tag not in _BLOCK or tag in _VOID:
            continue
        if closing:
            if opened[tag]:
                close_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            else:
                flush()
            link_depth = 0
            continue
        if tag in _ENDS_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close_to(i)
                    break
                if stack[i][0] not in ("", "label"):
                    break
        if tag in _GOES and any(opened[t] for t in _GOES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _ALONE[tag]:
                    break
                if stack[i][0] in _GOES[tag]:
                    close_to(i)
                    break
        flush()
        link_depth = 0
        kinds, near = stack[-1][2:]
        if tag in _SAYS:
            near = _SAYS[tag]
        if m[3] and "=" in m[3]:
            found = {_CLASS[w.lower()] for k, *v in _ATTR.findall(m[3]) if k.lower() in ("class", "id", "role", "aria-label", "itemprop") for w in _WORD.findall("".join(v)) if w.lower() in _CLASS}
            if found:
                kinds, near = kinds | found, frozenset(found)
        stack.append((tag, stack[-1][1] | {tag}, kinds, near))
        opened[tag] += 1
    flush()
    return out


_SYMBOL = re.compile("[|»›·•©→×]")
_LENGTHS = (8, 20, 45, 90, 180, 400)
NAMES = ["one", *(f"tag:{t}" for t in _TAGS), *(f"name:{k}" for k in _NAMES), *(f"long:{x}" for x in _LENGTHS), "links", "all links", "stops", "no stop", "symbols", "in body", "first", "last", "copyright", "in article", "bare", *(f"near:{k}" for k in _NAMES)]
_ORDER = {t: i + 1 for i, t in enumerate(_TAGS)}
_KIND = {k: i + 1 + len(_TAGS) for i, k in enumerate(_NAMES)}
_REST = 1 + len(_TAGS) + len(_NAMES)
_NEAR = len(NAMES) - len(_NAMES) - 1 - len(_TAGS)
_FIRST, _LAST = NAMES.index("first"), NAMES.index("last")


def features(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), len(NAMES)))
    x[:, 0] = 1
    for row, b in zip(x, page):
        for t in b.tags:
            if t in _ORDER:
                row[_ORDER[t]] = 1
        for k in b.classes:
            row[_KIND[k]] = 1
        for k in b.near:
            row[_NEAR + _KIND[k]] = 1
        size = len(b.text)
        for i, least in enumerate(_LENGTHS):
            row[_REST + i] = size >= least
        at = _REST + len(_LENGTHS)
        row[at] = b.links / size
        row[at + 1] = b.links > 0.8 * size
        row[at + 2] = min(4, b.text.count(". ") + b.text.count(", ")) / 4
        row[at + 3] = b.text[-1] not in ".!?:;\"'…。)"
        row[at + 4] = min(1, len(_SYMBOL.findall(b.text)) / 2)
        row[at + 5] = not b.tags - {"html", "body", "p", "b"}
        row[at + 8] = "©" in b.text or "all rights reserved" in b.text.lower()
        row[at + 9] = bool(b.tags & {"article", "main"}) or "main" in b.classes
        row[at + 10] = not b.tags & {"p", "li", "td", "h1", "h2", "h3", "h4", "blockquote", "pre", "dd"}
    if len(page):
        x[0, _FIRST] = x[-1, _LAST] = 1
    return x


class Crf:
    """Two labels (1: main text); state weights, transitions and start scores."""

    def __init__(self) -> None:
        self.w, self.t, self.s = np.zeros((len(NAMES), 2)), np.zeros((2, 2)), np.zeros(2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels, by Viterbi."""
        if not len(x):
            return np.zeros(0, int)
        e = (x @ self.w).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = e[0][0] + self.s[0], e[0][1] + self.s[1]
        back = []
        for e0, e1 in e[1:]:
            back.append((a + t00 < b + t10, a + t01 < b + t11))
            a, b = max(a + t00, b + t10) + e0, max(a + t01, b + t11) + e1
        y = [int(b > a)]
        for step in reversed(back):
            y.append(int(step[y[-1]]))
        return np.array(y[::-1])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of the labels and its derivatives, by forward and backward sums."""
        e, n = x @ self.w, len(x)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = e[0] + self.s
        for i in range(1, n):
            f[i] = np.logaddexp(f[i - 1, 0] + self.t[0], f[i - 1, 1] + self.t[1]) + e[i]
        for i in range(n - 2, -1, -1):
            v = b[i + 1] + e[i + 1]
            b[i] = np.logaddexp(self.t[:, 0] + v[0], self.t[:, 1] + v[1])
        z = np.logaddexp(*f[-1])
        p = np.exp(f + b - z)
        true = np.eye(2)[y]
        gt = np.zeros((2, 2))
        for i in range(1, n):
            gt[y[i - 1], y[i]] += 1
        if n > 1:
            gt -= np.exp(f[:-1, :, None] + self.t + (e[1:] + b[1:])[:, None, :] - z).sum(axis=0)
        like = e[np.arange(n), y].sum() + self.s[y[0]] + self.t[y[:-1], y[1:]].sum() - z
        return float(like), x.T @ (true - p), gt, true[0] - p[0]


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 60, ridge: float = 0.02, seed: int = 5) -> Crf:
    """Adaptive gradient ascent over shuffled batches of labelled pages."""
    m, rng = Crf(), random.Random(seed)
    data = [(features(p), np.array(y)) for p, y in pages if p]
    held = [np.full_like(v, 1e-3) for v in (m.w, m.t, m.s)]
    for _ in range(rounds):
        rng.shuffle(data)
        for i in range(0, len(data), 16):
            g = [np.zeros_like(v) for v in held]
            for x, y in data[i : i + 16]:
                for a, d in zip(g, m.gradient(x, y)[1:]):
                    a += d
            for v, a, h in zip((m.w, m.t, m.s), g, held):
                a -= ridge * v * 16
                h += a * a
                v += 0.3 * a / np.sqrt(h)
    return m


_MADE = re.compile(r"\x01(\d)")


def labelled_pages(n: int = 260, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Pages of varied layout; every text starts with a mark of its label, which is then taken out."""
    rng = random.Random(seed)
    syllables = "ta re mon vel is or und ka li pro sen der que ost ar in the of".split()

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.choice([1, 1, 2, 2, 3])))

    def sentence(least: int = 3, most: int = 18) -> str:
        s = " ".join(word() for _ in range(rng.randint(least, most)))
        return s.capitalize() + rng.choice([".", ".", ".", "?", "!"])

    def passage() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 1, 2, 3, 4, 6])))

    def label(k: int, s: str) -> str:
        return f"\x01{k}{s}"

    def phrase() -> str:
        return rng.choice([sentence(1, 6)[:-1], word().capitalize(), " ".join(word() for _ in range(rng.randint(1, 4)))])

    def links(k: int, sep: str = "") -> str:
        one = lambda: f'<a href="/{word()}">{label(0, phrase())}</a>'
        kind = rng.randrange(3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(k)) + "</ul>"
        return (" | " if kind == 1 else " ").join(one() for _ in range(k))

    def attr(*options: str) -> str:
        v = rng.choice([*options, ""])
        return f' {rng.choice(["class", "id"])}="{v}"' if v else ""

    def menu() -> str:
        tag = rng.choice(["nav", "nav", "div", "ul"])
        a = attr("nav", "main-menu", "navbar", "topnav") if tag == "nav" else f' class="{rng.choice(["nav", "menu", "navigation", "breadcrumbs"])}"'
        return f"<{tag}{a}>{links(rng.randint(2, 9))}</{tag}>"

    def advert() -> str:
        return f'<div {rng.choice(["class", "id"])}="{rng.choice(["ad", "ads", "ad-box", "advert", "sponsored", "promo", "banner ad"])}">{label(0, rng.choice([sentence(), passage(), phrase()]))}</div>'

    def notice() -> str:
        a = rng.choice(["cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "newsletter-signup", "popup", "paywall"])
        tag = rng.choice(["div", "div", "section", "aside", "dialog"])
        return f'<{tag} {rng.choice(["class", "id"])}="{a}"><p>{label(0, passage())}</p>' + (f"<button>{label(0, phrase())}</button>" if rng.random() < 0.6 else "") + f"</{tag}>"

    def sidebar() -> str:
        tag = rng.choice(["aside", "aside", "div"])
        a = attr("sidebar", "related", "widget") if tag == "aside" else f' class="{rng.choice(["sidebar", "related", "side-bar widget", "right-rail"])}"'
        return f"<{tag}{a}><h3>{label(0, phrase())}</h3>{rng.choice([links(rng.randint(2, 5)), f'<p>{label(0, passage())}</p>'])}</{tag}>"

    def form() -> str:
        return f'<form action="/s"><label>{label(0, phrase())}</label><input name="q"><select><option>{label(0, word())}<option>{label(0, word())}</select><button>{label(0, phrase())}</button></form>'

    def comments() -> str:
        tag, each = rng.choice(["div", "section", "ol"]), rng.choice(["div", "li", "article", "p"])
        one = lambda: f'<{each} class="{rng.choice(["comment", "reply", "comment-body", ""])}">{rng.choice(["", f"<b>{label(0, phrase())}</b>"])}<p>{label(0, passage())}</p></{each}>'
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "responses"])}"><h3>{label(0, phrase())}</h3>{"".join(one() for _ in range(rng.randint(1, 5)))}</{tag}>'

    def footer() -> str:
        tag, a = ("footer", attr("footer", "site-footer")) if rng.random() < 0.75 else ("div", f' class="{rng.choice(["footer", "site-footer", "bottom legal"])}"')
        return f"<{tag}{a}>{label(0, rng.choice(['&copy; ' + word() + '.example &middot; ' + sentence(), passage(), 'Copyright ' + phrase()]))}{rng.choice(['', links(3)])}</{tag}>"

    def header() -> str:
        tag, a = ("header", attr("header", "site-header")) if rng.random() < 0.75 else ("div", f' class="{rng.choice(["header", "masthead", "site-header"])}"')
        return f"<{tag}{a}>{rng.choice([f'<h1>{label(0, phrase())}</h1>', f'<p>{label(0, sentence())}</p>', label(0, phrase())])}{rng.choice(['', menu()])}</{tag}>"

    def body() -> str:
        if rng.random() < 0.12:
            return f"<h1>{label(1, phrase())}</h1>" * (rng.random() < 0.7) + label(1, passage()) + "<br><br>".join(["", *(passage() for _ in range(rng.randint(0, 4)))])
        out = [f"<{t}>{label(1, phrase())}</{t}>" for t in [rng.choice(["h1", "h1", "h2"])] if rng.random() < 0.9]
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            if rng.random() < 0.06:
                out.append(rng.choice([advert, advert, notice, form, sidebar])())
            elif kind < 0.6:
                out.append(f"<p>{label(1, passage())}" + "</p>" * (rng.random() < 0.8))
            elif kind < 0.68:
                out.append(f"<p><b>{label(1, sentence())}<br>")
            elif kind < 0.76:
                out.append(f"<h{(k := rng.choice('234'))}>{label(1, phrase())}</h{k}>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{label(1, rng.choice([phrase(), sentence()]))}" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{label(1, passage())}</blockquote>")
            elif kind < 0.88:
                out.append(f"<div>{label(1, passage())}</div>")
            elif kind < 0.90:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{label(1, word())}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.92:
                out.append(f'<p>{label(1, sentence())} <a href="/x">{phrase()}</a> {sentence()}</p>')
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{label(1, sentence())}</figcaption></figure>")
            else:
                out.append(f"<pre>{label(1, sentence())}</pre>")
        return "".join(out)

    made = []
    while len(made) < n:
        open_, close = rng.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post">', "</div></div>"), ('<div class="article-body">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), ("", "")])
        before = [f() for f in (header, menu, notice, advert, form) if rng.random() < 0.45]
        after = [f() for f in (advert, comments, sidebar, form, notice, footer) if rng.random() < 0.45]
        rng.shuffle(before)
        if rng.random() < 0.2:
            before.append(sidebar())
        inner = body() + (comments() if rng.random() < 0.1 else "")
        page = f"<html><head><title>{word()}</title></head><body>{''.join(before)}{open_}{inner}{close}{''.join(after)}</body></html>"
        cut = blocks(page)
        labels = [int(m[1]) if (m := _MADE.match(b.text)) else 0 for b in cut]
        for b in cut:
            b.text = _MADE.sub("", b.text) or "x"
            b.links = min(b.links, len(b.text))
        made.append((cut, labels))
    return made


_fitted: list[Crf] = []


def default_model() -> Crf:
    """The model fitted on the labelled pages; the same on every machine, since they come from a seed."""
    if not _fitted:
        _fitted.append(fit(labelled_pages()))
    return _fitted[0]


def main_text(html: str | None, model: Crf) -> str:
    page = blocks(html)
    return " ".join(b.text for b, y in zip(page, model.decode(features(page))) if y)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """``page_id, url, html`` → ``page_id, url, text, n_chars``."""
    bound_batches(pages.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), model) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
