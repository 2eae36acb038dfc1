"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every text block is a variable with three labels: frame (holds content and other
things), boilerplate, content. Unary potentials come from a node's tag, its class, id and role words, the length and
share of link text and the form controls below it, and a block's last mark; pair potentials tie each node to its parent. The
tree has no loops, so one upward and one downward sweep of sum-product messages give exact
marginals; the blocks whose content marginal exceeds one half are the page's text. Potentials are estimated by
counting over labelled pages (see `labelled_pages`).
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import prepare

FRAME, BOILERPLATE, CONTENT = LABELS = range(3)
LETTERS = "fbc"  # in the attribute data-y of labelled pages

# Elements that run on inside a block; all others begin one.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes noscript iframe template".split())
CONTROLS = frozenset("button input select option textarea label".split())
#: Elements without a meaning of their own, in which controls are a sign of notices.
BOXES = frozenset("div section dialog p aside td".split())
#: Raw elements whose text is never a block.
SILENT = RAW - {"textarea", "title"}
#: What the start of the first closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Closing stops here.
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^ \t\n\f\r>]*+))?+)*+)>"""
    r"|(?P<cut><)(?=/?[A-Za-z])",
    re.S,
)
#: The same but for quotes, which do not keep a tag open. Used from the first tag on that no > ends.
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>[^>]*)(?:>|\Z)", re.S)
#: One attribute after the other, each from its start: a name, and a value if there is one.
ATTRIBUTE = re.compile(r"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+("[^"]*+"|'[^']*+'|[^ \t\n\f\r>]*+))?+""")
NAMING = frozenset(("class", "id", "role"))
NAME_WORD = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Nodes in page order; a node's parent comes before it. Node 0 stands for the document."""

    parent: list[int] = field(default_factory=lambda: [-1])
    features: list[tuple[str, ...]] = field(default_factory=lambda: [("tag:document",)])
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, text)
    labels: list[int | None] = field(default_factory=lambda: [FRAME])


class _Open:
    """Elements that are open, from the outermost on, and where each name is among them."""

    def __init__(self):
        self.names, self.nodes, self.places = [""], [0], defaultdict(list)

    def push(self, name: str, node: int) -> None:
        self.places[name].append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def close_to(self, depth: int) -> None:
        """Close what is open from that depth on."""
        while len(self.names) > depth:
            self.places[self.names.pop()].pop()
            self.nodes.pop()

    def last(self, names: Iterable[str]) -> int:
        """Depth of the innermost element with one of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)


def parse(source: str, labelled: bool = False) -> Page:
    """Block elements and text blocks; unclosed, misnested and cut-off markup is taken as it comes. Time is linear in the page.

    labelled: data-y gives an element's label; on other pages it is an attribute like any other.
    """
    page = Page()
    stack = _Open()
    texts: list[str] = []
    sizes, linked_sizes, controls = [0], [0], [False]  # by node: text below it, of that in links, form controls
    linked = in_link = 0
    markup = MARKUP

    def add(words: tuple[str, ...], label: int | None, size: int = 0, in_links: int = 0) -> int:
        page.parent.append(stack.nodes[-1])
        page.features.append(words)
        page.labels.append(label)
        sizes.append(size)
        linked_sizes.append(in_links)
        controls.append(words[0][4:] in CONTROLS)
        return len(page.parent) - 1

    def flush() -> None:
        nonlocal linked, in_link
        if texts:
            whole = html.unescape("".join(texts)) if any("&" in t for t in texts) else "".join(texts)
            text = " ".join(whole.split())
            if text:
                mark = "stop" if text[-1] in ".!?" else "other" if not text[-1].isalnum() else "none"
                page.blocks.append((add(("tag:#text", f"end:{mark}"), None, len(text), min(linked, len(text))), text))
            texts.clear()
        linked = in_link = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            texts.append(text)
            if in_link:
                linked += len(text)

    at = 0
    while at < len(source):
        found = markup.search(source, at)
        if found and markup is MARKUP and found["cut"]:
            markup = PLAIN
            continue
        if not found:
            say(source[at:])
            break
        say(source[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        closing = bool(found["end"])
        if name in INLINE:
            if name == "br":
                say(" ")
            elif name == "a":
                in_link = int(not closing)
            continue
        flush()
        if closing:
            if stack.places.get(name):
                stack.close_to(stack.places[name][-1])
            continue
        if name in CLOSES:
            depth = stack.last(CLOSES[name])
            if depth > stack.last(BARRIER.get(name, ("table",))):
                stack.close_to(depth)
                while len(stack.names) > 1 and stack.names[-1] in CLOSES[name]:
                    stack.close_to(len(stack.names) - 1)
        depth = stack.last(("p",))
        if depth and depth >= len(stack.names) - 3:
            stack.close_to(depth)
        attrs = found["attrs"]
        words, label = [f"tag:{name}"], None
        if attrs and ("=" in attrs):
            for key, value in ATTRIBUTE.findall(attrs):
                key = key.lower()
                if key in NAMING:
                    words += (f"name:{w}" for w in NAME_WORD.findall(value.lower()))
                elif labelled and key == "data-y":
                    label = LETTERS.index(value.strip("\"'"))
        if len(words) == 1:
            words.append("name:")
        node = add(tuple(dict.fromkeys(words)), label)
        if name in VOID or attrs.endswith("/") and name not in ("p", "div"):
            continue
        stack.push(name, node)
        if name in RAW:
            stop = re.compile(f"</{name}", re.I).search(source, at)
            end = stop.start() if stop else len(source)
            if name not in SILENT:
                say(source[at:end])
            at = end
    flush()
    children = [0] * len(page.parent)
    for node in range(len(page.parent) - 1, 0, -1):
        parent = page.parent[node]
        children[parent] += 1
        sizes[parent] += sizes[node]
        linked_sizes[parent] += linked_sizes[node]
        controls[parent] |= controls[node]
    for node, (size, in_links) in enumerate(zip(sizes, linked_sizes)):
        text = page.features[node][0] == "tag:#text"
        if text or children[node] > 1:  # what an only child says is not said again
            kind = "block" if text else "below"
            links = "none" if not in_links else "some" if 2 * in_links < size else "most"
            page.features[node] += (f"{kind}:{min(size.bit_length(), 10)}", f"{kind}links:{links}")
        if page.features[node][0][4:] in BOXES:  # below a long text it says nothing that a control is there
            page.features[node] += (f"controls:{size < 200 and controls[node]}",)
    return page


# --- the model --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """unary: likelihood of a feature by label; step[kind][parent's label][label], kind 1 for text."""

    unary: dict[str, tuple[float, float, float]]
    step: tuple[tuple[tuple[float, ...], ...], tuple[tuple[float, ...], ...]]


def train(pages: Iterable[str]) -> Model:
    """Counts over pages whose elements carry data-y; an element without one has its parent's label."""
    seen: dict[str, Counter] = defaultdict(Counter)
    totals: dict[str, Counter] = defaultdict(Counter)
    steps = [[[0.2] * 3 for _ in LABELS] for _ in range(2)]
    for source in pages:
        page = parse(source, labelled=True)
        labels: list[int] = []
        for node, own in enumerate(page.labels):
            label = own if own is not None else labels[page.parent[node]]
            text = page.features[node][0] == "tag:#text"
            if text and label == FRAME:
                label = BOILERPLATE
            labels.append(label)
            if node:
                steps[text][labels[page.parent[node]]][label] += 1
            for name in page.features[node]:
                seen[name][label] += 1
                totals[name.split(":")[0]][label] += 1
    unary = {name: tuple((counts[y] + 0.5) / (totals[name.split(":")[0]][y] + 50) for y in LABELS) for name, counts in seen.items()}
    for y in LABELS:
        steps[1][y][FRAME] = 1e-6
    return Model(unary, tuple(tuple(tuple(v / sum(row) for v in row) for row in kind) for kind in steps))


def content_marginals(page: Page, model: Model) -> list[float]:
    """Of each node, by one upward and one downward sweep."""
    n, unary = len(page.parent), model.unary
    own: list[list[float]] = []
    for names in page.features:
        f = b = c = 1.0
        for name in names:
            if name in unary:
                x, y, z = unary[name]
                f, b, c = f * x, b * y, c * z
                top = max(f, b, c)
                f, b, c = f / top, b / top, c / top
        own.append([f, b, c])
    up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
    for v in range(n - 1, 0, -1):
        f, b, c = own[v]
        top = f + b + c
        own[v] = [f / top, b / top, c / top]
        f, b, c = own[v]
        m = tuple(row[0] * f + row[1] * b + row[2] * c for row in model.step[page.features[v][0] == "tag:#text"])
        up[v] = m
        to = own[page.parent[v]]
        to[0] *= m[0]
        to[1] *= m[1]
        to[2] *= m[2]
        top = to[0] + to[1] + to[2]
        if top < 1e-200:
            to[:] = [x / top for x in to]
    out = [0.0] * n
    belief: list[tuple[float, float, float]] = []
    for v in range(n):
        f, b, c = own[v]
        if v:
            pf, pb, pc = belief[page.parent[v]]
            mf, mb, mc = up[v]
            pf, pb, pc = pf / mf, pb / mb, pc / mc
            (ff, fb, fc), (bf, bb, bc), (cf, cb, cc) = model.step[page.features[v][0] == "tag:#text"]
            f, b, c = f * (pf * ff + pb * bf + pc * cf), b * (pf * fb + pb * bb + pc * cb), c * (pf * fc + pb * bc + pc * cc)
        top = f + b + c
        belief.append((f / top, b / top, c / top))
        out[v] = c / top
    return out


def main_text(source: str, model: Model) -> str:
    """Content blocks in page order, one a line; empty if there are none."""
    page = parse(source)
    if not page.blocks:
        return ""
    marginals = content_marginals(page, model)
    return "\n".join(text for node, text in page.blocks if marginals[node] > 0.5)


# --- labelled pages -----------------------------------------------------------------------------------


#: Parts of link-rich content among the kinds that an article of a training page is drawn from.
LINKED_PARTS = 3


def labelled_pages(count: int = 1500, seed: int = 11) -> Iterator[str]:
    """Pages made up from common layouts, each element's label in data-y where it differs from its parent's.

    A share of all names is made up, or left out, so that the model learns to tell parts by structure, too.
    """
    rng = random.Random(seed)
    pick = rng.choice

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick("aeioubcdlmnrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high)))

    def some(*makers):
        return pick(makers)()

    def named(*names: str, known: float = 0.7) -> str:
        name = pick(names) if rng.random() < known else words(1, 1)
        return pick(("", f' class="{name}"', f' class="{name}"', f' id="{name}"', f' class="{pick("abxyz")}{rng.randint(1, 99)} {name}"', f' id="{name}" class="{name}-wrap"', f' class="{name} block"'))

    def links(n: int) -> str:
        return some(
            lambda: "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>",
            lambda: "<ul>" + "".join(f"<li><a href=/{k}>{words(1, 3)}</a>" for k in range(n)) + "</ul>",
            lambda: pick((" | ", " ", " &middot; ")).join(f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(n)),
            lambda: "".join(f"<div><a href=/{k}>{words(1, 2)}</a></div>" for k in range(n)),
        )

    def paragraph() -> str:
        body = words(*pick(((1, 2), (1, 6), (5, 30), (20, 120), (20, 120), (60, 200))))
        return some(lambda: f"<p>{body}.</p>", lambda: f"<p>{body}.</p>", lambda: f"<p>{body}</p>", lambda: f"<p>{body}, <a href='/x'>{words(1, 4)}</a> {words(2, 9)}.", lambda: f"<p><b>{body}.<br>", lambda: f"<p{named('lead', 'intro', 'dropcap', 'text', 'summary')}>{body}.</p>")

    def sources() -> str:
        """What an article refers to: longer than a menu's entries, and without a name."""
        n, low = rng.randint(1, 6), pick((1, 2, 3))
        return some(
            lambda: "<ul>" + "".join(f'<li><a href="/{k}">{words(low, 9)}</a>{pick(("", "", f", {words(1, 4)}"))}{pick(("", "</li>"))}' for k in range(n)) + "</ul>",
            lambda: "<ol>" + "".join(f'<li><a href="/{k}">{words(low, 9)}</a></li>' for k in range(n)) + "</ol>",
            lambda: "<ul>" + "".join(f"<li>{words(1, 6)} <a href=/{k}>{words(1, 4)}</a></li>" for k in range(n)) + "</ul>",
        )

    def linked() -> str:
        """Content that is a link, or mostly."""
        body = words(*pick(((3, 9), (5, 25), (10, 40))))
        return some(
            lambda: f'<p><a href="/{words(1, 1)}">{body}.</a></p>', lambda: f"<p><a href=/x>{body}</a>.</p>", lambda: f"<p>{words(1, 5)} <a href='/x'>{body}</a>.</p>", lambda: f"<p><a href=/x>{body}</a> {words(1, 6)}.</p>",
            lambda: f'<h{(k := rng.randint(2, 4))}><a href="/{words(1, 1)}">{words(1, 6)}</a></h{k}>', lambda: f"<blockquote><a href=/q>{body}.</a></blockquote>", lambda: f"<figure><img src=x><figcaption><a href=/f>{words(2, 9)}</a></figcaption></figure>",
            lambda: "<dl>" + "".join(f"<dt><a href=/{k}>{words(1, 2)}</a><dd>{words(2, 15)}." for k in range(rng.randint(1, 4))) + "</dl>",
            lambda: "<table>" + "".join(f"<tr><td><a href=/{k}>{words(1, 3)}</a></td><td>{words(1, 4)}</td></tr>" for k in range(rng.randint(1, 4))) + "</table>",
            lambda: f"<h{(k := rng.randint(2, 4))}>{words(1, 3)}</h{k}>{sources()}", sources,
        )

    def part() -> str:
        return some(
            paragraph, paragraph, paragraph, paragraph, paragraph, *[linked] * LINKED_PARTS,
            lambda: f"<h{(k := rng.randint(2, 4))}>{words(1, 8)}</h{k}>",
            lambda: "<ul>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>",
            lambda: "<ul>" + "".join(f"<li>{words(1, 2)}{pick(('', '</li>'))}" for _ in range(rng.randint(1, 6))) + "</ul>",
            lambda: f"<ol><li>{words(1, 12)}<li>{words(3, 12)}</ol>",
            lambda: f"<blockquote><p>{words(5, 40)}.</p></blockquote>",
            lambda: f"<pre>{words(3, 30)}</pre>",
            lambda: "<dl>" + "".join(f"<dt>{words(1, 3)}<dd>{words(2, 15)}." for _ in range(rng.randint(1, 4))) + "</dl>",
            lambda: "<table>" + "".join(f"<tr><th>{words(1, 2)}</th><td>{words(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>",
            lambda: f"<figure><img src=x><figcaption>{words(2, 12)}</figcaption></figure>",
            lambda: f"<div><p>{words(5, 60)}.</p></div>",
            lambda: f"<section><h2>{words(1, 5)}</h2><p>{words(5, 60)}.</p><p>{words(5, 60)}.</p></section>",
        )

    def nav() -> str:
        tag = pick(("nav", "nav", "div", "ul", "section"))
        if tag == "ul":
            return f'<ul data-y="b"{named("menu", "nav", "navbar", "breadcrumb", "navigation")}>' + "".join(f"<li><a href=/{k}>{words(1, 2)}</a></li>" for k in range(rng.randint(2, 9))) + "</ul>"
        return f'<{tag} data-y="b"{named("nav", "menu", "navbar", "main-nav", "breadcrumbs", "pagination", "navigation", "topbar", "toolbar", "skip")}>{links(rng.randint(2, 9))}</{tag}>'

    def header() -> str:
        tag = pick(("header", "header", "div"))
        inner = some(lambda: f"<h1>{words(1, 3)}</h1>", lambda: f"<p>{words(1, 12)}</p>", lambda: f"<a href=/>{words(1, 2)}</a>", lambda: f"<h1>{words(1, 3)}</h1><p>{words(2, 8)}</p>", lambda: f"<a href=/>{words(1, 2)}</a>{nav()}")
        return f'<{tag} data-y="b"{named("header", "site-header", "masthead", "banner", "branding", "logo", "tagline", known=0.9)}>{pick((inner, f"<div>{inner}</div>"))}</{tag}>'

    def footer() -> str:
        tag = pick(("footer", "footer", "div"))
        inner = some(lambda: f"&copy; {words(1, 2)} &middot; {words(2, 15)}.", lambda: f"<p>&copy; {words(2, 20)}</p>", lambda: links(4), lambda: f"<div><p>{words(2, 9)}</p>{links(2)}</div>", lambda: f"<p>&copy; {rng.randint(1990, 2030)} {words(1, 3)}. {words(2, 6)}.</p>")
        return f'<{tag} data-y="b"{named("footer", "site-footer", "copyright", "legal", "colophon", "bottom", "imprint", known=0.9)}>{inner}</{tag}>'

    def side() -> str:
        tag = pick(("aside", "aside", "aside", "div", "section"))
        names = ("sidebar", "aside", "widget", "related", "recommended", "side", "rail", "trending", "popular", "tags", "author-box", "share", "social", "more", "tools")
        inner = some(lambda: links(5), lambda: f"<h3>{words(1, 4)}</h3>{links(3)}", lambda: f"<h3>{words(1, 4)}</h3>{links(6)}")
        if rng.random() < 0.4:  # without links its name or tag tells it
            return f'<{tag} data-y="b" class="{pick(names)}">{pick((f"<p>{words(5, 50)}</p>", f"<h4>{words(1, 3)}</h4><p>{words(3, 25)}</p>"))}</{tag}>'
        return f'<{tag} data-y="b"{named(*names)}>{inner}</{tag}>'

    def notice() -> str:
        tag = pick(("div", "div", "section", "dialog", "p"))
        names = ("cookie", "cookie-banner", "consent", "notice", "alert", "newsletter", "subscribe", "popup", "modal", "paywall", "gdpr", "privacy", "message", "warning", "signup", "datenschutz", "hinweis", "aviso", "avertissement")
        how = pick((f' class="{pick(names)}"', f' id="{pick(names)}"', f' id="{pick(names)}-bar" class="{words(1, 1)}"', " role=alert", " role=dialog"))
        if tag != "p" and rng.random() < 0.35:  # a button tells it
            return f'<{tag} data-y="b"{named("bar", "box", "overlay", "layer", known=0.3)}>{pick((words(3, 30) + ".", f"<p>{words(3, 30)}.</p>", f"<span>{words(3, 20)}</span>"))} <button>{words(1, 2)}</button>{pick(("", f"<button>{words(1, 2)}</button>"))}</{tag}>'
        return f'<{tag} data-y="b"{how}>{words(3, 40)}{"" if tag == "p" else pick(("", f"<button>{words(1, 2)}</button>", f"<p>{words(3, 20)}</p>"))}</{tag}>'

    def advert() -> str:
        tag = pick(("div", "div", "div", "section", "aside"))
        return f'<{tag} data-y="b" {pick(("class", "id"))}="{pick(("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "banner", "ad-slot", "commercial", "anzeige", "werbung"))}">{pick((words(3, 30) + ".", f"<p>{words(3, 40)}.</p>", f"<a href=/b>{words(2, 9)}</a>", f"<div><h3>{words(2, 5)}</h3><p>{words(3, 20)}</p></div>"))}</{tag}>'

    def form() -> str:
        return f'<form data-y="b"{named("form", "search", "login", "contact", "search-form", "signup")}><label>{words(1, 3)}</label><input name=q>{pick(("", f"<select><option>{words(1, 2)}<option>{words(1, 2)}</select>", f"<textarea>{words(0, 5)}</textarea>", f"<fieldset><legend>{words(1, 2)}</legend><p>{words(2, 9)}</p></fieldset>"))}<button>{words(1, 2)}</button></form>'

    def control() -> str:
        return some(
            lambda: f'<button data-y="b"{named("share", "like", "print", "btn")}>{words(1, 3)}</button>',
            lambda: '<select data-y="b">' + "".join(f"<option>{words(1, 2)}" for _ in range(rng.randint(1, 5))) + "</select>",
            lambda: f'<div data-y="b"{named("share", "toolbar", "actions", "buttons")}><button>{words(1, 2)}</button><button>{words(1, 2)}</button></div>',
            lambda: f'<label data-y="b">{words(1, 3)}<input type=checkbox></label>',
        )

    def comments() -> str:
        tag = pick(("section", "div", "ol", "aside"))
        inner = pick(("div", "div", "div", "li", "section", "article")) if tag != "ol" else "li"
        outer, single = pick((("comments", "comment"), ("comment-list", "comment"), ("discussion", "post"), ("responses", "response"), ("disqus", "reply"), ("replies", "reply"), ("reader-comments", "comment-body"), ("thread", "message")))

        def one() -> str:
            return f'<{inner} class="{single}">{some(lambda: f"<h5>{words(1, 2)}</h5>", lambda: f"<header>{words(1, 2)}</header>", lambda: "", lambda: f"<cite>{words(1, 2)}</cite>")}<p>{words(2, 60)}.</p>{pick(("", f"<button>{words(1, 1)}</button>", f"<a href=#>{words(1, 1)}</a>"))}</{inner}>'

        return f'<{tag} data-y="b" {pick(("class", "id"))}="{outer}">{"" if tag == "ol" else pick((f"<h2>{words(1, 3)}</h2>", ""))}{"".join(one() for _ in range(rng.randint(1, 5)))}{pick(("", "" if tag == "ol" else form()))}</{tag}>'

    other = (nav, header, footer, side, notice, advert, form, comments)
    for _ in range(count):
        brief = rng.random() < 0.35
        inside = [f"<p>{words(6, 25)}.</p>" if brief else part() for _ in range(rng.randint(1, 2) if brief else rng.randint(1, 14))]
        if rng.random() < 0.8:
            inside.insert(0, f"<h1>{words(1, 12)}</h1>" if rng.random() < 0.7 else f"<h1><a href=/self>{words(1, 9)}</a></h1>" if rng.random() < 0.5 else f"<header><h1>{words(1, 12)}</h1><p>{words(1, 6)}</p></header>")
        for make in (advert, side, notice, form, control, control):
            if rng.random() < (0.35 if make is control and brief else 0.08):
                inside.insert(rng.randint(1, len(inside)), make())
        if rng.random() < 0.2:
            inside.append(comments())
        before = [f() for f in rng.sample((nav, header, advert, notice, form), rng.randint(0, 4))]
        after = [f() for f in rng.sample(other, rng.randint(0, 5))]
        layout = rng.random()
        if layout < 0.7:
            tag = pick(("article", "article", "article", "main", "div", "div", "section"))
            core = f'<{tag} data-y="c"{named("article", "content", "post", "entry", "entry-content", "main", "story", "article-body", "post-body", "text", "body-text", "main-content")}>{"".join(inside)}</{tag}>'
        elif layout < 0.85:  # a table holds the page together
            menu = f'<td data-y="b"{named("nav", "left", "menu")}>{links(rng.randint(3, 9))}</td>'
            cells = [menu, f'<td data-y="c"{named("content", "main", "body")}>{"".join(inside)}</td>']
            core = f'<table data-y="f"{pick(("", " width=100%", " id=layout"))}><tr>{"".join(cells if rng.random() < 0.7 else cells[::-1])}</tr></table>'
        else:  # no element of its own
            core = f'<div data-y="c">{"".join(inside)}</div>' if rng.random() < 0.6 else "".join(re.sub(r"^<(?![^>]*data-y)(\w+)", r'<\1 data-y="c"', i) for i in inside)
        middle = f'{"".join(before)}{core}{"".join(after)}'
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.5:
                wrap = pick(("div", "div", "main", "section"))
                middle = f'{pick(("", nav(), header()))}<{wrap} data-y="f"{named("container", "wrapper", "page", "row", "layout", "site", "wrap", "main", "columns")}>{middle}</{wrap}>{pick(("", footer(), side()))}'
        yield f'<!DOCTYPE html><html data-y="f"><head data-y="b"><meta charset="utf-8"><title>{words(1, 12)}</title><style>p{{}}</style><script>track(0)</script></head><body data-y="f">{middle}{pick(("</body></html>", ""))}'


@cache
def default_model() -> Model:
    return train(labelled_pages())


# --- over a table ------------------------------------------------------------------------------------


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source or "", model) for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html, any more): page_id, url, text, n_chars.

    References are decoded, white space inside a block becomes one space, blocks are joined by one line
    break. Null or empty html, and a page without content, give an empty text. A null page_id or url stays. Rows that repeat
    are read one by one. A page of any length is read whole, in time linear in it.
    """
    prepare(pages.sparkSession)
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return known.mapInArrow(_extract(model or default_model()), "page_id long, url string, text string, n_chars long")
