"""HTML extraction: a tree-structured graphical model over the DOM.

Every block element and every run of text is a node with two states, content or not. A
node's features give its own potential; each parent and child share a potential that depends
on the kind of parent. Sum-product messages go up from the leaves and down from the root,
which gives every node's exact marginal; a page's text is its runs of text whose marginal is
over one half. Weights are trained from labelled pages by the likelihood's gradient.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import small_batches

#: Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
SILENT = frozenset("head title script style noscript template svg iframe select textarea option datalist".split())
#: Elements that leave an open head open; the start of any other ends it.
IN_HEAD = frozenset("base link meta title script style noscript template".split())
BLOCK = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset aside nav header footer details summary address center dialog hgroup menu".split()
)
#: Blocks whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("html head body tr td th thead tbody tfoot caption summary".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BARS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|"""
    r"""</?([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|[^'">]|["'](?=[^<>]*>))*+)(?:>|$)""",
    re.S,
)
#: A tag whose quotes don't add up ends at the next `>`.
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")
#: Words in class, id and role that the model may use; each is a feature.
HINTS = (
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar menu breadcrumb sidebar side aside widget related recommended "
    "comment comments reply replies thread disqus discussion footer header masthead cookie notice consent alert popup modal share social subscribe newsletter signup login "
    "search pagination tags toolbar article content main post entry story body text page"
).split()
_HINT = {h: i for i, h in enumerate(HINTS)}
TAGS = (
    "#text html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl table tr td blockquote pre figure figcaption form fieldset aside nav "
    "header footer details address menu dialog other"
).split()
_TAG = {t: i for i, t in enumerate(TAGS)}
#: Kinds of parents, each with a potential of its own.
PARENTS = ("other", "article", "main", "body", "nav", "aside", "header", "footer", "form", "list", "hinted off", "hinted on")
OFF = frozenset(HINTS[: HINTS.index("article")])
WIDTH = len(TAGS) + len(HINTS) + 6


@dataclass
class Node:
    tag: str
    parent: int
    hints: frozenset[str] = frozenset()
    text: str = ""
    links: int = 0
    children: list[int] = field(default_factory=list)


def parse(source: str) -> list[Node]:
    """The block tree of a page, in page order: block elements and runs of text (#text).

    Inline elements and line breaks belong to the text around them; scripts, styles, comments and
    form controls give no text. Broken markup is read as far as it goes: an end tag
    without its start is skipped, and elements left open end with their parent. A head left
    open ends, as in HTML, at body, at text or at an element that can't stand in it; a
    title is read up to its end tag, or ends with the head where it has none.
    """
    nodes = [Node("html", -1)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones carry their block's node
    parts: list[str] = []
    linked = at = silent = anchors = 0
    opened: dict[str, list[int]] = {}  # places in the stack of each element's open tags

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            owner = stack[-1][1]
            nodes[owner].children.append(len(nodes))
            nodes.append(Node("#text", owner, text=text, links=min(linked, len(text))))
        parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and text.strip():
            pop(len(stack) - 1)
        if text and not silent:
            parts.append(text)
            if anchors:
                linked += len(text)

    def pop(until: int) -> None:
        nonlocal silent, anchors
        for tag, _ in stack[until:]:
            silent -= tag in SILENT
            anchors -= tag == "a"
            opened[tag].pop()
        del stack[until:]

    def push(tag: str, owner: int) -> None:
        nonlocal silent, anchors
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, owner))
        silent += tag in SILENT
        anchors += tag == "a"

    while at < len(source):
        begin = source.find("<", at)
        if begin < 0:
            put(source[at:])
            break
        put(source[at:begin])
        token = _TOKEN.match(source, begin) or _LOOSE.match(source, begin)
        if not token:
            put("<")
            at = begin + 1
            continue
        at = token.end()
        if not token[1]:
            continue
        tag, closing = token[1].lower(), source[begin + 1] == "/"
        if closing:
            place = opened[tag][-1] if opened.get(tag) else 0
            if place:
                if any(t in BLOCK for t, _ in stack[place:]):
                    flush()
                pop(place)
            continue
        head = opened["head"][0] if opened.get("head") else 0
        if tag in ("head", "html") and (head or opened.get("body")):
            continue
        if head and tag not in IN_HEAD:
            held = [t for t, _ in stack[head + 1 :] if t in ("noscript", "template")]
            if not held or tag == "body" and "template" not in held:
                pop(head)
        if tag == "title" and not opened.get("svg"):
            end, another = (re.compile(x, re.I).search(source, at) for x in (r"</title[^>]*(?:>|$)", r"<title[\s/>]"))
            if end and not (another and another.start() < end.start()):
                at = end.end()
                continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*(?:>|$)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in VOID:
            put(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P and opened.get("p"):
                pop(opened["p"][-1])
            last = lambda tags: max((opened[t][-1] for t in tags if opened.get(t)), default=0)
            place = last(CLOSES.get(tag, ()))
            if place > last(BARS.get(tag, ())):
                pop(place)
            while len(stack) > 1 and stack[-1][0] not in BLOCK and stack[-1][0] not in SILENT:  # inline elements end with a block's start
                pop(len(stack) - 1)
            owner = stack[-1][1]
            hints = frozenset(w for _, v in _ATTRIBUTE.findall(token[2]) for w in re.findall(r"[a-z]+", v.lower()) if w in _HINT)
            nodes[owner].children.append(len(nodes))
            push(tag, len(nodes))
            nodes.append(Node(tag, owner, hints))
        else:
            push(tag, stack[-1][1])
    flush()
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """A row per node: its tag, its hints, and of text length, share of links and end of sentence."""
    x = np.zeros((len(nodes), WIDTH))
    for i, node in enumerate(nodes):
        x[i, _TAG.get(node.tag, len(TAGS) - 1)] = 1
        for h in node.hints:
            x[i, len(TAGS) + _HINT[h]] = 1
        if node.tag == "#text":
            x[i, -6:] = [1, min(len(node.text), 400) / 400, len(node.text) < 25, node.links / len(node.text), node.links == len(node.text), node.text[-1] in ".!?"]
    return x


def parent_kind(node: Node) -> int:
    if node.hints & OFF:
        return PARENTS.index("hinted off")
    if node.hints:
        return PARENTS.index("hinted on")
    if node.tag in ("ul", "ol", "menu", "dl"):
        return PARENTS.index("list")
    return PARENTS.index(node.tag) if node.tag in PARENTS else 0


@dataclass
class Model:
    """own: weights of a node's features for content; pair[kind]: log potentials of parent's and child's states."""

    own: np.ndarray
    pair: np.ndarray


def _scores(nodes: list[Node], own: list[float]) -> list[float]:
    """features(nodes) @ own, without the matrix."""
    hints, tail, out = len(TAGS), len(TAGS) + len(HINTS), []
    for node in nodes:
        score = own[_TAG.get(node.tag, len(TAGS) - 1)]
        for h in node.hints:
            score += own[hints + _HINT[h]]
        if node.tag == "#text":
            n = len(node.text)
            score += own[tail] + own[tail + 1] * min(n, 400) / 400 + own[tail + 2] * (n < 25) + own[tail + 3] * node.links / n
            score += own[tail + 4] * (node.links == n) + own[tail + 5] * (node.text[-1] in ".!?")
        out.append(score)
    return out


def marginals(nodes: list[Node], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals by sum-product: each node's probability of content, each edge's 2 x 2 table (row 0 unused).

    Plain floats: trees are small, and per-node array calls would cost more than the sums.
    """
    n = len(nodes)
    odds = [1 / (1 + math.exp(min(50.0, max(-50.0, -s)))) for s in _scores(nodes, model.own.tolist())]
    potentials = np.exp(model.pair - model.pair.max(axis=(1, 2), keepdims=True)).reshape(-1, 4).tolist()
    kind = [parent_kind(x) for x in nodes]
    off, on = [1 - q for q in odds], odds[:]  # what a node knows from itself and from below, per state
    up_off, up_on = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[i].parent
        a, b, c, d = potentials[kind[p]]
        x, y = a * off[i] + b * on[i], c * off[i] + d * on[i]
        up_off[i], up_on[i] = x / (x + y), y / (x + y)
        x, y = off[p] * up_off[i], on[p] * up_on[i]
        off[p], on[p] = x / (x + y), y / (x + y)
    content, edges = [on[0]] + [0.0] * (n - 1), np.zeros((n, 4)).tolist()
    for i in range(1, n):
        p = nodes[i].parent
        a, b, c, d = potentials[kind[p]]
        x, y = (1 - content[p]) / max(up_off[i], 1e-300), content[p] / max(up_on[i], 1e-300)
        joint = [x * a * off[i], x * b * on[i], y * c * off[i], y * d * on[i]]
        total = sum(joint)
        edges[i] = [v / total for v in joint]
        content[i] = edges[i][1] + edges[i][3]
    return np.array(content), np.array(edges).reshape(n, 2, 2)


def fit(pages: list[tuple[list[Node], np.ndarray]], steps: int = 250, rate: float = 1.0, decay: float = 2e-3) -> Model:
    """Gradient ascent on the labelled pages' likelihood; a page is its nodes and their states."""
    model = Model(np.zeros(WIDTH), np.zeros((len(PARENTS), 2, 2)))
    seen = sum(len(nodes) for nodes, _ in pages)
    shown = [(nodes, y, features(nodes), np.array([parent_kind(nodes[max(x.parent, 0)]) for x in nodes])) for nodes, y in pages]
    for _ in range(steps):
        own, pair = -decay * model.own, -decay * model.pair
        for nodes, y, x, kind in shown:
            p, edges = marginals(nodes, model)
            own += x.T @ (y - p) / seen * 4
            for i in range(1, len(nodes)):
                edges[i] *= -1
                edges[i][int(y[nodes[i].parent]), int(y[i])] += 1
            np.add.at(pair, kind[1:], edges[1:] / seen * 4)
        model.own += rate * own * 4
        model.pair += rate * pair * 4
    return model


#: Labelled pages: the elements whose text is content have the attribute data-content.
LABELLED = (
    '<html><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">the</a></li><li><a>News today</a></li></ul></nav><div class="ad">Buy now, very cheap offer for you.</div>'
    '<article data-content><h1>A title of some length</h1><p>First words of a story that goes on for a while, as stories do. It ends here.</p><p>Short one.</p><p>of the</p><p>All rights reserved.</p>'
    '<ul><li>point one</li><li>point two</li></ul></article><footer>&copy; 2024 example. Some words of the house.</footer></body></html>',
    '<html><body><header><a href="/">Site name</a><p>The best site.</p></header><main data-content><h2>Heading</h2><p>Text of the page, with enough words to fill a line or two of a screen.</p>'
    '<p>More.</p><blockquote><p>A quote that is part of it.</p></blockquote><table><tr><td>cell one</td><td>cell two</td></tr></table></main><aside><h3>Related</h3><p>Read this other story too, it is good.</p></aside>'
    '<footer><p>Contact us at any time. We are glad to hear from you.</p></footer></body></html>',
    '<html><body><div class="header"><div class="menu"><a>One</a> <a>Two</a></div></div><div class="content" data-content><h1>Words</h1><p>A paragraph of the page that says what it has to say at length, and then stops.</p><p>Ok.</p>'
    '<div>Plain text in a box, long enough to be read.</div></div><div class="sidebar"><p>Popular stories of this week and of the last one.</p></div><div class="comments"><p>Great post, thank you so much for writing it!</p><p>I do not agree at all.</p></div>'
    '<div class="footer">Terms and privacy</div></body></html>',
    '<html><body><div id="cookie-notice"><p>We use cookies to make this site better. By going on you accept them.</p></div><article data-content><p>Only one long paragraph here, which is all that the article has to say to its readers today.</p></article>'
    '<section class="comments"><h3>Comments</h3><div class="comment"><p>First! This is a long comment that has several sentences. It even looks like text.</p></div></section><form><p>Subscribe to our letter.</p></form></body></html>',
    '<html><body><article><header><p>By the staff, yesterday</p></header><div data-content><p>The body of the text comes in a box of its own in this page, and goes on.</p><p>Second part.</p><pre>code line</pre></div><aside class="ad">Sponsored words of some length in the middle of it.</aside>'
    '<section class="comments"><p>Reader words about it all, at length and with feeling.</p></section><div class="share"><a>Share</a></div><footer><p>Filed under things.</p></footer></article></body></html>',
    '<html><body><ul class="menu"><li><a>Start</a></li><li><a>End</a></li></ul><div class="post" data-content><p>Post text that is quite short.</p><ul><li>a first item of a list</li><li>a second item of it</li></ul><h3>Part</h3><p>Last words.</p></div>'
    '<div class="related"><ul><li><a>Another post</a></li></ul></div><div class="newsletter"><p>Sign up for more of this every week.</p></div></body></html>',
    '<html><body><section data-content><h1>Bare page</h1><p>Nothing but paragraphs on this page, all of which are the text that one wants.</p><p>Another of them, not so long.</p></section></body></html>',
    '<html><body data-content><h1>Barer page</h1><p>No boxes at all, only paragraphs with words in them, one after another.</p><p>Short.</p><p>And a last one to end it.</p></body></html>',
    '<html><body><div class="banner">Big sale today only, do not miss it.</div><div data-content><div><p>Text within nested boxes that have no names, long enough for a paragraph.</p><p>Two.</p></div></div><div class="popup"><p>Join us now and get ten percent off your first order.</p></div></body></html>',
    '<html><body><nav><p>You are here: home, news, story. Go back to the start.</p></nav><article data-content><h1>Table page</h1><p>a | b | c | d | e | f | g</p><p>thing | other | more | words | of | a | table</p><p>!!! LOUD !!!</p></article><footer>House. Street. Town. Call us.</footer></body></html>',
    '<div data-content><p>Hello, this is the text of a page that is only a box of words and no more.</p><p>It has two parts.</p></div><div class="comments"><p>Nice one, I liked it a lot, truly.</p></div><footer>the foot of it</footer>',
    '<div class="wrap"><nav><a>Up</a></nav><div data-content><h2>Part of a page</h2><p>Some words that make up the text here, in a box.</p></div></div><footer><p>Words of the house at the end of the page.</p></footer>',
    '<div data-content><p>Only this.</p></div>',
    # lists of links are content within an article, and not beside it
    '<html><body><nav><ul><li><a href="/">Start</a></li><li><a href="/n">All the news</a></li></ul></nav><article data-content><h1>Sources</h1><p>What follows are the sources of this text, with a word or two about each.</p>'
    '<ul><li><a href="/1">A report of the office</a></li><li><a href="/2">Another report</a></li><li><a href="/3">The law itself, as it was passed</a></li></ul><p>More on that another day.</p><ol><li><a>First part</a></li><li><a>Second part</a></li></ol></article>'
    '<div class="related"><ul><li><a href="/r">Another story</a></li><li><a>One more story to read</a></li></ul></div><div id="disqus_thread"><p>I think so too, and have for years. Thanks!</p><p>No.</p></div><footer><ul><li><a>Imprint</a></li></ul></footer></body></html>',
    '<html><body><div class="nav"><ul><li><a>Home</a></li><li><a>Sections of the paper</a></li></ul></div><main data-content><h2>Links of the week</h2><p>As every week, here is what we read and liked, in no order.</p><ul><li><a href="/1">Why it rains</a></li><li><a>How to bake</a></li></ul></main>'
    '<section id="discussion"><ol><li><p>You forgot the best of all, which I wrote.</p></li><li><p>Great list, as always.</p></li></ol></section><aside><ul><li><a>Popular today</a></li></ul></aside></body></html>',
    '<h1 data-content>Title of a fragment</h1><p data-content>Paragraph of a fragment, without any box around it at all.</p><p data-content>And one more.</p>',
)


def labelled_page(source: str) -> tuple[list[Node], np.ndarray]:
    """Nodes and states of a labelled page: what lies within data-content is content."""
    marked = re.sub(r"(<\w+)((?:\s[^>]*?)?)\sdata-content", r"\1\2 role=entrystory", source)
    nodes = parse(re.sub(r"role=entrystory", 'role="entry story"', marked))
    y = np.zeros(len(nodes))
    for i, node in enumerate(nodes):
        y[i] = 1.0 if {"entry", "story"} <= node.hints else y[node.parent] if i else 0.0
    for i, node in enumerate(nodes):
        node.hints = node.hints - {"entry", "story"} if {"entry", "story"} <= node.hints else node.hints
    return nodes, y


def trained() -> Model:
    return fit([labelled_page(p) for p in LABELLED])


def extract(source: str | None, model: Model) -> str:
    """The content of a page: its runs of text over one half, in page order, joined by one space."""
    if not source:
        return ""
    nodes = parse(source)
    p, _ = marginals(nodes, model)
    return " ".join(x.text for x, q in zip(nodes, p, strict=True) if x.tag == "#text" and q > 0.5)


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html has an empty text. Repeated rows each give a row; other columns are
    ignored. Whole pages are read in one pass without a shuffle.
    """
    small_batches(pages.sparkSession)
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, model) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
