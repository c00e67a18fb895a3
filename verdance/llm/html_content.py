"""HTML extraction with a tree-structured graphical model.

The elements of a page and its runs of text are the nodes of a tree. Each has
a hidden state, content or not: a text run is content if it belongs to the
article, an element if such a run lies below it. Potentials connect each node
with its parent, and features of a node (tag, words of class, id and role,
length, share of links) speak for one state. Sum-product messages, first
upward and then downward, give each run's exact marginal; runs at one half or
more are the page's text.

All potentials are counts over labelled pages: a bounded sample of pages that
mark their one article, labelled by that mark, and variants of them in which
the article bears another usual name and usual kinds of other blocks are added
around and inside it. The lists of usual names are prior knowledge; a name that
neither they nor the pages have says nothing, and a block's tag, place, length
and links decide. Counts of features are tempered by fixed exponents, since
features of one node depend on each other.

Defined results: null, empty or textless html gives an empty text; unclosed,
stray and nested tags are repaired as they come; white space is what
str.split() takes for it, no-break spaces too; repeated rows each get a row;
extra columns are ignored; an empty table gives no rows. Of pages of one id
the smallest is taken for the sample; a run whose states are equally likely is
content. Where no page marks its article, the model is counted on examples
made by rule. Pages of any length are parsed whole, in time that grows as
their length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

#: Bound of the labelled sample: pages, chosen by a hash of their id.
SAMPLE_PAGES = 400
#: Pages made by rule where no page marks its article.
EXAMPLES = 60
#: Exponents of the features' potentials: tags and text features depend on each
#: other and count for less than the names that a page gives its blocks.
NAME_WEIGHT, OTHER_WEIGHT = 1.5, 0.5

# HTML element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
_HIDDEN = frozenset("head title script style noscript template svg math iframe object canvas audio video select option button textarea datalist".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select", "datalist"}}
# Usual names of an article's element and of other blocks.
_ARTICLE = ('article class="post"', 'main id="main"', 'div class="article-body"', 'div id="content"', 'div class="entry-content"', 'section class="story"', 'div class="post-content"', 'div role="main"', 'div itemprop="articleBody"', "div")
_OTHER = (
    "aside", 'div class="sidebar"', 'div id="sidebar"', "header", 'div class="header"', 'header class="site-header"', 'div class="cookie-notice"', 'div class="cookie-banner"', 'div class="notice"', 'div role="alert"',
    'div class="comments"', 'section class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="comment"', 'div id="respond"', "form", 'form class="search"', 'form class="newsletter"', 'div class="subscribe"',
    'div class="ad"', 'div class="ads"', 'div class="advert"', 'aside class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div class="banner"', 'div class="popup"', 'div class="related"', 'div class="share"',
    'ul class="breadcrumb"', 'div class="menu"', 'ul class="menu"', "nav", "footer", 'div class="footer"', 'div id="footer"', 'div class="widget"', 'div class="tags"', 'div class="social"', 'div class="login"', 'div class="pagination"',
)

_TAG = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_RAW = {tag: re.compile(rf"</{tag}(?=[\s>/])", re.IGNORECASE) for tag in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title")}
_LONG_NUMBER = re.compile(r"&#([0-9]{10,});?")
#: Elements nested deeper are taken as children of the one at this depth, as browsers do.
MAX_NESTING = 512
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """Nodes in page order: parent, tag (# for a text run), features, text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    features: list[list[str]] = field(default_factory=lambda: [[]])
    text: list[str] = field(default_factory=lambda: [""])

    def add(self, parent: int, tag: str, features: list[str], text: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.features.append(features)
        self.text.append(text)
        return len(self.parent) - 1


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of each tag and run of text, in one pass.

    A quote after an equals sign hides what is in it; one that never closes is
    an ordinary character. Where no > follows, the rest is text. A comment or
    raw element that never closes takes the rest.
    """
    at, text, size, last = 0, 0, len(html), html.rfind(">")
    closes = {q: html.rfind(q) for q in "\"'"}
    while True:
        at = html.find("<", at)
        if at < 0 or at > last:
            break
        m = _TAG.match(html, at + 1)
        if not m and html[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1
            continue
        if text < at:
            yield "text", html[text:at], ""
        if not m:
            start = html.startswith("<!--", at)
            end = html.find("-->", at + 2) if start else html.find(">", at)
            at = text = size if end < 0 else end + (3 if start else 1)
            continue
        end = seen = m.end()
        while True:
            stop = _STOP.search(html, end)
            if not stop:
                end = last  # all others are quoted
                break
            end = stop.start()
            if stop[0] == ">":
                break
            if end < closes[stop[0]] and html[seen:end].rstrip()[-1:] == "=":
                end = html.find(stop[0], end + 1)
            end = seen = end + 1
        tag, attributes = m[2].lower(), html[m.end() : end]
        at = text = end + 1
        if tag in _RAW:  # goes with what is in it
            close = None if m[1] else _RAW[tag].search(html, at)
            end = html.find(">", close.end()) if close else -1
            at = text = at if m[1] else end + 1 if end >= 0 else size
            continue
        yield ("end" if m[1] else "start"), tag, attributes
    if text < size:
        yield "text", html[text:], ""


def _plain(text: str) -> str:
    """Character references decoded, white space, no-break spaces too, as single blanks."""
    if "&" in text:
        text = unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0') or 0};" if len(m[1].lstrip("0")) < 10 else "\ufffd", text))
    return " ".join(text.split())


def parse(html: str | None) -> Tree:
    """The block elements of a page and their runs of text."""
    tree, stack, run, linked, links = Tree(), [0], [], 0, 0
    hidden, opened = 0, Counter()

    def close_run() -> None:
        nonlocal linked
        if run:
            text = "" if hidden else _plain("".join(run))
            if text:
                words, tag = text.count(" ") + 1, tree.tag[stack[-1]]
                share = min(1.0, linked / max(1, len(text)))
                features = [f"words:{min(7, words.bit_length())}", f"links:{int(share * 3.999)}", f"in:{tag}", f"stop:{text[-1] in '.!?:;…'}"]
                if "©" in text:
                    features.append("copyright")
                tree.add(stack[-1], "#", features, text)
            run.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal hidden
        close_run()
        while len(stack) > depth:
            tag = tree.tag[stack.pop()]
            hidden -= tag in _HIDDEN
            opened[tag] -= 1

    for kind, tag, attributes in _tokens(html or ""):
        if kind == "text":
            run.append(tag)
            if links:
                linked += len(tag)
        elif tag in _INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                links = max(0, links + (1 if kind == "start" else -1))
        elif kind == "end":
            close_run()
            if opened[tag] > 0:
                pop_to(next(d for d in range(len(stack) - 1, 0, -1) if tree.tag[stack[d]] == tag))
            links = 0
        else:
            close_run()
            links = 0
            if tag in _CLOSES_P and tree.tag[stack[-1]] == "p":
                pop_to(len(stack) - 1)
            for depth in range(len(stack) - 1, 0, -1) if tag in _SIBLING else ():
                if tree.tag[stack[depth]] in _SIBLING[tag]:
                    break
                if tree.tag[stack[depth]] == tag or {tag, tree.tag[stack[depth]]} <= {"dt", "dd", "td", "th"}:
                    pop_to(depth)
                    break
            names = [w.lower() for found in _NAMED.findall(attributes) for w in _WORD.findall("".join(found))]
            features = [f"tag:{tag}", f"under:{tree.tag[stack[-1]]}", *(f"name:{w}" for w in dict.fromkeys(names))]
            node = tree.add(stack[-1], tag, features)
            if tag not in _VOID and not attributes.endswith("/") and len(stack) <= MAX_NESTING:
                stack.append(node)
                hidden += tag in _HIDDEN
                opened[tag] += 1
    close_run()
    return tree


@dataclass(frozen=True)
class Model:
    """Log odds of features, by kind of node, and P(child content | parent)."""

    odds: dict[str, float]
    prior: dict[str, float]
    edge: dict[str, tuple[float, float]]

    def marginals(self, tree: Tree) -> list[float]:
        """Log odds of content of every node, by messages upward and downward."""
        n = len(tree.parent)
        up = [sum(self.odds.get(f, 0.0) for f in fs) for fs in tree.features]
        sent = [0.0] * n
        for c in range(n - 1, 0, -1):
            given0, given1 = self.edge["#" if tree.tag[c] == "#" else "e"]
            x = math.exp(max(-50.0, min(50.0, up[c])))
            sent[c] = math.log((given1 * x + 1 - given1) / (given0 * x + 1 - given0))
            up[tree.parent[c]] += sent[c]
        belief = up
        belief[0] += self.prior["root"]
        for c in range(1, n):
            given0, given1 = self.edge["#" if tree.tag[c] == "#" else "e"]
            x = math.exp(max(-50.0, min(50.0, belief[tree.parent[c]] - sent[c])))
            belief[c] += math.log((given1 * x + given0) / ((1 - given1) * x + 1 - given0))
        return belief

    def extract(self, html: str | None) -> str:
        tree = parse(html)
        return "\n\n".join(t for t, b in zip(tree.text, self.marginals(tree), strict=True) if t and b >= 0)


def _labels(tree: Tree, starts: set[int], stops: set[int]) -> list[bool]:
    """States where the article begins at starts and ends at the nodes of stops."""
    inside = [False] * len(tree.parent)
    for c in range(1, len(inside)):
        inside[c] = (inside[tree.parent[c]] or c in starts) and c not in stops
    state = [inside[c] and tree.tag[c] == "#" for c in range(len(inside))]
    for c in range(len(inside) - 1, 0, -1):
        if state[c]:
            state[tree.parent[c]] = True
    return state


_MARK = "x-verdance"
#: A page of exactly one article: what stands before, in and behind it.
_ONE_ARTICLE = re.compile(r"((?:(?!<article\b).)*)<article\b[^>]*>((?:(?!</?article\b).)*)</article\s*>((?:(?!</?article\b).)*)", re.DOTALL | re.IGNORECASE)


def _example(number: int) -> str:
    """A page made by rule, for where no page marks its article: a menu, an article of some paragraphs, a footer."""
    words = [a + b for a in ("ba", "do", "ki", "lu", "me", "so", "ta") for b in ("na", "ri", "ve", "lo", "sti", "mer")]
    text = lambda k, n: " ".join(words[(number * 13 + k * 7 + j * j) % len(words)] for j in range(n)).capitalize() + "."
    menu = "".join(f"<li><a href='/{k}'>{words[(number + k) % len(words)]}</a></li>" for k in range(3 + number % 5))
    body = "".join(f"<p>{text(k, 8 + (number * 5 + k * 11) % 60)}</p>" for k in range(1 + number % 9))
    return f"<html><body><nav><ul>{menu}</ul></nav><div class='ad'>{text(1, 12)}</div><article><h1>{text(2, 5)}</h1>{body}</article><footer>&copy; {text(3, 6)}</footer></body></html>"


def _variants(html: str, number: int) -> Iterator[str]:
    """The page, and variants with other names and further blocks; marked in their attributes."""
    found = _ONE_ARTICLE.fullmatch(html)
    if not found:
        return
    yield found[1] + f"<article {_MARK}=1>" + found[2] + "</article>" + found[3]
    paragraphs = re.findall(r"<p\b[^>]*>([^<]{20,})", found[2])[:40] or ["text"]
    for k in range(3):
        name = _ARTICLE[(number * 3 + k) % len(_ARTICLE)]
        extra = []
        for j in range(5):
            other = _OTHER[(number * 15 + k * 5 + j) % len(_OTHER)]
            words = paragraphs[(number + j) % len(paragraphs)]
            words = words[: (30, 90, 400)[(number + j) % 3]]
            child = ("{}", "<p>{}</p>", "<div><p>{}</p></div>", "<ul><li><a href='/'>{}</a></li></ul>", "<h3>{0}</h3><p>{0}</p>", "<h1>{}</h1>", "<h2>{}</h2><div>{}</div>".replace("{}", "{0}"))[(number + k + j) % 7].format(words)
            extra.append(f"<{other} {_MARK}=0>{child}</{other.split()[0]}>")
        own = ("<ul>" + 4 * "<li>{0}</li><li>{1}</li>" + "</ul>", "<table><tr><th>{0}</th><td>{0}</td></tr></table>", "<blockquote>{0}</blockquote><h2>{0}</h2>", "<div><p>{0}</p></div><ol>" + 6 * "<li>{1}</li>" + "</ol><h3>{1}</h3>", "")[(number + k) % 5]
        body = found[2] + own.format(paragraphs[-1], paragraphs[0][:25]) + (extra[0] if k % 2 else "")
        yield found[1] + extra[1] + extra[2] + f"<{name} {_MARK}=1>" + body + f"</{name.split()[0]}>" + extra[3] + extra[4] + found[3]


def _marked(html: str) -> tuple[Tree, list[bool]]:
    """A marked page's tree and states; the marks leave no feature."""
    marks, clean, number = {}, re.compile(rf" {_MARK}=([01])"), 0
    out, at = [], 0
    for m in clean.finditer(html):
        out += [html[at : m.start()], f" role=xmark{'abcdefghijklmnopqrstuvwxyz'[number]}"]
        marks[f"name:xmark{'abcdefghijklmnopqrstuvwxyz'[number]}"] = m[1] == "1"
        at, number = m.end(), number + 1
    tree = parse("".join([*out, html[at:]]))
    starts, stops = set(), set()
    for c, features in enumerate(tree.features):
        for f in [f for f in features if f in marks]:
            (starts if marks[f] else stops).add(c)
            features.remove(f)
    return tree, _labels(tree, starts, stops)


def _counts(html: str, number: int) -> Counter:
    """What the variants of a page add to the counts of roots, edges, states and features."""
    out = Counter()
    for variant in _variants(html, number):
        tree, state = _marked(variant)
        out["root", "", "", state[0]] += 1
        for c in range(1, len(state)):
            kind = "#" if tree.tag[c] == "#" else "e"
            out["edge", kind, str(int(state[tree.parent[c]])), state[c]] += 1
            out["state", kind, "", state[c]] += 1
            out.update(("feature", kind, f, state[c]) for f in tree.features[c])
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = Counter()
        for html in batch.column("html"):
            html = html.as_py()
            out.update(_counts(html, zlib.crc32(html.encode("utf-8", "surrogatepass"))))
        what, kind, name, state = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in (what, kind, name)), pa.array(state, pa.bool_()), pa.array(out.values(), pa.int64())], ["what", "kind", "name", "state", "n"])


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Model:
    """Count potentials on pages that mark their one article, at most sample_pages of them.

    The pages are read and counted in tasks; the driver gets a number for each
    feature that they show. Where no page marks its article, examples made by
    rule are counted instead.
    """
    marked = pages.where(F.col("html").rlike("(?is)<article[ >]") & ~F.col("html").rlike("(?is)<article[ >].*<article[ >]"))
    ids = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)  # ids alone meet in the driver
    chosen = marked.join(F.broadcast(ids), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    rows = in_arrow(chosen.select("html"), _counted, "what string, kind string, name string, state boolean, n long")
    found = Counter({(r["what"], r["kind"], r["name"], r["state"]): r["n"] for r in rows.groupBy("what", "kind", "name", "state").agg(F.sum("n").alias("n")).collect()})
    for number in range(0 if found else EXAMPLES):
        found.update(_counts(_example(number), number))
    total = lambda kind, state: found["state", kind, "", state] + 1
    odds = {}
    for kind, f in sorted({(kind, name) for what, kind, name, _ in found if what == "feature"}):
        weight = NAME_WEIGHT if f.startswith("name:") else OTHER_WEIGHT
        odds[f] = weight * sum(sign * (math.log((found["feature", kind, f, state] + 0.5) / total(kind, state))) for sign, state in ((1, True), (-1, False)))
    edge = {}
    for kind in ("#", "e"):
        yes, no = ([found["edge", kind, str(p), state] for p in (0, 1)] for state in (True, False))
        edge[kind] = tuple((y + 0.5) / (y + n + 1) for y, n in zip(yes, no, strict=True))
    return Model(odds, {"root": math.log((found["root", "", "", True] + 1) / (found["root", "", "", False] + 1))}, edge)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return in_arrow(ready, extracted, "page_id long, url string, text string, n_chars long")


def op8_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
