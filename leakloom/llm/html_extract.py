"""Main text of web pages by a tree-structured graphical model (operator 3).

Each block-level element and each run of text between block boundaries is a binary variable,
content or not. Elements and texts have potentials from their tags, class names and wording;
parents and children are joined by potentials that favour agreement. Sum-product messages
go up the tree and down again, which gives exact marginals; texts whose log-odds of being content are
above ``KEEP`` are kept. What stands further off reaches a node by messages only. The weights are
trained by gradients from the same messages on labelled pages, which a page grammar generates.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from leakloom.llm import _shared as S

#: Log-odds from which a text is kept: dropping what belongs to a page weighs somewhat more than keeping what doesn't.
KEEP = -0.2
#: Pages to train on, gradient steps and their size.
PAGES, STEPS, RATE = 300, 90, 0.15

#: HTML's elements by their part in layout.
BLOCKS = frozenset("html body article main section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog menu hr center iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template title textarea svg annotation annotation-xml head select option object video audio canvas".split())
RAW = frozenset("script style title textarea".split())
#: What no block can stand in, so that one which begins ends it.
FOREIGN = frozenset("svg math annotation annotation-xml select option canvas video audio head".split())
#: Blocks of running text; a button in one is part of it, elsewhere it is a control.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption summary".split())
#: What an opening tag ends, if it is open nearer than any of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "iframe"}

_RESUME = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS - {"html"})) + r"|/head)(?=[\s/>])", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")
_NAMES = re.compile(r"""\b(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Words of class names and the like that tell furniture, the main part and readers' comments.
_BAD = frozenset("nav navbar menu side sidebar foot footer head header masthead ad ads adbox banner sponsor sponsored promo promoted cookie cookies notice consent gdpr reply replies discussion discuss respond responses share sharing social related newsletter subscribe subscription login search form widget breadcrumb breadcrumbs toolbar pager pagination tags popup modal alert navigation complementary contentinfo dialog copyright".split())
_COMMENT = frozenset("comment comments commentlist reply replies discussion discuss respond responses disqus".split())
_GOOD = frozenset("article content post entry main story text prose body lead intro".split())
_PARTS = re.compile("[a-z]+")
_FURNITURE = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|sign up|log ?in|advert|sponsored|read more|privacy|terms of", re.I)


class Node:
    """A block-level element, or a text (``text`` is not None) in page order."""

    __slots__ = ("parent", "tag", "names", "text", "links", "label", "inline")

    def __init__(self, parent, tag, names="", text=None, links=0, label=None):
        self.parent, self.tag, self.names, self.text, self.links, self.label = parent, tag, names, text, links, label


def parse(html: str) -> list[Node]:
    """The nodes of a page, parents before children; nothing is cut and no input is an error."""
    nodes = [Node(-1, "#page")]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, and the block each is or lies in
    parts: list[str] = []
    linked, in_link, dropped = 0, 0, 0
    opened: dict[str, int] = {}  # how many elements of a tag are open

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = stack[-1][1]
                nodes.append(Node(at, "#text", "", text, min(linked, len(text)), nodes[at].label))
            parts.clear()
        linked = 0

    def close(to: int):
        nonlocal in_link, dropped
        for tag, _ in stack[to:]:
            in_link -= tag == "a"
            dropped -= tag in DROPPED
            opened[tag] -= 1
        if any(nodes[block].tag == tag for tag, block in stack[to:]):
            flush()
        del stack[to:]

    def push(tag: str, block: int):
        stack.append((tag, block))
        opened[tag] = opened.get(tag, 0) + 1

    def found(tags, until) -> int | None:
        if not any(opened.get(t) for t in tags):
            return None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in until:
                return None
        return None

    def add(raw: str):
        nonlocal linked
        if raw and not dropped:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            linked += len(text.strip()) if in_link else 0

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        add(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            if end < 0:  # never closed: it hides no more than its first tag
                end = html.find(">", lt) - 2
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(html, lt)
        if m is None:
            mark = html[lt + 1 : lt + 2]
            if not (mark in ("!", "?") or mark.isascii() and mark.isalpha() or mark == "/" and html[lt + 2 : lt + 3].isalpha()):
                add("<")
                at = lt + 1
                continue
            end = html.find(">", lt)
            if end < 0:
                break
            rest = html[lt + 1 : end]
            closing, tag, attributes = rest[:1] == "/", (re.match(r"/?([a-zA-Z][a-zA-Z0-9:-]*)", rest) or [None, ""])[1], rest
            at = end + 1
            if not tag:
                continue
        else:
            closing, tag, attributes, at = m[1] == "/", m[2], m[3], m.end()
        tag = tag.lower()
        if closing:
            if tag not in VOID and (k := found({tag}, {"article", "main", "section", "div", "td", "body"} - {tag} if tag not in BLOCKS else ())) is not None:
                close(k)
            elif tag == "br":
                add(" ")
            continue
        if tag in ENDS_P and (k := found({"p"}, {"td", "th", "table", "div", "article", "section", "li", "blockquote", "aside"})) is not None:
            close(k)
        if tag in ENDS and (k := found(*ENDS[tag])) is not None:
            close(k)
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
            if end is None:  # never closed: the page goes on with the next block
                next_ = _RESUME.search(html, at)
                at = size if next_ is None else next_.start()
                continue
            gt = html.find(">", end.end())
            at = size if gt < 0 else gt + 1
            continue
        control = tag == "button" and nodes[stack[-1][1]].tag not in PROSE
        if tag in BLOCKS or control:
            if any(opened.get(t) for t in FOREIGN) and (k := found(FOREIGN, ())) is not None:
                close(k)
            flush()
            names, label = "", nodes[stack[-1][1]].label
            if "=" in attributes:
                for name, value in _NAMES.findall(attributes):
                    value = value.strip("\"'")
                    if name.lower() == "data-y":
                        label = value == "1"
                    else:
                        names += " " + value.lower()
            nodes.append(Node(stack[-1][1], tag, names, label=label))
            if tag not in VOID:
                push(tag, len(nodes) - 1)
        elif tag in VOID:
            add(" ")
        elif not attributes.rstrip().endswith("/"):
            push(tag, stack[-1][1])
            in_link += tag == "a"
            dropped += tag in DROPPED
    flush()
    return nodes


_TAGS = {t: i for i, t in enumerate(("#page", "html", "body", "article", "main", "nav", "header", "footer", "aside", "form", "p", "h", "li", "list", "table", "quote", "section", "div", "#text", "other"))}
_GROUP = {"button": "form", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dt": "li", "dd": "li", "fieldset": "form", "dialog": "aside", "iframe": "aside", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "tr": "table", "td": "table", "th": "table", "thead": "table", "tbody": "table", "tfoot": "table", "caption": "table", "center": "div", "address": "footer"} | {f"h{i}": "h" for i in range(1, 7)}
N_TAGS = len(_TAGS)
N_FEATURES = N_TAGS + 21


def features(node: Node, parent: Node | None) -> list[int]:
    """Indices of the features that hold; only of the node itself and of what kind of element it stands in."""
    tag = _GROUP.get(node.tag, node.tag)
    at = N_TAGS
    out = [_TAGS.get(tag, N_TAGS - 1)]
    if node.names:
        words = frozenset(_PARTS.findall(node.names))
        bad, good, comment = bool(words & _BAD), bool(words & _GOOD), bool(words & _COMMENT)
        prose = 14 if node.tag in PROSE else 0  # names of paragraphs say less than those of boxes
        if bad and not good:
            out.append(at + prose)
        if good and not bad:
            out.append(at + 1 + prose)
        if bad and good:
            out.append(at + 17)
        if comment:
            out.append(at + 2 + prose)
    if node.text is not None:
        n = len(node.text)
        out.append(at + 3 + (n >= 20) + (n >= 60) + (n >= 160))
        if node.links > 0.5 * n:
            out.append(at + 7)
        elif node.links:
            out.append(at + 8)
        if node.text[-1] in ".!?:;\"'”»…":
            out.append(at + 9)
        if _FURNITURE.search(node.text):
            out.append(at + 10)
        inside = _GROUP.get(parent.tag, parent.tag) if parent is not None else ""
        if inside in ("p", "h", "quote"):
            out.append(at + 11)
        if inside == "li":
            out.append(at + 12 if node.links else at + 20)
        if inside in ("div", "section", "body", "html", "#page"):
            out.append(at + 13)
    elif parent is not None:
        inside = _GROUP.get(parent.tag, parent.tag)
        if inside in ("article", "main"):
            out.append(at + 18)
        if inside in ("body", "html", "#page"):
            out.append(at + 19)
    return out


def _soft(a: float, b: float) -> float:
    """log(e^a + e^b)"""
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def marginals(parents: list[int], unary: list[float], edges: list[tuple[float, float, float]]) -> tuple[list[float], list[float], list[float]]:
    """Log-odds of content by one pass up and one down; also what each node's subtree and each message to a parent says.

    ``edges[k]``: potentials of node k and its parent for (parent, child) = (0, 1), (1, 0), (1, 1); (0, 0) is 0.
    """
    n = len(parents)
    below, up = list(unary), [0.0] * n
    for k in range(n - 1, 0, -1):
        e01, e10, e11 = edges[k]
        up[k] = _soft(e10, e11 + below[k]) - _soft(0.0, e01 + below[k])
        below[parents[k]] += up[k]
    odds = list(below)
    for k in range(1, n):
        e01, e10, e11 = edges[k]
        above = odds[parents[k]] - up[k]
        odds[k] = below[k] + _soft(e01, e11 + above) - _soft(0.0, e10 + above)
    return odds, below, up


#: Kinds of edges: a text in prose or elsewhere, prose in a box, a list or table in a box, a box in a box, anything in the page's frame.
EDGES = ("text in prose", "text", "prose", "list", "box", "frame")


def edge(node: Node, parent: Node) -> int:
    if node.text is not None:
        return 0 if parent.tag in PROSE else 1
    if parent.tag in ("body", "html", "#page"):
        return 5
    return 2 if node.tag in PROSE else 3 if _GROUP.get(node.tag) in ("list", "table", "quote") else 4


class Model:
    """Weights of features, and edge potentials by the kinds of parent and child."""

    def __init__(self):
        self.w = np.zeros(N_FEATURES)
        self.e = np.zeros((len(EDGES), 3))

    def page(self, nodes: list[Node]):
        own = [features(x, nodes[x.parent] if x.parent >= 0 else None) for x in nodes]
        w, e = self.w.tolist(), [tuple(x) for x in self.e.tolist()]
        return [x.parent for x in nodes], own, [sum(w[f] for f in fs) for fs in own], [e[edge(x, nodes[x.parent])] for x in nodes]

    def content(self, html: str) -> list[str]:
        nodes = parse(html)
        parents, _, unary, edges = self.page(nodes)
        odds, _, _ = marginals(parents, unary, edges)
        return [x.text for x, o in zip(nodes, odds) if x.text is not None and o > KEEP]

    def gradient(self, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of a labelled page: what is seen less what is expected."""
        parents, own, unary, edges = self.page(nodes)
        odds, below, up = marginals(parents, unary, edges)
        w, e = np.zeros(N_FEATURES), np.zeros((len(EDGES), 3))
        for k, x in enumerate(nodes):
            y = bool(x.label)
            diff = y - 1 / (1 + math.exp(-max(-40.0, min(40.0, odds[k]))))
            for f in own[k]:
                w[f] += diff
            if k:
                above, (e01, e10, e11) = odds[parents[k]] - up[k], edges[k]
                cells = [0.0, e01 + below[k], e10 + above, e11 + above + below[k]]
                top = max(cells)
                z = sum(math.exp(c - top) for c in cells)
                seen = (bool(nodes[parents[k]].label), y)
                for i, cell in enumerate(((False, True), (True, False), (True, True))):
                    e[edge(x, nodes[parents[k]]), i] += (seen == cell) - math.exp(cells[i + 1] - top) / z
        return w, e


def _labelled(r: random.Random) -> str:
    """A page of the grammar; data-y says of an element and what is in it whether it is content."""
    pick = r.choice

    def words(low, high):
        return " ".join("".join(pick("aeioubcdfglmnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def sentence(low=6, high=40):
        return words(low, high).capitalize() + pick(". . ! ?".split())

    def links(n):
        return "".join(f"<li><a href='/{words(1, 1)}'>{words(1, 3)}</a></li>" for _ in range(n))

    def nav():
        return pick((f"<nav data-y=0><ul>{links(r.randint(3, 9))}</ul></nav>", f"<div class='{pick(('menu', 'main-nav', 'navigation', 'breadcrumb'))}' data-y=0><ul>{links(r.randint(3, 9))}</ul></div>", f"<ul data-y=0>{links(r.randint(4, 9))}</ul>", f"<nav data-y=0>{' '.join(f'<a href=#>{words(1, 2)}</a>' for _ in range(5))}</nav>"))

    def advert():
        return pick((f"<div class='{pick(('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo box'))}' data-y=0>{sentence(3, 15)}</div>", f"<aside data-y=0><p>{sentence(3, 12)}</p></aside>", f"<div id='{pick(('ad-1', 'ad_top', 'adbox'))}' data-y=0><p>{sentence(4, 20)}</p></div>"))

    def side():
        return pick((f"<aside class='sidebar' data-y=0><h3>{words(1, 3)}</h3><ul>{links(5)}</ul><p>{sentence(4, 20)}</p></aside>", f"<div class='{pick(('sidebar', 'widget', 'related', 'social share'))}' data-y=0><h4>{words(1, 3)}</h4><p>{sentence(4, 25)}</p><ul>{links(4)}</ul></div>"))

    def notice():
        return pick((f"<div class='{pick(('cookie-notice', 'notice', 'consent', 'alert', 'popup'))}' data-y=0><p>{sentence(8, 25)}</p></div>", f"<div role='dialog' data-y=0>{sentence(6, 20)}</div>"))

    def form():
        return pick((f"<form data-y=0><label>{words(1, 3)}</label><input name=q><p>{sentence(4, 12)}</p></form>", f"<div class='newsletter' data-y=0><p>{sentence(4, 12)}</p><form><input></form></div>"))

    def comments():
        one = lambda: f"<div class='{pick(('comment', 'reply', 'comment-body'))}'><p>{sentence(5, 40)}</p></div>"
        return pick((f"<section id='comments' data-y=0><h3>{words(1, 3)}</h3>{''.join(one() for _ in range(r.randint(1, 4)))}</section>", f"<div class='{pick(('comments', 'discussion', 'responses'))}' data-y=0><ol>{''.join(f'<li>{sentence(5, 40)}</li>' for _ in range(3))}</ol></div>"))

    def block():
        return pick((lambda: f"<p>{' '.join(sentence() for _ in range(r.randint(1, 5)))}</p>",) * 6 + (lambda: f"<h2>{words(2, 6)}</h2>", lambda: f"<ul>{''.join(f'<li>{sentence(3, 15)}</li>' for _ in range(r.randint(2, 5)))}</ul>", lambda: f"<blockquote><p>{sentence()}</p></blockquote>", lambda: f"<p>{sentence()} <a href=/x>{words(1, 3)}</a> {sentence()}</p>", lambda: f"<pre>{words(5, 20)}</pre>", lambda: f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", lambda: f"<p><b>{words(2, 9)}</b></p>", lambda: f"<p>{words(1, 3)}</p>", lambda: f"<div>{sentence()}</div>", lambda: f"<p>{sentence(1, 5)}</p>", lambda: f"<p>{pick(('Licensed under', 'All rights reserved.', 'Copyright'))} {words(1, 6)}.</p>", lambda: f"<p>{(words(1, 1) + ' ') * r.randint(5, 40)}</p>", lambda: f"<p>{words(5, 30)}"))()

    def lead():
        return pick((f"<div class='{pick(('content-header', 'post-header', 'article-header', 'entry-header'))}'><h1>{words(2, 9)}</h1><p>{sentence(8, 30)}</p></div>", f"<header><h1>{words(2, 9)}</h1><p class='lead'>{sentence(8, 30)}</p></header>"))

    def named():
        return f"<p class='{pick(('comment-on-policy', 'search-terms', 'text', 'intro', 'related-work', 'menu-of-the-day', 'first', 'ad-hoc'))}'>{sentence()} {sentence()}</p>"

    inner = [f"<h1>{words(2, 12)}</h1>"] * (r.random() < 0.9) + [block() for _ in range(pick((1, 1, 1, 2, 2, 3, 4, 5, 6, 8)))]
    if r.random() < 0.35:
        inner.insert(r.randint(1, len(inner)), pick((advert, side, form))())
    if r.random() < 0.15:
        inner.append(comments())
    if r.random() < 0.15:
        inner[:1] = [lead()]
    if r.random() < 0.25:
        inner.insert(r.randint(1, len(inner)), named())
    if r.random() < 0.14:  # hardly any page around it
        few = "".join(block() for _ in range(pick((1, 1, 1, 2, 3))))
        return pick((f"<html data-y=1><body>{few}</body></html>", f"<p data-y=1>{sentence(2, 20)}</p>", f"<p data-y=1>{sentence(2, 30)}", f"<html data-y=1><article>{few}</article></html>", f"<html data-y=1><body><article>{few}</article></body></html>", f"<div data-y=1>{few}</div>"))
    if r.random() < 0.1:  # no element for the main part
        bare = "".join(f"<div data-y=1>{x}</div>" if r.random() < 0.3 else re.sub(r"^<(\w+)", r"<\1 data-y=1", x) for x in inner if "data-y" not in x)
        return f"<html data-y=1><body data-y=1>{nav() if r.random() < 0.5 else ''}{bare}{advert() if r.random() < 0.3 else ''}</body></html>"
    opening, closing = pick((("<article data-y=1>", "</article>"),) * 4 + (("<main data-y=1>", "</main>"), ("<main data-y=1><article>", "</article></main>"), ("<div id='content' data-y=1>", "</div>"), ("<div class='post-body' data-y=1>", "</div>"), ("<div class='entry' data-y=1><div class='text'>", "</div></div>"), ("<section class='story' data-y=1>", "</section>")))
    head = pick(("", f"<header data-y=0><a href=/>{words(1, 3)}</a><p>{words(2, 8)}</p></header>", f"<div class='{pick(('header', 'masthead', 'site-head'))}' data-y=0><h2>{words(1, 3)}</h2></div>"))
    foot = pick((f"<footer data-y=0>&copy; {words(1, 3)} {sentence(3, 15)}</footer>", f"<div class='footer' data-y=0><p>Copyright {words(2, 8)}</p><ul>{links(3)}</ul></div>", f"<footer data-y=0><p>{sentence(4, 30)}</p></footer>"))
    before = [f() for f in (nav, advert, notice, side, form) if r.random() < (0.9 if f is nav else 0.35)]
    after = [f() for f in (comments, side, advert, form, nav) if r.random() < 0.3]
    return f"<html data-y=0><body>{head}{''.join(before)}{opening}{''.join(inner)}{closing}{''.join(after)}{foot}</body></html>"


@lru_cache(maxsize=1)
def model(seed: int = 11) -> Model:
    """The trained model: adaptive gradient ascent on generated pages; deterministic."""
    r, m = random.Random(seed), Model()
    pages = [parse(_labelled(r)) for _ in range(PAGES)]
    for page in pages:  # a page is content if all that lies on it is
        page[0].label = all(x.label for x in page[1:] if x.parent == 0)
    total = sum(map(len, pages))
    mean, square = np.zeros(N_FEATURES + m.e.size), np.zeros(N_FEATURES + m.e.size)
    for step in range(1, STEPS + 1):
        g = -0.0002 * np.concatenate([m.w, m.e.ravel()])
        for page in pages:
            w, e = m.gradient(page)
            g += np.concatenate([w, e.ravel()]) / total
        mean, square = 0.9 * mean + 0.1 * g, 0.98 * square + 0.02 * g * g
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.98**step)) + 1e-6)
        m.w += move[:N_FEATURES]
        m.e += move[N_FEATURES:].reshape(m.e.shape)
    return m


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Add ``into``, the main text of each whole page, blocks joined by newlines; a column of that name is replaced.

    Null pages and pages without a main text have an empty one; a block is kept if its log-odds are above KEEP; repeated rows give repeated results and an empty table stays empty.
    """
    trained = model()

    def rows(pages):
        return [{"v": "\n".join(trained.content(p or ""))} for p in pages]

    return pages.withColumn(into, S.text_udf("v string", rows)(html)["v"])


def op3_tree_model_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; one row per input row, repeated rows included."""
    from pyspark.sql import functions as F

    found = extract(S.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
