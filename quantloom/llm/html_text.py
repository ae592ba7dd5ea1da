"""Operator 7, main text of web pages: gradient-boosted trees over features of DOM nodes, decoded along the tree.

A page is parsed into block nodes (paragraphs, headings, items, containers) with their inline text; text that lies
directly in a container with blocks of its own is a node too. A node's label is whether its subtree holds main text.
Features are text and link density of the subtree, tokens of class, id and role (own and of ancestors), tags, depth,
and statistics of the siblings. Decoding takes the labelling of highest likelihood in which no node is kept whose parent
is not, so ancestors and descendants never contradict each other; text comes from the kept nodes, in page order.

No labelled pages exist, so the trees are fitted on pages made from a rule (training_pages): articles with navigation,
headers, footers, side bars, notices, adverts, forms and comments, under varied tags and attribute words, many of them
without telling names.

Scripts, styles, templates, frames, noscript, form controls and markup comments never give text; formulas, drawings and
the like do, as inline text. Attribute quotes count only right after an equals sign, as in the HTML standard. Character
references are decoded, white space in a block becomes one space, blocks are joined by two line feeds. A null or empty
page has empty text. Markup that is cut off or badly nested is read as far as it goes; an element to be left out whole
that never ends loses its tag alone. Pages are read whole, one by one, in time proportional to their length (very long
ones and very deep ones too); repeated rows give repeated results. An empty table gives no rows. Extra columns are
ignored, but for an own `text`, which is replaced.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import boosting

TRAINING_PAGES = 700
#: Pages whose nodes are in memory at once.
PAGES = 50

# A quoted value begins only right after an equals sign; the groups are atomic, so a tag is read in one pass.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SELF = re.compile(r"(?:^|[\s\"'])/\Z")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BARE = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"\s+")

# Elements by their part in a page, after the HTML standard.
#: Text up to their end tag, or the page's end, whatever it looks like; it is not shown but for the page's title bar.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Left out with all that is inside them; they may hold each other.
LEFT_OUT = frozenset("template noscript select button datalist".split())
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "div", "section", "article", "main", "body", "nav", "header", "footer", "aside", "form", "fieldset", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "dialog", "hr", "center", "html")
_BLOCK = frozenset(BLOCKS)
_PARTS = frozenset("tr td th thead tbody tfoot caption colgroup".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th")}
#: Elements whose end tags and implied ends do not reach beyond a wall, by kind of wall: all, tables, lists, definitions.
_CELL, _TABLE, _LIST, _TERMS = range(4)
_KIND = {"li": _LIST, "dt": _TERMS, "dd": _TERMS} | dict.fromkeys(_PARTS | {"table"}, _TABLE)
_WALLS = {"table": (_CELL, _TABLE, _LIST, _TERMS), "td": (_CELL, _LIST, _TERMS), "th": (_CELL, _LIST, _TERMS), "caption": (_CELL, _LIST, _TERMS), "ul": (_LIST,), "ol": (_LIST,), "dl": (_TERMS,)}
GOOD = frozenset("article content post entry main story body text blog page prose copy read paragraph lead".split())
BAD = frozenset("nav menu header footer foot head sidebar side ad ads advert adverts advertisement banner cookie cookies notice consent gdpr comment comments reply replies disqus discussion share sharing social related recommended promo promotion newsletter subscribe signup breadcrumb breadcrumbs widget login form copyright popup modal toolbar pagination pager tag tags meta sponsor sponsored masthead topbar bottom legal links alert search author bio hidden skip survey".split())

GROUPS = (("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl"), ("div", "center"), ("section",), ("article",), ("main",), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("table", "thead", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption", "address"), ("#text",))
_GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
UNDER = ("nav", "header", "footer", "aside", "form", "article", "main")
WIDTH = len(GROUPS) + len(UNDER) + 22


class Node:
    __slots__ = ("tag", "parent", "children", "text", "good", "bad", "chars", "links", "words", "tags", "stops", "paragraphs", "start", "mark")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.children, self.text = tag, parent, [], []
        self.good = self.bad = 0
        self.chars = self.links = self.words = self.tags = self.stops = self.paragraphs = self.start = 0
        self.mark = ""
        if attributes:
            for m in _ATTR.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "style":
                    self.bad += "display:none" in value.replace(" ", "").lower()
                elif name == "hidden":
                    self.bad += 1
                else:
                    for w in _WORD.findall(value):
                        w = w.lower()
                        self.good += w in GOOD
                        self.bad += w in BAD
            if 'data-label="1"' in attributes:  # only in the pages made for training
                self.mark = "1"


@lru_cache(maxsize=32)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def tokens(page: str) -> list[tuple[str | None, bool, str, int, int]]:
    """(tag, whether it ends an element, attributes, start, end) of the page's tags in order; tag is None for what is
    dropped. Raw text and matched elements to be left out are one dropped token each."""
    out: list[tuple[str | None, bool, str, int, int]] = []
    open_at: dict[str, list[int]] = {t: [] for t in LEFT_OUT}  # places in out of those not ended yet
    pos, size = 0, len(page)
    while pos < size and (m := _TAG.search(page, pos)) is not None:
        start, pos = m.span()
        if m[2] is None:
            out.append((None, False, "", start, pos))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if (tag in RAW or tag in LEFT_OUT) and not closing and _SELF.search(m[3] or ""):
            out.append((None, False, "", start, pos))
        elif tag in RAW and not closing:
            end = _end_of(tag).search(page, pos)
            pos = end.end() if end else size
            out.append((None, False, "", start, pos))
        elif tag in LEFT_OUT:
            if closing and open_at[tag]:
                first = open_at[tag].pop()
                start = out[first][3]
                del out[first:]
                for places in open_at.values():
                    while places and places[-1] >= first:
                        places.pop()
            elif not closing:
                open_at[tag].append(len(out))
            out.append((None, False, "", start, pos))
        else:
            out.append((None if tag in RAW else tag, closing, m[3] or "", start, pos))
    return out


def parse(page: str) -> Node:
    """The tree of block nodes. A node's text is a list of (string, whether inside a link) and child nodes, in order."""
    root = Node("html", None)
    stack = [(root, (0, 0, 0, 0))]  # open block nodes, with the walls around them
    walls = (0, 0, 0, 0)  # of each kind the number of the nearest wall around what comes next
    built = 0
    open_now: dict[tuple[str, int], int] = {}  # open nodes by tag and the wall around them
    links = at = 0

    def key(tag: str, around: tuple[int, ...]) -> tuple[str, int]:
        return tag, around[_KIND.get(tag, _CELL)]

    def pop() -> str:
        nonlocal walls
        node, walls = stack.pop()
        open_now[key(node.tag, walls)] -= 1
        return node.tag

    def add(raw: str) -> None:
        if raw:
            stack[-1][0].text.append((html.unescape(raw), links > 0))

    for tag, closing, attributes, start, end in tokens(page):
        add(page[at:start])
        at = end
        if tag is None:
            continue
        stack[-1][0].tags += 1
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _BLOCK:
            continue
        links = 0 if tag != "li" or closing else links
        if tag in ("html", "body"):
            if tag == "body" and not closing:
                _read_attributes(root, attributes)
            continue
        if closing:
            if tag == "table":  # the nearest table is the nearest wall of its kind itself
                while walls[_TABLE] and pop() != "table":
                    pass
            elif open_now.get(key(tag, walls)):
                while pop() != tag:
                    pass
            continue
        if stack[-1][0].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):  # a block ends a paragraph that was left open
            pop()
        for other in _ENDS.get(tag, ()):
            while open_now.get(key(other, walls)):
                pop()
        if tag == "hr":
            continue
        node = Node(tag, stack[-1][0], attributes)
        stack[-1][0].text.append(node)
        stack.append((node, walls))
        open_now[key(tag, walls)] = open_now.get(key(tag, walls), 0) + 1
        if tag in _WALLS:
            built += 1
            walls = tuple(built if k in _WALLS[tag] else w for k, w in enumerate(walls))
    add(page[at:])
    return root


def _read_attributes(node: Node, attributes: str) -> None:
    other = Node("body", None, attributes or "")
    node.good, node.bad = other.good, other.bad


def squeezed(parts: list[tuple[str, bool]]) -> str:
    return _SPACE.sub(" ", "".join(p[0] for p in parts)).strip()


def nodes_of(page: str) -> list[Node]:
    """All nodes in page order, parents first. Text is settled: nodes with blocks inside have none of their own, theirs
    lies in '#text' nodes."""
    root = parse(page)
    out: list[Node] = []
    work = [root]
    while work:
        node = work.pop()
        out.append(node)
        items = node.text
        blocks = [x for x in items if isinstance(x, Node)]
        if blocks or node is root:
            run: list = []
            children: list[Node] = []
            for x in [*items, None]:
                if isinstance(x, tuple):
                    run.append(x)
                    continue
                if run and any(p[0].strip() for p in run):
                    child = Node("#text", node)
                    child.text, child.mark = run, node.mark
                    children.append(child)
                run = []
                if x is not None:
                    children.append(x)
            node.children, node.text = children, []
            work += reversed(children)
    offset = 0
    for node in out:
        node.start = offset
        if node.text:
            whole = squeezed(node.text)
            node.chars = len(whole)
            node.links = min(node.chars, sum(len(p[0].strip()) for p in node.text if p[1]))
            node.words = whole.count(" ") + 1 if whole else 0
            node.stops = sum(whole.count(c) for c in ".,;:!?")
            node.paragraphs = int(node.tag == "p" and node.chars > 0)
            offset += node.chars
    for node in reversed(out):
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.words += node.words
            up.stops += node.stops
            up.tags += node.tags + 1
            up.paragraphs += node.paragraphs
    return out


def features(nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), WIDTH), dtype=np.float32)
    inherited: dict[int, tuple[int, tuple[int, ...], int, int]] = {}
    total = max(1, nodes[0].chars)
    place: dict[int, tuple[int, int, int, float]] = {id(nodes[0]): (0, 1, 1, float(total))}
    for node in nodes:
        if node.children:
            n = len(node.children)
            mean = sum(c.chars for c in node.children) / n
            alike: dict[str, int] = {}
            for c in node.children:
                alike[c.tag] = alike.get(c.tag, 0) + 1
            for k, c in enumerate(node.children):
                place[id(c)] = (k, n, alike[c.tag], mean)
    base = len(GROUPS) + len(UNDER)
    for r, node in enumerate(nodes):
        depth, under, good, bad = inherited[id(node.parent)] if node.parent is not None else (0, (0,) * len(UNDER), 0, 0)
        row = out[r]
        if (g := _GROUP.get(node.tag)) is not None:
            row[g] = 1
        under = tuple(x or node.tag == t for x, t in zip(under, UNDER))
        row[len(GROUPS) : base] = under
        k, n, alike, mean = place[id(node)]
        chars = max(1, node.chars)
        row[base:] = (
            depth, node.good, node.bad, good, bad, np.log1p(node.chars), np.log1p(node.words), node.links / chars, node.tags / chars * 100,
            node.stops / max(1, node.words), node.chars / total, node.paragraphs, node.start / total, (node.start + node.chars) / total,
            k / n, n, alike / n, np.log1p(mean), node.chars / max(1.0, mean), len(node.children), node.chars / max(1, node.words), np.log1p(total),
        )
        inherited[id(node)] = (depth + 1, under, good + node.good, bad + node.bad)
    return out


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[bool]:
    """The likeliest labelling in which a kept node's parent is kept. A dropped node's subtree is dropped whole."""
    keep = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    at = {id(n): i for i, n in enumerate(nodes)}
    as_kept, as_dropped = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        up = at[id(nodes[i].parent)]
        as_kept[up] += max(as_kept[i], as_dropped[i])
        as_dropped[up] += as_dropped[i]
    out = [False] * len(nodes)
    out[0] = True
    for i in range(1, len(nodes)):
        out[i] = bool(out[at[id(nodes[i].parent)]] and as_kept[i] >= as_dropped[i])
    return out


def extract(pages: list[str], trees: boosting.Boosted) -> list[str]:
    each = [nodes_of(p) for p in pages]
    if not each:
        return []
    odds = trees.log_odds(np.concatenate([features(n) for n in each]))
    out, at = [], 0
    for nodes in each:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        blocks = [squeezed(n.text) for n, ok in zip(nodes, kept) if ok and n.text]
        out.append("\n\n".join(b for b in blocks if b))
    return out


def training_pages(count: int = TRAINING_PAGES, seed: int = 11) -> list[str]:
    """Pages of many shapes, in which the elements of the main text bear data-label="1"."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p
    syllables = "an be con de er fa go hi in ja ka lo mi no or pa qu re si ta un ve wa xi yo zu".split()
    word = lambda: "".join(pick(*syllables) for _ in range(rng.integers(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))

    def prose(a: int, b: int) -> str:
        out = []
        for _ in range(rng.integers(a, b)):
            s = words(2, 22)
            if chance(0.1):
                w = s.split()
                s = " ".join([*w[:1], f'<a href="/{word()}">{word()}</a>', *w[1:]])
            out.append(s[0].upper() + s[1:] + pick(".", ".", ".", "!", "?"))
        return " ".join(out)

    named = lambda *x: f' class="{pick(*x)}"' if chance(0.75) else f' id="{pick(*x)}"' if chance(0.4) else ""
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(rng.integers(a, b)))

    def junk() -> str:
        kind = rng.integers(10)
        if kind == 0:
            return f"<{(t := pick('nav', 'div', 'ul'))}{named('menu', 'nav', 'navbar', 'top-menu')}>{'' if t == 'ul' else '<ul>'}{links(2, 9)}{'' if t == 'ul' else '</ul>'}</{t}>"
        if kind == 1:
            t = pick("div", "aside", "section", "p")
            inside = prose(1, 3) if t == "p" or chance(0.6) else f"<p>{prose(1, 3)}</p>"
            return f'<{t} class="{pick("ad", "ads", "advert", "banner", "sponsored", "promo")}">{inside}</{t}>'
        if kind == 2:
            return f"<{(t := pick('aside', 'div'))}{named('sidebar', 'side', 'related', 'widget')}><h3>{words(1, 4)}</h3><ul>{links(2, 7)}</ul>{f'<p>{prose(1, 3)}</p>' if chance(0.4) else ''}</{t}>"
        if kind == 3:
            return f'<div class="{pick("cookie-notice", "notice", "consent", "alert", "gdpr cookie")}"><p>{prose(1, 3)}</p>{"<button>ok</button>" if chance(0.5) else ""}</div>'
        if kind == 4:
            return f"<form{named('search', 'login', 'newsletter', 'subscribe')}><label>{words(1, 5)}</label><input>{f'<p>{prose(1, 2)}</p>' if chance(0.4) else ''}<button>{word()}</button></form>"
        if kind == 5:
            t = pick("section", "div", "ol", "ul")
            item = "li" if t in ("ol", "ul") else pick("div", "article", "p")
            return f'<{t} {pick("class", "id")}="{pick("comments", "comment-list", "replies", "reader-comments", "discussion")}">' + "".join(f'<{item}{named("comment", "reply")}>{prose(1, 4) if item == "p" or chance(0.5) else f"<p>{prose(1, 4)}</p>"}</{item}>' for _ in range(rng.integers(1, 5))) + f"</{t}>"
        if kind == 6:
            return f'<div class="{pick("share", "social", "breadcrumb", "tags", "pagination")}">' + " ".join(f'<a href="#">{word()}</a>' for _ in range(rng.integers(2, 6))) + "</div>"
        if kind == 7:
            return f"<header{named('site-header', 'masthead', 'header')}>{pick('<div>', '<p>')}{words(1, 6)}{f'<ul>{links(2, 5)}</ul>' if chance(0.5) else ''}</header>"
        if kind == 8:
            return f"<div{named('newsletter', 'signup', 'popup', 'modal')}><h4>{words(2, 5)}</h4><p>{prose(1, 2)}</p><form><input><button>{word()}</button></form></div>"
        return f"<table{named('menu', 'links', 'nav')}><tr>" + "".join(f'<td><a href="/{word()}">{word()}</a></td>' for _ in range(rng.integers(2, 6))) + "</tr></table>"

    def block(first: bool = False) -> str:
        m = ' data-label="1"'
        kind = rng.random()
        if first and chance(0.85):
            return f"<{(h := pick('h1', 'h1', 'h2'))}{m}>{words(2, 12)}</{h}>"
        if kind < 0.72:
            text = prose(1, 7) if chance(0.8) else words(1, 9)
            if chance(0.15):
                return f"<p{m}><b>{text}<br>" if chance(0.6) else f"<p{m}>{text}"
            return f"<p{m}>{text}</p>"
        if kind < 0.8:
            return f"<h2{m}>{words(1, 7)}</h2>"
        if kind < 0.87:
            return f"<{(t := pick('ul', 'ol'))}{m}>" + "".join(f"<li{m}>{words(2, 14)}</li>" for _ in range(rng.integers(2, 6))) + f"</{t}>"
        if kind < 0.92:
            return f"<blockquote{m}>{f'<p{m}>{prose(1, 4)}</p>' if chance(0.5) else prose(1, 4)}</blockquote>"
        if kind < 0.95:
            return f"<table{m}>" + "".join(f"<tr{m}>" + "".join(f"<td{m}>{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.integers(2, 4))) + "</table>"
        return f"<div{m}>{prose(1, 4)}</div>"

    out = []
    for _ in range(count):
        inside = []
        for k in range(int(rng.integers(1, 14)) if chance(0.9) else int(rng.integers(14, 40))):
            inside.append(block(k == 0))
            if k == 0 and chance(0.2):  # a short text that repeats its heading
                inside.append(f'<p data-label="1">{_BARE.sub("", inside[0])}</p>')
                if chance(0.3):
                    break
            if chance(0.05):
                inside.append(junk())
        if chance(0.25):
            inside.append(junk())
        body = "".join(inside)
        t = pick("article", "article", "main", "div", "div", "section", "td")
        if t in ("article", "main") and chance(0.6):
            main = f"<{t}>{body}</{t}>"
        elif t == "td":
            main = f"<table><tr><td>{body}</td></tr></table>"
        else:
            main = f"<{t}{named('content', 'post', 'entry-content', 'article-body', 'main', 'story', 'text')}>{body}</{t}>"
        for _ in range(rng.integers(0, 3)):
            main = f"<div{named('container', 'wrap', 'page', 'row')}>{junk() if chance(0.4) else ''}{main}{junk() if chance(0.4) else ''}</div>" if chance(0.6) else main
        before = "".join(junk() for _ in range(rng.integers(0, 4)))
        after = "".join(junk() for _ in range(rng.integers(0, 4)))
        if chance(0.85):
            t = pick("footer", "footer", "footer", "div")
            after += f"<{t}{' class=' + chr(34) + 'footer' + chr(34) if t == 'div' else ''}>{pick('', '&copy; ')}{word()}.example &middot; {prose(1, 3) if chance(0.6) else words(1, 9)}</{t}>"
        out.append(f"<html><head><title>{words(2, 8)}</title></head><body>{before}{main}{after}</body></html>")
    return out


@lru_cache(maxsize=2)
def trained(count: int = TRAINING_PAGES) -> boosting.Boosted:
    x, y = [], []
    for page in training_pages(count):
        nodes = nodes_of(page)
        label = np.zeros(len(nodes))
        at = {id(n): i for i, n in enumerate(nodes)}
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].mark:
                label[i] = 1
            if label[i] and nodes[i].parent is not None:
                label[at[id(nodes[i].parent)]] = 1
        x.append(features(nodes))
        y.append(label)
    return boosting.fit(np.concatenate(x), np.concatenate(y), trees=90, depth=5, rate=0.15)


def main_text(pages: DataFrame, column: str = "html", trees: boosting.Boosted | None = None) -> DataFrame:
    """pages' columns (an own `text` is replaced) and text: the page's main text, empty if there is none."""
    own = trees or trained()

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        out: list[str] = []
        for at in range(0, len(batch), PAGES):
            out += extract(batch.slice(at, PAGES).to_pylist(), own)
        return pa.array(out, pa.string())

    return pages.withColumn("text", run(F.coalesce(pages[column].cast("string"), F.lit(""))))


def op7(pages: DataFrame) -> DataFrame:
    out = main_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
