"""Main text of pages by a tree-structured graphical model over the DOM.

Block elements and pieces of text are nodes, each content or not. A node has a potential
from its own features (tag, names, length, links) and shares one with its parent, for each
kind of node. Sum-product messages go up to the root and down again, which gives every
piece's marginal; pieces more likely content than not are the text. All potentials are
trained from labelled pages: the nodes' by logistic regression, the pairs' by how often
labels of parents and children go together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .html_pages import CONTENT, OTHER, pages
from .store import map_arrow

#: Labelled pages trained on, and the seed they come from.
TRAINING_PAGES, SEED = 1500, 11

#: Elements of HTML.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html ins legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea noembed noframes xmp title".split())
HIDDEN = frozenset("button select option object svg canvas audio video map datalist math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TELLING = frozenset("nav aside footer header form article main section".split())
#: Which open elements a start tag ends, and what stops the search for them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Words in class and id names that tell what a part is.
NAMES = {
    "ad": "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion banner adslot", "menu": "nav navigation menu breadcrumb breadcrumbs tabs pagination pager toc navbar sitemap",
    "head": "header masthead topbar site title logo top", "foot": "footer copyright bottom colophon legal", "side": "sidebar aside widget column related recommended recirc trending popular more",
    "notice": "cookie consent notice alert disclaimer newsletter subscribe paywall gdpr popup modal signup", "share": "share social tags tag sharing follow twitter facebook",
    "comment": "comment comments reply replies disqus respond reviews review discussion thread", "form": "form search login register input contact",
    "main": "article content post entry story main text body page prose",
}
_GROUP = {word: group for group, words in NAMES.items() for word in words.split()}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Ends of elements whose content isn't markup; searched for in the page itself, as lower() may change its length.
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}


class Node:
    __slots__ = ("children", "features", "kind", "links", "names", "near", "parent", "parts", "says", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, names: tuple[str, ...] = ()):
        self.tag, self.parent, self.names = tag, parent, names
        self.children: list[Node] = []
        self.parts: list[str] | None = None
        self.size = self.links = 0
        if parent is not None:
            parent.children.append(self)


def _named(attributes: str) -> tuple[str, ...]:
    found = set()
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            found.add("hidden")
        elif name != "style":
            found.update(_GROUP[w] for w in _WORDS.findall(value) if w in _GROUP)
    return tuple(sorted(found))


def parse(html: str) -> Node:
    """The tree of block elements; text pieces are leaves of tag #text, in page order."""
    root = Node("#root", None)
    stack: list[tuple[str, Node, bool, bool]] = [("#root", root, False, False)]  # tag, block, hidden, link
    piece: Node | None = None
    at = 0
    # what is open, so that no tag looks through the stack in vain
    blocks_at = [0]  # places of blocks in the stack
    open_blocks: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]  # other elements, since each of these blocks

    def text(raw: str) -> None:
        nonlocal piece
        tag, block, hidden, link = stack[-1]
        if hidden or not raw:
            return
        if piece is None or piece.parent is not block:
            if not raw.strip():
                return
            piece = Node("#text", block)
            piece.parts = []
        words = unescape(raw) if "&" in raw else raw
        piece.parts.append(words)
        n = len(words)
        piece.size += n
        if link:
            piece.links += n

    def close_to(k: int) -> None:
        nonlocal piece
        for name, *_ in reversed(stack[k:]):
            if name in BLOCKS:
                piece = None
                open_blocks[name] -= 1
                blocks_at.pop()
                inline.pop()
            else:
                inline[-1][name] -= 1
        del stack[k:]

    while True:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            return root
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "br":
                text(" ")
            elif name in HEADINGS:
                if any(open_blocks[h] for h in HEADINGS):
                    close_to(next(k for k in reversed(blocks_at) if stack[k][0] in HEADINGS))
            elif open_blocks[name] if name in BLOCKS else inline[-1][name]:
                close_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            continue
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            if end is None:
                return root
            at = html.find(">", end.end()) + 1 or len(html)
            continue
        if name == "br":
            text(" ")
            continue
        is_block = name in BLOCKS
        if is_block:
            piece = None
            if name in ENDS:
                ended, stops = ENDS[name]
                for k in reversed(blocks_at) if any(open_blocks[e] for e in ended) else ():
                    if stack[k][0] in stops:
                        break
                    if stack[k][0] in ended and (k == 1 or stack[k - 1][0] not in ended):
                        close_to(k)
                        break
            else:
                k = blocks_at[-1]
                if k and (stack[k][0] == "p" or (name in HEADINGS and stack[k][0] in HEADINGS)):
                    close_to(k)
        # head shows nothing of its own, and what isn't head content ends it, </head> or not: it is no element here
        if name in VOID or name == "head" or m[0].endswith("/>") and name in HIDDEN:
            continue
        tag, block, hidden, link = stack[-1]
        if is_block:
            block = Node(name, block, _named(m[3] or ""))
            blocks_at.append(len(stack))
            open_blocks[name] += 1
            inline.append(Counter())
        else:
            inline[-1][name] += 1
        stack.append((name, block, hidden or name in HIDDEN, link or name == "a"))


def flat(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order; sizes summed upwards, kinds and features set."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(out):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
    for node in out:
        node.kind = "text" if node.parts is not None else node.tag if node.tag in ("p", "li", "td", "div") else "head" if node.tag in HEADINGS else "block"
        if node.parent is None or node.parent.tag in ("#root", "html", "body"):
            node.kind = "top"
        told = node.names + ((node.tag,) if node.tag in TELLING else ())
        # a part that holds most of the page's text isn't what its name says
        share = "most" if 2 * node.size > root.size else "some" if 5 * node.size > root.size else "little"
        node.says = [f"around {n} {share}" for n in told]
        node.near = [f"near {n} {share}" for n in told] or (node.parent.near if node.parent is not None else ["near none"])
        node.features = _features(node)
    return out


def all_features(node: Node) -> list[str]:
    """The node's own features, and what each element around it says of itself."""
    out, kind = list(node.features), "text " if node.parts is not None else ""
    while node.parent is not None:
        node = node.parent
        out += [kind + x for x in node.says]
    return out


def _features(node: Node) -> list[str]:
    density = min(3, int(4 * node.links / node.size)) if node.size else 4
    size = min(9, node.size.bit_length())
    place = node.parent.near if node.parent is not None else ["near none"]
    if node.parts is None:
        out = [*place, f"tag {node.tag}", f"size {size}", f"links {density}", f"links {density} size {size // 2}"]
        out += [f"name {n}" for n in node.names] or ["name none"]
        if node.tag in ("div", "section", "p", "ul", "aside"):
            out += [f"{node.tag} name {n}" for n in node.names] or [f"{node.tag} name none"]
        return out
    words = "".join(node.parts)
    ends = words.rstrip()[-1:] in ".!?:;\"”»"
    out = [*(f"text {x}" for x in place), f"text size {size}", f"text links {density}", f"text in {node.parent.tag}", f"text in {node.parent.tag} links {density}", f"text ends {ends}"]
    if "©" in words or "copyright" in words.lower():
        out.append("text copyright")
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    pairs: dict[str, tuple[float, float, float, float]]  # by kind of the child: parent 0 child 0, 0 1, 1 0, 1 1


def _soft(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Log odds of being content for each node (parents before children), by exact sum-product."""
    index = {id(n): k for k, n in enumerate(nodes)}
    w, bias = model.weights, model.bias
    said = [(0.0, 0.0)] * len(nodes)  # what the elements around say, for elements and for text
    own = []
    for k, n in enumerate(nodes):
        if n.parent is not None:
            a, b = said[index[id(n.parent)]]
            said[k] = (a + sum([w.get(f, 0.0) for f in n.parent.says]), b + sum([w.get(f"text {f}", 0.0) for f in n.parent.says])) if n.parent.says else (a, b)
        own.append(bias + said[k][n.parts is not None] + sum([w.get(f, 0.0) for f in n.features]))
    up = own[:]  # with all messages from below
    sent = [0.0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        p00, p01, p10, p11 = model.pairs[n.kind]
        b = up[k]
        sent[k] = _soft(p10, p11 + b) - _soft(p00, p01 + b)
        up[index[id(n.parent)]] += sent[k]
    full = up[:]
    for k in range(1, len(nodes)):
        n = nodes[k]
        p00, p01, p10, p11 = model.pairs[n.kind]
        parent = full[index[id(n.parent)]] - sent[k]
        full[k] = up[k] + _soft(p01, p11 + parent) - _soft(p00, p10 + parent)
    return full


def train(labelled: Iterator[str] | None = None, rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> Model:
    """Potentials from labelled pages (html with CONTENT and OTHER marks); the same for the same pages."""
    labelled = pages(TRAINING_PAGES, SEED) if labelled is None else labelled
    rows, labels, joint = [], [], {}
    for html in labelled:
        nodes, label = labelled_nodes(html)
        for n in nodes:
            y = label[id(n)]
            if y is None:
                continue
            rows.append(all_features(n))
            labels.append(y)
            if n.parent is not None and label[id(n.parent)] is not None:
                joint.setdefault(n.kind, Counter())[label[id(n.parent)], y] += 1
    names = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    size = [len(r) for r in rows]
    cols = np.array([names[f] for r in rows for f in r])
    at = np.repeat(np.arange(len(rows)), size)
    y = np.array(labels, float)
    w, b = np.zeros(len(names)), 0.0
    square, square_b = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(at, w[cols], len(rows))
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        grad = np.bincount(cols, g[at], len(names)) + decay * w
        square, square_b = square + grad**2, square_b + g.sum() ** 2
        w -= rate * grad / np.sqrt(square)
        b -= rate * g.sum() / math.sqrt(square_b)
    pairs = {}
    for kind in ("text", "p", "li", "td", "div", "head", "block", "top"):
        c = joint.get(kind, Counter())
        n = {(p, q): c[p, q] + 1.0 for p in (0, 1) for q in (0, 1)}
        total = sum(n.values())
        pairs[kind] = tuple(math.log(n[p, q] * total / ((n[p, 0] + n[p, 1]) * (n[0, q] + n[1, q]))) for p in (0, 1) for q in (0, 1))
    return Model({f: float(w[i]) for f, i in names.items()}, float(b), pairs)


def labelled_nodes(html: str) -> tuple[list[Node], dict[int, int | None]]:
    """Nodes of a labelled page, and their labels by id(): those of text by its mark, which is taken
    off, those of elements by most of their text; None where there is none."""
    root = parse(html)
    content: dict[int, int] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.children)
    for n in order:
        if n.parts is not None:
            text = "".join(n.parts)
            plain = text.replace(CONTENT, "").replace(OTHER, "")
            n.parts, n.size = [plain], len(plain)
            content[id(n)] = len(plain) if CONTENT in text else 0
    nodes = flat(root)
    for n in reversed(nodes):
        if n.parts is None:
            content[id(n)] = sum(content[id(c)] for c in n.children)
    return nodes, {id(n): int(2 * content[id(n)] > n.size) if n.size else None for n in nodes}


def extract(html: str | None, model: Model) -> str:
    """Content pieces in page order: white space in one as one space, trimmed, joined by line ends."""
    if not html:
        return ""
    nodes = flat(parse(html))
    out = []
    for n, odds in zip(nodes, marginals(nodes, model), strict=True):
        if n.parts is not None and odds > 0:
            words = " ".join("".join(n.parts).split())
            if words:
                out.append(words)
    return "\n".join(out)


def extract_pages(df: DataFrame, model: Model, html: str = "html", text: str = "text") -> DataFrame:
    """`df` without `html` and with `text`, the main text of each page.

    Null and empty pages, and pages without content, have empty text. Rows are independent;
    a column named `text` is replaced and others pass through.
    """
    cols = [c for c in df.columns if c not in (html, text)]
    schema = T.StructType([*df.select(*cols).schema.fields, T.StructField(text, T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([extract(v.as_py(), model) for v in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*cols, text])

    return map_arrow(df.select(*cols, html), apply, schema)
