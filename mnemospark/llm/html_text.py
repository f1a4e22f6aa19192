"""Main text of web pages with gradient-boosted trees over DOM nodes.

A tolerant parser builds the tree of block elements and their text blocks. For each node the model sees its
own and its ancestors' elements, tokens of class, id and role, depth, the density of text and links in its
subtree, and how it compares with its siblings. Boosted trees give a log-odds of being main text to each
node. Decoding takes a subtree as a whole or leaves it as a whole or decides for its parts, whichever gives
the highest total, so an ancestor and a descendant never contradict each other.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, through_python
from .html_pages import pages

TRAIN_PAGES, TREES, DEPTH, RATE, BINS = 800, 60, 4, 0.2, 32
SPLIT_COST = 1.5

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
#: Elements by kind.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption button select option label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea title head".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
             "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
             "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "option": frozenset(("option",))}
SCOPE = frozenset("table td th ul ol div article section body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KINDS = tuple("article main section div p h1 h2 h3 h4 ul ol li table td blockquote pre nav header footer aside form button label body figure".split())
GOOD = tuple("content article post entry story main body text prose page blog hentry".split())
BAD = tuple(("nav menu breadcrumb toc pag tabs header masthead brand banner top logo footer bottom copyright legal colophon side aside widget relat recommend trend popular tag author archive ad ads "
             "advert sponsor promo cookie consent gdpr notice alert popup modal newsletter subscri overlay message search login signup form comment discuss repl respons disqus review share social shar follow meta byline").split())


class Node:
    __slots__ = ("tag", "names", "up", "kids", "parts", "marked", "chars", "linked", "words", "stops", "blocks", "depth")

    def __init__(self, tag: str, names: str, up: "Node | None", marked: bool = False):
        self.tag, self.names, self.up, self.marked = tag, names, up, marked
        self.kids: list[Node] = []
        self.parts: list = []  # text blocks (str) and child nodes in page order
        self.depth = up.depth + 1 if up else 0


def _names(attrs: str) -> str:
    if "=" not in attrs:
        return ""
    return " ".join(a or b or c for k, a, b, c in _ATTR.findall(attrs) if k.lower() in ("class", "id", "role", "itemprop", "aria-label")).lower()


def parse(page: str | None) -> Node:
    """The tree of block elements of a page; null: an empty one. Inline elements only count their links.

    The open elements are a stack with an index by name, so neither an end tag nor a new block searches it."""
    root = Node("body", "", None)
    page = page or ""
    here, run, linked = root, [], []
    open_tags: list[tuple[str, Node | None]] = []  # element and its node (None: inline)
    places: dict[str, list[int]] = {}  # of each name in the stack
    blocks: list[int] = []  # places of block elements
    bounds: list[int] = []  # places of elements that end at, or stop, a new block
    never_ended: set[str] = set()
    in_link = 0
    tallies: dict[int, int] = {}

    def flush():
        nonlocal run, linked
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                here.parts.append(text)
                tallies[id(here), len(here.parts) - 1] = sum(linked)
        run, linked = [], []

    def pop_to(k: int):
        nonlocal here, in_link
        for tag, node in reversed(open_tags[k:]):
            if node is not None:
                flush()
                here = node.up
            elif tag == "a":
                in_link = max(0, in_link - 1)
            places[tag].pop()
        del open_tags[k:]
        for stack in (blocks, bounds):
            while stack and stack[-1] >= k:
                stack.pop()

    def push(tag: str, node: Node | None):
        at = len(open_tags)
        open_tags.append((tag, node))
        places.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            blocks.append(at)
        if tag in SCOPE or tag in CLOSED_BY:
            bounds.append(at)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            run.append(text)
            if in_link:
                linked.append(len(text.strip()))
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in ("html", "body"):
                continue
            same = HEADINGS if tag in HEADINGS else (tag,)
            k = max((places[t][-1] for t in same if places.get(t)), default=-1)
            if k >= 0 and (tag in BLOCKS or not blocks or blocks[-1] < k):  # an inline end tag stays within its block
                pop_to(k)
            continue
        if tag in RAW:
            if tag != "head":  # its elements are met one by one
                end = None if tag in never_ended else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if not end:
                    never_ended.add(tag)
                at = end.end() if end else n if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in ("html", "body"):
            names = _names(m.group(3))
            root.names = (root.names + " " + names).strip()
            continue
        if tag in BLOCKS:
            for k in reversed(bounds):  # few: each kind closes itself or stops the search
                own = open_tags[k][0]
                if own in CLOSED_BY and tag in CLOSED_BY[own]:
                    pop_to(k)
                    break
                if own in SCOPE and not (own in ("td", "th") and tag in CLOSED_BY["td"]):
                    break
            flush()
            if tag == "hr":
                continue
            node = Node(tag, _names(m.group(3)), here, "\x01" in m.group(3) or here.marked)
            here.kids.append(node)
            here.parts.append(node)
            here = node
            push(tag, node)
        else:
            push(tag, None)
            in_link += tag == "a"
    flush()
    _measure(root, tallies)
    return root


def _measure(root: Node, tallies: dict) -> None:
    order = [root]
    for node in order:
        order += node.kids
    for node in reversed(order):
        own = [p for p in node.parts if isinstance(p, str)]
        node.chars = sum(map(len, own)) + sum(k.chars for k in node.kids)
        node.linked = sum(tallies.get((id(node), i), 0) for i, p in enumerate(node.parts) if isinstance(p, str)) + sum(k.linked for k in node.kids)
        node.words = sum(t.count(" ") + 1 for t in own) + sum(k.words for k in node.kids)
        node.stops = sum(t.count(".") + t.count(",") + t.count("?") + t.count("!") for t in own) + sum(k.stops for k in node.kids)
        node.blocks = len(own) + sum(k.blocks for k in node.kids)


class Flags(dict):
    """What an element and its names tell, by (tag, names)."""

    def __missing__(self, key: tuple) -> tuple:
        if len(self) > 50_000:
            self.clear()
        self[key] = out = _token_flags(*key)
        return out


def _token_flags(tag: str, names: str) -> tuple:
    words = re.findall(r"[a-z]+", names)
    good = sum(w.startswith(g) for w in words for g in GOOD)
    bad = sum(w == b if len(b) < 4 else w.startswith(b) for w in words for b in BAD)
    groups = [any(w.startswith(x) for w in words for x in g) for g in (("comment", "discuss", "repl", "respons", "review"), ("side", "widget", "relat", "recommend"), ("cookie", "consent", "notice", "modal", "popup"))]
    return (*[float(tag == k) for k in KINDS], min(good, 3), min(bad, 3), float(bool(names)), *map(float, groups), float(any(w in ("ad", "ads") or w.startswith(("advert", "sponsor", "promo")) for w in words)))


def features(root: Node, flags: Flags) -> tuple[list[Node], np.ndarray]:
    """Nodes in page order and one row of numbers for each."""
    nodes, rows = [], []
    total = max(1, root.chars)
    most = len(KINDS)
    stack = [(root, 0, 1, (0.0,) * 8, 0.0, 1)]
    while stack:
        node, place, n, above, prev, same = stack.pop()
        own = flags[node.tag, node.names]
        up = node.up or node
        nodes.append(node)
        mean = up.chars / max(1, len(up.kids))
        rows.append((*own, *above, min(node.depth, 12), node.chars, node.chars / total, node.linked / max(1, node.chars), node.words / max(1, node.blocks), node.stops / max(1, node.words),
                     node.blocks, len(node.kids), node.chars / max(1, up.chars), place / max(1, n), n, same, node.chars / (mean + 1), prev, up.linked / max(1, up.chars), up.chars / total))
        good, bad = own[most], own[most + 1]
        t = node.tag
        here = (max(above[0], t in ("article", "main")), max(above[1], t in ("nav", "header", "footer", "aside", "form", "button", "label", "select")), above[2] + good, above[3] + bad,
                max(above[4], own[most + 3]), max(above[5], own[most + 4]), max(above[6], own[most + 5]), max(above[7], own[most + 6]))
        kids = node.kids
        alike = Counter(k.tag for k in kids)
        stack += [(k, i, len(kids), here, float(kids[i - 1].chars) if i else 0.0, alike[k.tag]) for i, k in reversed(list(enumerate(kids)))]
    return nodes, np.array(rows, np.float32)


class Boosted:
    """Gradient-boosted trees for log-odds: histogram splits, depth-wise, Newton leaves."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.n, self.depth, self.rate, self.bins, self.trees, self.base = trees, depth, rate, bins, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> "Boosted":
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.int64)  # code > k: x > edges[k]
        self.base = float(np.log((w * y).sum() / (w * (1 - y)).sum()))
        f = np.full(len(x), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * p * (1 - p)
            node = np.zeros(len(x), np.int64)
            split = [(0, np.inf)] * (2 ** self.depth - 1)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-3)
                pick: list = [None] * n
                gt, ht = (np.bincount(node, weights=v, minlength=n) for v in (g, h))
                for j in range(x.shape[1]):
                    if not len(edges[j]):
                        continue
                    k = len(edges[j]) + 1
                    at = node * k + code[:, j]
                    gs, hs = (np.bincount(at, weights=v, minlength=n * k).reshape(n, k).cumsum(1)[:, :-1] for v in (g, h))
                    gain = gs**2 / (hs + 1) + (gt[:, None] - gs) ** 2 / (ht[:, None] - hs + 1) - (gt**2 / (ht + 1))[:, None]
                    gain[(hs < 1) | (ht[:, None] - hs < 1)] = 0
                    top = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(n), top] > best):
                        best[i], pick[i] = gain[i, top[i]], (j, float(edges[j][top[i]]))
                for i, s in enumerate(pick):
                    if s:
                        split[first + i] = s
                go = np.zeros(len(x), np.int64)
                for i in range(n):
                    j, t = split[first + i]
                    m = node == i
                    go[m] = x[m, j] > t
                node = 2 * node + go
            gs, hs = (np.bincount(node, weights=v, minlength=2**self.depth) for v in (g, h))
            leaf = self.rate * gs / (hs + 1)
            self.trees.append((np.array([s[0] for s in split]), np.array([s[1] for s in split], np.float32), leaf))
            f += leaf[node]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for which, at, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = 2**level - 1 + node
                node = 2 * node + (x[rows, which[k]] > at[k])
            out += leaf[node]
        return out


def train(n_pages: int = TRAIN_PAGES, seed: int = 1) -> Boosted:
    """Fits on made-up pages; a node is main text if most of its characters are."""
    xs, ys, flags = [], [], Flags()
    for page in pages(n_pages, seed):
        nodes, x = features(parse(page), flags)
        own = {}
        for node in reversed(nodes):
            mine = sum(len(p) for p in node.parts if isinstance(p, str)) * node.marked + sum(own[id(k)] for k in node.kids)
            own[id(node)] = mine
        keep = [i for i, node in enumerate(nodes) if node.chars]
        xs.append(x[keep])
        ys += [own[id(nodes[i])] * 2 > nodes[i].chars for i in keep]
    x, y = np.concatenate(xs), np.array(ys, float)
    return Boosted().fit(x, y, np.ones(len(y)))


def decode(nodes: list[Node], odds: np.ndarray, cost: float = SPLIT_COST) -> list[str]:
    """Text blocks of the subtrees that are kept, in page order."""
    at = {id(node): i for i, node in enumerate(nodes)}
    whole, best, plan = np.zeros(len(nodes)), np.zeros(len(nodes)), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        kids = [at[id(k)] for k in node.kids if k.chars]
        own = float(np.clip(odds[i], -6, 6))
        texts = any(isinstance(p, str) for p in node.parts)
        direct = own if texts or not kids else 0.25 * own
        whole[i] = direct + whole[kids].sum()
        apart = (abs(own) if texts else 0.0) + best[kids].sum() - cost if kids else -np.inf
        options = (whole[i], -whole[i], apart)
        plan[i] = int(np.argmax(options))
        best[i] = options[plan[i]]
    out: list[str] = []

    def walk(i: int, mode: int):
        todo = [(nodes[i], mode)]
        while todo:
            node, how = todo.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            k = at[id(node)]
            how = plan[k] if how == 2 else how
            if how == 1:
                continue
            own = how == 0 or odds[k] > 0
            for p in reversed(node.parts):
                if isinstance(p, str):
                    if own:
                        todo.append((p, 0))
                elif p.chars:
                    todo.append((p, 0 if how == 0 else 2))

    if nodes:
        walk(0, 2)
    return out


def main_texts(batch: list[str | None], model: Boosted, flags: Flags) -> list[str]:
    trees = [features(parse(p), flags) for p in batch]
    odds = model.log_odds(np.concatenate([x for _, x in trees])) if trees else np.zeros(0)
    out, a = [], 0
    for nodes, x in trees:
        out.append("\n".join(decode(nodes, odds[a:a + len(x)])))
        a += len(x)
    return out


_TRAINED: list[Boosted] = []


def extract(pages_table: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text (blocks joined by one newline; empty if there is no main
    text), n_chars. Null and empty html give an empty text; a null url stays null; repeated rows repeat; an
    empty table gives an empty result; other columns are not read. The page is read whole."""
    if model is None:
        if not _TRAINED:  # once per driver: it depends on nothing but the constants above
            _TRAINED.append(train())
        model = _TRAINED[0]
    kind = pages_table.schema["page_id"].dataType.simpleString()
    shared = pages_table.sparkSession.sparkContext.broadcast((model.trees, model.base, model.depth))  # fixed size

    def work():
        own = Boosted()
        own.trees, own.base, own.depth = shared.value
        flags = Flags()

        def each(part: pa.RecordBatch) -> dict:
            texts = main_texts(part.column(2).to_pylist(), own, flags)
            return {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    return through_python(pages_table.select("page_id", "url", "html"), work, f"page_id {kind}, url string, text string, n_chars long", rows=64)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
