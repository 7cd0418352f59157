"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read once into text blocks with the elements around them. A logistic classifier over a block's tag, length,
punctuation, links and attribute words gives log odds of being content, which become capacities to the two terminals.
Edges for smoothness join blocks that follow one another and blocks that are neighbours under one DOM element. A minimum
cut then labels the blocks. Blocks whose terminal capacity outweighs all their edges are labelled at once and their
edges folded into their neighbours' terminals, which changes no minimum cut; maximum flow decides the rest.

The classifier is fitted to pages that mark their article by an element or a role: blocks within it are content, others
are not, and the mark itself is no feature. At most `sample_pages` pages and `sample_blocks` blocks of each are used.
The capacity of a kind of edge is half the log odds that its ends have one label on these pages, so that both kinds of
capacity are on one scale. Weights and capacities start from those of `DEFAULT`, which hold where no page is marked.

What the result must not hold by its definition has fixed log odds: menus, footers, sidebars, forms and hidden elements
are never content, nor page headers; words in attributes that name nothing but such a part (cookie, sidebar, comments)
count strongly against all that an element holds, unless it wraps the page: it holds most of the text of the page's main
or article elements, or, on a page that has none, most of its text. Words that an article's own parts may have (menu,
notice, a single comment or reply) are features with a weight each, fitted to how often marked articles hold them, so
that text and neighbours decide; two or more comments or replies under one element are readers' and count strongly.
Words that may as well belong to an article (legal, related, share) are only features.
Within a block, runs of text in inline elements that are hidden or marked as boilerplate are left out.

Defined results: null or empty html, or a page without content, gives empty text; broken markup never fails (unclosed
elements end with their parents, unmatched end tags are ignored); equal pages give equal text; extra columns are
carried if named.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from html import unescape
from math import log1p
from operator import mul
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.text import slices

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][^\s/><]*)([^>]*)>?", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the value's kinds ends where one of the key begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Fixed log odds of content. Elements and roles that never hold the main text:
NEVER = -60.0
NEVER_TAGS = frozenset("nav footer aside form button select option template svg canvas object dialog menu search head audio video".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
PAGE_HEADER, IN_ARTICLE, BESIDE_ARTICLE, NAMED, HINT_GOOD = -8.0, 3.0, -3.5, -12.0, 1.0
#: Words that name what the text is to be without.
NAMED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored nav navbar navigation sidebar footer header masthead topbar cookie cookies consent "
    "gdpr newsletter subscribe signup comments commentlist replies disqus breadcrumb breadcrumbs pagination pager".split()
)
#: Words that name such parts on many pages and parts of the article on others; those of a thread count as NAMED if repeated.
DOUBTFUL_WORDS = ("menu", "notice", "notification", "subscription", "comment", "reply", "respond", "aside", "paging")
REPEATED = frozenset(("comment", "reply", "respond"))
#: Words that are more often beside an article than in one.
BESIDE_WORDS = frozenset(
    "promo promotion promoted banner alert popup modal overlay social share sharing related recommend recommended recommendations discussion widget login register copyright legal "
    "disclaimer skip toolbar tags taglist hidden".split()
)
GOOD_WORDS = frozenset("article content post entry story main body text maincontent articlebody".split())
#: Sections of these words may hold more text than the article: they wrap a page only if hardly any text is outside.
THREAD_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus related recommend recommended recommendations".split())
MOST, NEARLY_ALL = 0.5, 0.9
#: A block below this for its elements alone is not content, whatever it says, and says nothing about others.
NEIGHBOURLY = -5.0
#: Kinds of edges: following one another, and so under one element; neighbours under one element; under one grandparent.
FOLLOWS, FOLLOWS_SAME, SIBLING, COUSIN = range(4)
FEATURES = ("one", "paragraph", "heading", "item", "cell", "words", "links", "sentence", "beside", *DOUBTFUL_WORDS)
LEAST_CAPACITY, MOST_CAPACITY = 0.05, 1.5


class Model(NamedTuple):
    """A weight for each of FEATURES and a capacity for each kind of edge."""

    weights: tuple[float, ...]
    capacities: tuple[float, ...]


DEFAULT = Model((-1.0, 1.0, 0.6, -0.2, -0.4, 0.55, -3.0, 0.4, -1.0, *[-4.0] * len(DOUBTFUL_WORDS)), (0.4, 0.9, 0.9, 0.4))
#: Of the weights: how firmly DEFAULT holds. The share of content, and how long it is, differ from page to page.
PRECISIONS = (10.0, 1.0, 1.0, 1.0, 1.0, 10.0, 1.0, 1.0, 1.0, *[1.0] * len(DOUBTFUL_WORDS))


class Element:
    """hard and soft are an element's own log odds, bias those of all elements around it too; named are the doubtful words
    of all of them. Soft ones and words fall away from elements that wrap the page (`settle`)."""

    __slots__ = ("named", "tag", "hard", "soft", "thread", "beside", "doubtful", "marked", "article", "link", "parent", "block", "bias", "mute", "size", "main_size")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag, self.parent = tag, parent
        self.article, self.link, self.beside = (parent.article, parent.link, parent.beside) if parent else (False, False, False)
        self.hard = self.soft = self.bias = self.mute = 0.0
        self.thread, self.named = False, frozenset()
        self.size = self.main_size = 0
        self.block = tag in BLOCK
        if tag == "a":
            self.link = True
        elif tag in ("article", "main"):
            self.article = True
        elif tag == "form":
            self.soft += NEVER
        elif tag in NEVER_TAGS:
            self.hard += NEVER
        elif tag == "header" and not self.article:
            self.hard += PAGE_HEADER
        if attributes and not attributes.isspace():
            self._read(attributes)
        #: The outermost element that marks the article; it is in doubt within an element that is named as beside one.
        self.marked = self.article and not (parent and parent.article)
        self.doubtful = self.beside if self.marked else bool(parent and parent.doubtful)

    def _read(self, attributes: str) -> None:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id", "itemprop", "aria-label") and self.tag not in ("html", "body", "article", "main"):
                found = set(WORDS.findall(value))
                bad = found & NAMED_WORDS
                self.beside |= bool(found & BESIDE_WORDS)
                self.named |= found.intersection(DOUBTFUL_WORDS)
                self.thread |= bool(found & REPEATED)
                if bad == {"header"} and (self.article or found & GOOD_WORDS):  # an article's own head
                    continue
                if bad:
                    self.soft += NAMED
                    self.thread |= bool(bad & THREAD_WORDS)
                elif found & GOOD_WORDS and name in ("class", "id"):
                    self.hard += HINT_GOOD
            elif name == "role":
                if value == "form":
                    self.soft += NEVER
                elif value in NEVER_ROLES:
                    self.hard += NEVER
                elif value in ("main", "article"):
                    self.article = True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                self.hard += NEVER


def settle(elements: list[Element], runs: list[tuple[Element, int]]) -> None:
    """Set the elements' bias, and mute: what of it is not a hint. Parents come before what they hold."""
    for e in elements:
        e.mute = e.hard + (e.parent.mute if e.parent else 0.0)
    for e, n in runs:
        if e.mute > NEVER / 2:
            e.size += n
    for e in reversed(elements):
        if e.marked:
            e.main_size += e.size
        if e.parent:
            e.parent.size += e.size
            e.parent.main_size += e.main_size
    top = elements[0]
    said = Counter((id(e.parent), word) for e in elements for word in e.named & REPEATED)
    for e in elements:
        if any(said[id(e.parent), word] > 1 for word in e.named):
            e.soft += NAMED
        if e.soft or e.named:
            inside, whole = (e.main_size, top.main_size) if top.main_size else (e.size, top.size)
            if not (e.marked and top.main_size) and inside > (NEARLY_ALL if e.thread else MOST) * whole:
                e.soft, e.named = 0.0, frozenset()
        if e.parent:
            e.named |= e.parent.named
        e.bias = e.hard + e.soft + (e.parent.bias if e.parent else 0.0)


def blocks(html: str) -> tuple[list[str], list[tuple[float, ...]], list[Element]]:
    """Texts of the page's blocks in order, their features, and the element around each."""
    texts, rows, around = [], [], []
    top = Element("html", "", None)
    elements = [top]
    part: list[tuple[str, Element]] = []
    found: list[tuple[Element, list[tuple[str, Element]]]] = []
    lower = None
    at, size = 0, len(html)

    def flush(element: Element) -> None:
        if any(not t.isspace() for t, _ in part):
            near = element
            while not near.block and near.parent:
                near = near.parent
            found.append((near, part.copy()))
        part.clear()

    for mark in MARK.finditer(html):
        start = mark.start()
        if start < at:  # within a raw element
            continue
        if start > at:
            text = unescape(html[at:start])
            part.append((text, top))
        at = mark.end()
        tag = mark[2] or mark[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), mark[1] or mark[4], mark[3] or mark[6] or ""
        if closing:
            e = top
            while e.parent and e.tag != tag:
                if e.block and tag not in BLOCK:
                    e = None  # an inline end tag does not end blocks
                    break
                e = e.parent
            if tag in BLOCK or tag == "br":
                flush(top)
            if e is not None and e.parent:
                top = e.parent
            continue
        if tag in RAW:
            if lower is None:
                lower = html.lower()
            end = lower.find(f"</{tag}", at)
            at = size if end < 0 else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush(top)
            elif tag == "br":
                part.append((" ", top))
            continue
        if tag in BLOCK:
            flush(top)
            e = top
            while e.parent and (not e.block or e.tag == "p"):  # an open paragraph ends where a block begins
                if e.tag == "p":
                    top = e.parent
                    break
                e = e.parent
            if tag in ENDS:
                e = top
                while e.parent and e.tag not in ("ul", "ol", "dl", "table", "select", "menu"):
                    if e.tag in ENDS[tag]:
                        top = e.parent
                    e = e.parent
        if not attributes.endswith("/") or tag in BLOCK:
            top = Element(tag, attributes, top)
            elements.append(top)
    if at < size:
        part.append((unescape(html[at:]), top))
    flush(top)

    settle(elements, [(e, len(t.strip())) for _, runs in found for t, e in runs])
    for near, runs in found:
        if any(e is not near for _, e in runs):
            runs = [(t, e) if e.bias - near.bias > NEIGHBOURLY else (" ", near) for t, e in runs]
        text = " ".join("".join([t for t, _ in runs]).split())
        if not text:
            continue
        n, linked, tag = text.count(" ") + 1, sum(len(t) for t, e in runs if e.link), near.tag
        kinds = (tag in ("p", "blockquote", "pre"), tag[0] == "h" and tag[1:].isdigit(), tag in ("li", "dt", "dd"), tag in ("td", "th"))
        sentence = n > 2 and text[-1] in ".!?:;…。\"'”»)"
        texts.append(text)
        rows.append((1.0, *map(float, kinds), min(5.0, log1p(n)), min(1.0, linked / len(text)), float(sentence), float(near.beside), *(float(w in near.named) for w in DOUBTFUL_WORDS)))
        around.append(near)
    return texts, rows, around


def log_odds(rows: list[tuple[float, ...]], around: list[Element], weights: tuple[float, ...]) -> list[float]:
    """Log odds of content: the classifier's, the elements' own, and the page's mark of its article."""
    sure, marked = (any(e.article and not e.doubtful * k for e in around) for k in (1, 0))
    # A page that marks its article has little else to say.
    mark = [IN_ARTICLE if e.article and not (e.doubtful and sure) else BESIDE_ARTICLE * marked for e in around]
    return [sum(map(mul, weights, x)) + e.bias + m for x, e, m in zip(rows, around, mark)]


def neighbours(around: list[Element]) -> list[tuple[int, int, int]]:
    """Edges (i, j, kind) by order and by DOM proximity."""
    edges, last, older = [], {}, {}
    for i, e in enumerate(around):
        if e.mute < NEIGHBOURLY:
            continue
        box, out = id(e.parent), id(e.parent.parent) if e.parent else 0
        if i and around[i - 1].mute >= NEIGHBOURLY:
            edges.append((i - 1, i, FOLLOWS_SAME if around[i - 1].parent is e.parent else FOLLOWS))
        for seen, key, kind in ((last, box, SIBLING), (older, out, COUSIN)):
            if key in seen and seen[key] != i - 1:
                edges.append((seen[key], i, kind))
            seen[key] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the capacity cut: |odds| for a label against it, an edge's capacity for unequal ends."""
    n, odds = len(odds), list(odds)
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    for i, j, c in edges:
        near[i][j] += c
        near[j][i] += c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) >= sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, c in near[i].items():
                odds[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    free = [i for i in range(n) if label[i] is None]
    if free:
        for i in _source_side({i: odds[i] for i in free}, {i: near[i] for i in free}):
            label[i] = True
    return [bool(x) for x in label]


def _source_side(odds: dict[int, float], near: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the content side of a minimum cut: shortest augmenting paths until none is left."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(n) for i, n in near.items()}
    room[source], room[sink] = {}, {}
    for i, v in odds.items():
        a, b = (source, i) if v > 0 else (i, sink)
        room[a][b] = abs(v)
        room[b].setdefault(a, 0.0)
    while True:
        came, todo = {source: source}, deque([source])
        while todo and sink not in came:
            i = todo.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    todo.append(j)
        if sink not in came:
            return set(came) - {source}
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= flow
            room[j][i] = room[j].get(i, 0.0) + flow


def labelled(html: str | None, model: Model = DEFAULT) -> tuple[list[str], list[float], list[bool]]:
    """The blocks' texts, log odds and labels."""
    texts, rows, around = blocks(html or "")
    odds = log_odds(rows, around, model.weights)
    return texts, odds, minimum_cut(odds, [(i, j, model.capacities[kind]) for i, j, kind in neighbours(around)])


def main_text(html: str | None, model: Model = DEFAULT) -> str:
    texts, _, labels = labelled(html, model)
    return "\n".join(t for t, keep in zip(texts, labels) if keep)


def examples(html: str | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a marked page's blocks, at most so many, evenly spaced: features with what words in attributes add to the log odds
    last, and labels; edges by kind and whether labels agree."""
    _, rows, around = blocks(html or "")
    y = np.asarray([e.article and not e.doubtful and e.bias > NEIGHBOURLY for e in around], bool)
    edges = np.zeros((4, 2), np.int64)
    if not y.any():
        return np.zeros((0, len(FEATURES) + 1)), y[:0], edges
    for i, j, kind in neighbours(around):
        edges[kind, int(y[i] == y[j])] += 1
    at = np.unique(np.linspace(0, len(y) - 1, min(most, len(y))).astype(int))
    return np.column_stack([rows, [e.bias - e.mute for e in around]])[at], y[at], edges


def fitted(x: np.ndarray, y: np.ndarray, edges: np.ndarray, rounds: int = 20, evidence: float = 200.0) -> Model:
    """The most likely weights under a normal prior around DEFAULT; capacities from the edges that agree.

    Pages of one template say the same again and again, so all blocks, and all edges, weigh as `evidence` ones at most."""
    x, given = x[:, :-1], x[:, -1]
    start, firm = np.asarray(DEFAULT.weights), np.asarray(PRECISIONS)
    w, each = start.copy(), min(1.0, evidence / max(len(y), 1))
    edges = edges * min(1.0, evidence / max(int(edges.sum()), 1))
    for _ in range(rounds):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w + given, -30, 30)))
        step = np.linalg.solve(each * (x.T * (p * (1 - p))) @ x + np.diag(firm), each * x.T @ (y - p) - firm * (w - start))
        w = w + step / max(1.0, np.abs(step).max())
    usual = 1 / (1 + np.exp(-2 * np.asarray(DEFAULT.capacities)))
    agree = 0.5 * np.log((edges[:, 1] + 10 * usual) / (edges[:, 0] + 10 * (1 - usual)))  # as if ten edges were known
    return Model(tuple(w.tolist()), tuple(np.clip(agree, LEAST_CAPACITY, MOST_CAPACITY).tolist()))


def fit(pages: DataFrame, sample_pages: int = 2000, sample_blocks: int = 100) -> Model:
    """The model of a sample of pages, chosen by a hash of their html."""
    share = min(1.0, 2.0 * sample_pages / max(pages.count(), 1))
    key = F.xxhash64("html")
    some = pages.where(F.pmod(key, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("html", key.alias("key")).orderBy("key", "html").limit(sample_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            found = [examples(h, sample_blocks) for h in b.column(0).to_pylist()]
            cols = [[x.astype("<f8").tobytes() for x, _, _ in found], [y.astype("<u1").tobytes() for _, y, _ in found], [e.astype("<i8").tobytes() for *_, e in found]]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, pa.binary()) for c in cols)], names=["key", "x", "y", "edges"])

    rows = sorted(some.mapInArrow(run, "key long, x binary, y binary, edges binary").collect())  # at most sample_pages
    x, y = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("x", "<f8"), ("y", "<u1")))
    edges = sum((np.frombuffer(r["edges"], "<i8").reshape(4, 2) for r in rows), np.zeros((4, 2), np.int64))
    return fitted(x.reshape(-1, len(FEATURES) + 1), y.astype(float), edges)


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """The carried columns, text and n_chars for every page; the model is fitted to the pages unless given."""
    kinds = dict(pages.dtypes)
    model = model or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            found = [main_text(h, model) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=[*carry, "text", "n_chars"])

    return pages.select(*carry, "html").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "text string", "n_chars long"]))
