"""Main text of web pages by a graphical model on the DOM tree.

Block elements are the nodes; inline elements belong to their block. Every node is content or not. Its own evidence is a
logistic score of its tag, names, text and links; a table of parent and child labels ties it to its parent. Messages passed from
the leaves to the root and back (sum-product, exact on a tree) give each node's marginal, and the text of nodes that are
content with at least even odds is the main text.

The model is trained on labelled pages: pages that mark their article (``article`` or ``main``) label their own nodes, content
inside the mark except below parts that are never content; each page counts with its mark and without it. At most ``train_pages`` pages are used, those with the smallest
row hash, so the choice does not depend on the partitioning. Without any such page, a prior model with the same
features for names that are never content is used.

Defined cases: null, empty and text-only html give the text outside of any element, which the root holds; unclosed and
misnested tags are closed by the next block or the end; long pages are read in linear time; repeated rows are each
extracted; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import table

TRAIN_PAGES = 1000
FEATURES = 1 << 12
#: Children of content that are none, beyond those seen, as a share of those that are content.
FREEDOM = 0.05
EPOCHS = 80

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text.
HIDDEN = frozenset("head title script style noscript template svg math iframe object select option textarea button canvas audio video".split())
#: Elements that mark the article, by which training pages label themselves.
MARKS = ("article", "main")
#: Elements and names that are never part of an article.
APART = frozenset("nav footer header aside form menu dialog".split())
APART_NAMES = frozenset((
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer form header menu modal nav "
    "navbar navigation newsletter notice pagination popup promo related respond share sharing sidebar skip social sponsor sponsored subscribe toolbar "
    "widget").split())
#: A new one of these closes an open one.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDS = frozenset("ul ol dl table div section article main nav footer header aside body html form blockquote".split())

_RAW = re.compile(r"<(script|style|textarea|title|template|noscript|svg|iframe)\b", re.IGNORECASE)
_BREAK, _SPECIAL = re.compile(r"[\s/>]"), re.compile(r"""[>"']""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "names", "parent", "depth", "words", "linked", "runs")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, depth: int):
        self.tag, self.names, self.parent, self.depth = tag, names, parent, depth
        self.words = self.linked = self.runs = 0


class _Ahead:
    """Place of the next match at or after a place; each stretch of the page is searched once while places only grow."""

    def __init__(self, page: str, pattern: re.Pattern):
        self.page, self.pattern, self.since, self.at = page, pattern, 0, -1

    def of(self, place: int) -> int:
        if not self.since <= place <= self.at:
            found = self.pattern.search(self.page, place)
            self.since, self.at = place, found.start() if found else len(self.page)
        return self.at


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of each piece of markup; comments and raw elements have no name.

    A ``<`` that begins nothing is text. Forward searches are remembered, so the time is linear in the page whatever is left open.
    """
    size, at = len(page), 0
    breaks, specials = _Ahead(page, _BREAK), _Ahead(page, _SPECIAL)
    last_gt, last_quote = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    ends: dict[int, int] = {}  # opening quote -> end of the tag it stands in, or -1

    def tag_end(place: int) -> int:
        """Place of the ``>`` that ends a tag, outside of quotes; -1 if there is none."""
        passed, end = [], -1
        while (place := specials.of(place)) < size:
            if page[place] == ">":
                end = place
                break
            if place in ends:
                end = ends[place]
                break
            passed.append(place)
            if place >= last_quote[page[place]]:
                break
            place = page.find(page[place], place + 1) + 1
        ends.update(dict.fromkeys(passed, end))
        return end

    while (at := page.find("<", at)) >= 0:
        if at > last_gt or page.startswith("<!--", at):
            at = page.find("<!--", at)
            if at < 0:
                return
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, False, "", ""
        elif raw := _RAW.match(page, at):
            close = re.compile(rf"</{raw[1]}\s*>", re.IGNORECASE).search(page, page.find(">", at) + 1)
            end = close.end() if close else size
            yield at, end, False, "", ""
        elif page[at + 1:at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, False, "", ""
        else:
            name = at + 1 + page.startswith("/", at + 1)
            if not (page[name:name + 1].isascii() and page[name:name + 1].isalpha()):
                at += 1
                continue
            stop = breaks.of(name)
            end = tag_end(stop) + 1
            if not end:
                at += 1
                continue
            yield at, end, name > at + 1, page[name:stop], page[stop:end - 1]
            ends.clear()
        at = end


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes, parents before children, and the text runs in page order with their node.

    A run of ``-1`` is a break between blocks. Hidden elements leave nothing.
    """
    nodes, runs = [Node("#root", (), -1, 0)], []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with the node that holds their text
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    bounds: list[int] = []  # where elements are open that keep those around them from being closed
    links = hidden = at = 0
    page = page or ""

    def text(piece: str) -> None:
        if not piece or hidden:
            return
        piece = html.unescape(piece)
        node = nodes[stack[-1][1]]
        count = len(piece.split())
        node.words += count
        node.linked += count if links else 0
        node.runs += 1 if count else 0
        runs.append((stack[-1][1], piece))

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in _BOUNDS:
            bounds.append(len(stack))
        stack.append((tag, node))

    def pop() -> None:
        nonlocal links, hidden
        tag, _ = stack.pop()
        places[tag].pop()
        if tag in _BOUNDS:
            bounds.pop()
        links -= tag == "a"
        hidden -= tag in HIDDEN
        if tag not in INLINE:
            runs.append((-1, " "))

    for start, end, closes, tag, attributes in tokens(page):
        text(page[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if closes:
            if places.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in ("p", "br"):
                runs.append((-1, " "))
            continue
        if tag in VOID:
            if tag not in INLINE:
                runs.append((-1, " "))
            continue
        if tag in INLINE:
            push(tag, stack[-1][1])
            links += tag == "a"
            continue
        runs.append((-1, " "))
        if tag in HIDDEN:  # no node: what is never shown says nothing about what is around it
            push(tag, stack[-1][1])
            hidden += 1
            continue
        if stack[-1][0] == "head":
            pop()
        close = _CLOSES.get(tag, ("p",))
        depth = max(places[t][-1] if places.get(t) else 0 for t in close)
        stops = places.get("table") if tag in ("td", "th", "tr") else bounds
        if depth and depth >= (stops[-1] if stops else 0):
            while len(stack) > depth:
                pop()
        if attributes.endswith("/") and tag not in _BOUNDS and tag != "p":
            continue
        names = tuple(w.lower() for m in _NAMES.finditer(attributes) for w in _PARTS.findall(m[1] or m[2] or m[3] or ""))
        parent = stack[-1][1]
        nodes.append(Node(tag, names, parent, nodes[parent].depth + 1))
        push(tag, len(nodes) - 1)
    text(page[at:])
    return nodes, runs


def apart(node: Node) -> bool:
    return node.tag in APART or not APART_NAMES.isdisjoint(node.names)


def _bucket(value: int) -> int:
    return min(value.bit_length(), 8)


def features(nodes: list[Node]) -> list[list[int]]:
    """Hashed features of each node; the same everywhere."""
    out, seen = [], {}

    def number(name: str) -> int:
        if name not in seen:
            seen[name] = zlib.crc32(name.encode("utf-8", "replace")) % (FEATURES - 2) + 2
        return seen[name]

    for node in nodes:
        parent = nodes[node.parent].tag if node.parent >= 0 else ""
        own = [0, number(f"tag {node.tag}"), number(f"under {parent}"), number(f"pair {parent} {node.tag}"), number(f"words {_bucket(node.words)}"),
               number(f"links {4 * node.linked // node.words if node.words else -1}"), number(f"depth {min(node.depth, 12)}")]
        own += [number(f"name {n}") for n in node.names[:8]]
        if apart(node):
            own.append(1)
        elif node.tag in MARKS:
            own.append(number("mark"))
        out.append(own)
    return out


def own_labels(nodes: list[Node]) -> list[int] | None:
    """Labels that a page gives its own nodes; none if it marks no article."""
    if not any(n.tag in MARKS for n in nodes):
        return None
    labels: list[int] = []
    inside, out = [], []
    for node in nodes:
        within = node.parent >= 0 and inside[node.parent]
        away = apart(node) or (node.parent >= 0 and out[node.parent])
        inside.append(within or node.tag in MARKS)
        out.append(away)
        labels.append(int(inside[-1] and not away))
    return labels


class Model:
    """``weights`` of the node score and ``ties``: log chance of a child's label (column) given its parent's (row)."""

    def __init__(self, weights: np.ndarray, ties: np.ndarray, prior: float):
        self.weights, self.ties, self.prior = weights, ties, prior

    @classmethod
    def unlabelled(cls) -> Model:
        weights = np.zeros(FEATURES)
        weights[0], weights[1] = 1.0, -6.0
        return cls(weights, np.log(np.array([[0.9, 0.1], [0.1, 0.9]])), 0.0)

    @classmethod
    def fit(cls, rows: list[list[int]], labels: list[int], pairs: np.ndarray, epochs: int = EPOCHS) -> Model:
        """Logistic regression by gradient steps scaled per feature; ``pairs`` counts labels of parents and children."""
        flat = np.concatenate([np.array(r, np.int64) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        target, weights, scale = np.array(labels, float), np.zeros(FEATURES), np.full(FEATURES, 1e-6)
        for _ in range(epochs):
            score = np.bincount(owner, weights[flat], len(rows))
            slip = target - 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            step = np.bincount(flat, slip[owner], FEATURES) / len(rows) - 1e-6 * weights
            scale += step * step
            weights += 0.5 * step / np.sqrt(scale)
        # Content may have children that are none in ways the training pages never show, such as a menu inside an article.
        pairs = pairs + 1
        pairs[1, 0] += FREEDOM * pairs[1, 1]
        ties = np.log(pairs / pairs.sum(axis=1, keepdims=True))
        share = float(np.clip(target.mean(), 0.01, 0.99))
        return cls(weights, ties, float(np.log(share / (1 - share))))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of each node to be content, by sum-product up and down the tree."""
        weights, (t0, t1) = self.weights, np.exp(self.ties).tolist()
        own = [min(max(float(sum(weights[i] for i in f)) - self.prior, -30.0), 30.0) for f in features(nodes)]
        count = len(nodes)
        up0, up1 = [1.0] * count, [float(np.exp(x)) for x in own]
        to0, to1 = [1.0] * count, [1.0] * count
        for i in range(count - 1, 0, -1):  # children come after their parents
            a = t0[0] * up0[i] + t0[1] * up1[i]
            b = t1[0] * up0[i] + t1[1] * up1[i]
            total = a + b
            to0[i], to1[i] = a / total, b / total
            parent = nodes[i].parent
            x, y = up0[parent] * to0[i], up1[parent] * to1[i]
            up0[parent], up1[parent] = x / (x + y), y / (x + y)
        belief0, belief1 = up0[:], up1[:]
        for i in range(1, count):
            parent = nodes[i].parent
            # What the parent knows without this child.
            x, y = belief0[parent] / to0[i], belief1[parent] / to1[i]
            a, b = x * t0[0] + y * t1[0], x * t0[1] + y * t1[1]
            x, y = up0[i] * a, up1[i] * b
            belief0[i], belief1[i] = x / (x + y), y / (x + y)
        return [b / (a + b) for a, b in zip(belief0, belief1)]


def main_text(page: str | None, model: Model) -> str:
    nodes, runs = parse(page)
    if len(nodes) == 1:
        return " ".join("".join(piece for _, piece in runs).split())
    chance = model.marginals(nodes)
    return " ".join("".join(piece if node >= 0 and chance[node] >= 0.5 else " " for node, piece in runs).split())


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, labels, above = [], [], []
        for page in batch.column("html").to_pylist():
            nodes, _ = parse(page)
            own = own_labels(nodes)
            if own:
                rows += features(nodes)
                # Once more with the mark taken off, so that pages without one are told by their other signs.
                for node in nodes:
                    if node.tag in MARKS:
                        node.tag = "div"
                rows += features(nodes)
                labels += own * 2
                above += [own[n.parent] if n.parent >= 0 else None for n in nodes] * 2
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(labels, pa.int32()), pa.array(above, pa.int32())], ["features", "label", "above"])


def train(pages: DataFrame, *, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Model:
    """Fit on at most ``train_pages`` pages that mark their article; they are parsed in Spark and only their node features are gathered."""
    marked = pages.select(F.struct("*").alias("page")).select(F.xxhash64("page").alias("draw"), F.col("page")[html_col].alias("html"))
    marked = marked.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # Only hashes are sorted; the pages up to the last chosen hash are then read where they lie.
    last = marked.select("draw").orderBy("draw").limit(train_pages).agg(F.max("draw")).first()[0]
    if last is None:
        return Model.unlabelled()
    rows = marked.filter(F.col("draw") <= last).limit(train_pages).select("html").mapInArrow(_labelled, "features array<int>, label int, above int").collect()
    labels = [r["label"] for r in rows]
    if not 0 < sum(labels) < len(labels):
        return Model.unlabelled()
    pairs = np.zeros((2, 2))
    for r in rows:
        if r["above"] is not None:
            pairs[r["above"], r["label"]] += 1
    return Model.fit([r["features"] for r in rows], labels, pairs)


def extract(pages: DataFrame, model: Model, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
