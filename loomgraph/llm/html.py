"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding (operator 10)."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Pages that the trees are fitted on at most, those of least hash.
SAMPLE_PAGES = 400
TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 32
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_RAW = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "noscript": re.compile(r"</noscript\s*>", re.I), "textarea": re.compile(r"</textarea\s*>", re.I), "template": re.compile(r"</template\s*>", re.I), "svg": re.compile(r"</svg\s*>", re.I)}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul title head".split())
_ENDS_P = _BLOCK - {"body", "html", "head", "title", "p", "td", "th", "tr", "li", "tbody", "thead", "tfoot", "dd", "dt"}
_TAGS = "html head title body div section article main p span a ul ol li nav footer header aside h1 h2 h3 h4 table tr td b i em strong pre code blockquote form button label figure br img".split()
_TAG_ID = {t: i for i, t in enumerate(_TAGS)}
OTHER = len(_TAGS)
_GOOD, _BAD = frozenset({"article", "main"}), frozenset({"nav", "footer", "header", "aside", "form", "button", "head", "title"})
_BAD_NAMES = frozenset("ad ads advert banner sidebar menu nav navigation footer header cookie breadcrumb share social related promo comments popup".split())
_GOOD_NAMES = frozenset("article content main post entry story".split())
_HASHED = 16
_DIGITS = b"0123456789"


@dataclass
class Tree:
    """Nodes of one page in document order, and its pieces of text as (node, text)."""

    tag: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str) -> Tree:
    """A forgiving reading: unclosed elements end with their parent, stray end tags are ignored, the text of scripts and styles is dropped."""
    t = Tree()
    stack: list[int] = []
    is_open: Counter[str] = Counter()

    def close(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            is_open[t.name[node]] -= 1
            t.end[node] = len(t.tag)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and stack and not (piece := page[at:stop]).isspace():
            t.pieces.append((stack[-1], piece))
        elif stop > at and not stack and not page[at:stop].isspace():
            t.tag.append(OTHER), t.name.append("text"), t.parent.append(-1), t.depth.append(0), t.end.append(len(t.tag)), t.names.append(())
            t.pieces.append((len(t.tag) - 1, page[at:stop]))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if is_open[tag] > 0 else ():
                if t.name[stack[i]] == tag:
                    close(i)
                    break
            continue
        shut = _CLOSES.get(tag, ())
        if tag in _ENDS_P:
            shut = {"p"}
        if any(is_open[x] > 0 for x in shut):
            for i in range(len(stack) - 1, -1, -1):
                name = t.name[stack[i]]
                if name in shut:
                    close(i)
                    break
                if name in _BLOCK:
                    break
        names: tuple[str, ...] = ()
        if m[3]:
            names = tuple(x for a in _ATTRIBUTE.findall(m[3]) for x in _PART.findall("".join(a).lower()))
        node = len(t.tag)
        t.tag.append(_TAG_ID.get(tag, OTHER)), t.name.append(tag), t.parent.append(stack[-1] if stack else -1), t.depth.append(len(stack)), t.end.append(node + 1), t.names.append(names)
        empty = tag == "svg" and m[0].endswith("/>")
        e = _RAW[tag].search(page, at) if tag in _RAW and not empty else None
        if tag in _RAW and not empty and (e or tag != "svg"):
            at = e.end() if e else n
        elif tag not in _VOID and not m[0].endswith("/>"):
            stack.append(node)
            is_open[tag] += 1
    close(0)
    return t


FEATURES = 22 + (OTHER + 1) + 2 * _HASHED


def node_features(t: Tree, hide: bool = False) -> np.ndarray:
    """A row for each node: tag, place, siblings, density of its subtree's text, and hashed attribute tokens of it and its ancestors.

    ``hide`` makes semantic tags plain ones and drops attributes, so that the trees learn to do without them.
    """
    n = len(t.tag)
    out = np.zeros((n, FEATURES), np.float32)
    if n == 0:
        return out
    tag = np.array(t.tag)
    if hide:
        plain = np.array([x in _GOOD or x in _BAD for x in t.name])
        tag = np.where(plain, _TAG_ID["div"], tag)
    parent, depth, end = np.array(t.parent), np.array(t.depth), np.array(t.end)
    own, dots, words, caps, digits = (np.zeros(n) for _ in range(5))
    for i, x in t.pieces:
        own[i] += len(x)
        dots[i] += x.count(".") + x.count(",")
        words[i] += x.count(" ") + 1
        caps[i] += x.count("|") + x.count("©") + x.count("&")
        raw = x.encode("utf-8", "replace")
        digits[i] += len(raw) - len(raw.translate(None, _DIGITS))
    link = np.where(tag == _TAG_ID["a"], 1, 0)
    inside = _covered(np.flatnonzero(link), end, n) if link.any() else np.zeros(n, bool)

    def subtree(v: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(v)])
        return c[end] - c[np.arange(n)]

    text, linked, nodes = subtree(own), subtree(own * inside), end - np.arange(n)
    links, total = subtree(link), max(own.sum(), 1)
    safe = np.maximum(text, 1)
    up = np.maximum(parent, 0)
    siblings = np.bincount(parent + 1, minlength=n + 1)[parent + 1]
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], parent)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    same = np.zeros(n)
    _, which, times = np.unique(parent * 64 + tag, return_inverse=True, return_counts=True)
    same = times[which] / siblings
    sib_text = np.bincount(parent + 1, weights=text, minlength=n + 1)[parent + 1]
    children = np.bincount(parent + 1, minlength=n + 1)[1:]
    cols = [np.log1p(own), np.log1p(text), text / total, linked / safe, np.log1p(text / nodes), np.log1p(nodes), links / nodes, subtree(dots) / safe * 10, text / np.maximum(subtree(words), 1) / 10, subtree(caps) / safe * 10, subtree(digits) / safe * 10, np.minimum(depth, 40), siblings, rank - first, (rank - first) / siblings, same, text / np.maximum(sib_text, 1), children, np.arange(n) / n, np.log1p(text[up]), linked[up] / safe[up], tag[up]]
    out[:, : len(cols)] = np.stack(cols, axis=1)
    out[np.arange(n), len(cols) + tag] = 1
    if not hide:
        base = len(cols) + OTHER + 1
        named = [(i, crc32(x.encode()) % _HASHED) for i, names in enumerate(t.names) for x in names]
        node, k = np.array(named, np.int64).reshape(-1, 2).T
        out[node, base + k] = 1
        if (end[node] - node).sum() <= 50 * n:
            for i, j in zip(node.tolist(), k.tolist(), strict=True):
                out[i : end[i], base + _HASHED + j] = 1
        else:  # deep nesting
            for j in np.unique(k):
                out[:, base + _HASHED + j] = _covered(node[k == j], end, n)
    return out


def _covered(nodes: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n nodes are in the subtree of any of the given ones."""
    return np.cumsum(np.bincount(nodes, minlength=n + 1) - np.bincount(end[nodes], minlength=n + 1))[:n] > 0


def teacher(t: Tree) -> np.ndarray:
    """1 for nodes within the page's article or main element, 0 within navigation, footers, advertisements and the like, else -1."""
    y: list[int] = []
    for i, up in enumerate(t.parent):
        names = set(t.names[i])
        above = y[up] if up >= 0 else -1
        if t.name[i] in _BAD or names & _BAD_NAMES:
            above = 0
        elif (t.name[i] in _GOOD or names & _GOOD_NAMES) and above != 0:
            above = 1
        y.append(above)
    return np.array(y, np.int64)


@dataclass
class Forest:
    """Boosted trees of equal depth over binned features: a feature and a bin for each inner node, a value for each leaf."""

    edges: np.ndarray  # features by BINS - 1
    base: float
    features: np.ndarray
    bins: np.ndarray
    leaves: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros(x.shape, np.uint8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.bins, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            z += v[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, base: float | None = None) -> Forest:
    """Second-order boosting of the logistic loss; the best of all bins of all features at each node, ties to the first."""
    edges = np.stack([np.quantile(x[:, i], np.arange(1, BINS) / BINS) if len(x) else np.zeros(BINS - 1) for i in range(x.shape[1])]).astype(np.float32)
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    inner = 2**DEPTH - 1
    forest = Forest(edges, float(np.log(mean / (1 - mean))) if base is None else base, np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.int64), np.zeros((trees, inner + 1)))
    b = forest.binned(x).astype(np.int64)
    z, rows, k = np.full(len(x), forest.base), np.arange(len(x)), x.shape[1]
    for t in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p) + 1e-6
        at = np.zeros(len(x), np.int64)
        for d in range(DEPTH):
            lo, width = 2**d - 1, 2**d
            slot = ((at - lo)[:, None] * k + np.arange(k)) * BINS + b
            flat = slot.ravel()
            G = np.bincount(flat, np.repeat(g, k), width * k * BINS).reshape(width, k, BINS).cumsum(axis=2)
            H = np.bincount(flat, np.repeat(h, k), width * k * BINS).reshape(width, k, BINS).cumsum(axis=2)
            sg, sh = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + 1) + (sg - G) ** 2 / (sh - H + 1) - sg**2 / (sh + 1)
            gain[(H < 1) | (sh - H < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            use = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            forest.features[t, lo : lo + width] = best // BINS
            forest.bins[t, lo : lo + width] = np.where(use, best % BINS, 255)
            at = 2 * at + 1 + (b[rows, forest.features[t, at]] > forest.bins[t, at])
        leaf = at - inner
        G, H = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        forest.leaves[t] = -RATE * G / (H + 1)
        z += forest.leaves[t, leaf]
    return forest


def decode(t: Tree, p: np.ndarray, switch: float = 0.5) -> np.ndarray:
    """Which nodes' own text stays, by the best labelling of the whole tree.

    A node is kept or dropped with all below it, or left open for its children to choose (its own text then goes by its
    own probability), which costs ``switch``.  So nothing is kept below a dropped node, nor dropped below a kept one.
    """
    n = len(t.tag)
    own = np.zeros(n)
    for i, x in t.pieces:
        own[i] += len(x)
    w = (0.05 + np.log1p(own)).tolist()
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = (np.log(p)).tolist(), (np.log(1 - p)).tolist()
    keep, drop, free = [w[i] * yes[i] for i in range(n)], [w[i] * no[i] for i in range(n)], [w[i] * max(yes[i], no[i]) - switch for i in range(n)]
    for i in range(n - 1, 0, -1):
        u = t.parent[i]
        if u >= 0:
            keep[u] += keep[i]
            drop[u] += drop[i]
            free[u] += max(keep[i], drop[i], free[i])
    out, below = np.zeros(n, bool), [0] * n  # 1 kept, 2 dropped, 3 open
    for i in range(n):
        u = t.parent[i]
        if u >= 0 and below[u] != 3:
            below[i] = below[u]
        else:
            best = max(keep[i], drop[i], free[i])
            below[i] = 2 if drop[i] == best else 1 if keep[i] == best else 3
        out[i] = below[i] == 1 or (below[i] == 3 and yes[i] > no[i])
    return out


def text_of(t: Tree, kept: np.ndarray) -> str:
    """The kept pieces, blocks and line breaks on lines of their own, white space folded."""
    block: list[int] = []
    breaks = 0
    at_break = [0] * len(t.name)
    for i, name in enumerate(t.name):
        block.append(i if name in _BLOCK or t.parent[i] < 0 else block[t.parent[i]])
        breaks += name == "br"
        at_break[i] = breaks
    lines: list[list[str]] = []
    last = None
    for i, x in t.pieces:
        if kept[i]:
            if block[i] != last:
                lines.append([])
                last = block[i]
            lines[-1].append(x)
        elif block[i] == last:
            last = None
    out = (" ".join(html.unescape("".join(x)).split()) for x in lines)
    return "\n".join(x for x in out if x)


def fit(df: DataFrame, column: str = "html", sample_pages: int = SAMPLE_PAGES) -> Forest:
    """Trees fitted on the driver to a bounded sample of pages, each taken twice: as it is and with its semantic tags and attributes hidden.

    Labels come from semantic tags and attribute names.  Where the sample has none that says which text is the main one, as
    in an empty table, there is nothing to tell apart and :func:`extract` keeps all text.
    """
    common.prepare(df.sparkSession)
    body = F.col(f"`{column}`").cast("string")
    sample = df.select(body.alias("t")).filter("t is not null").select("t", F.xxhash64("t").alias("h")).orderBy("h").limit(sample_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for page in batch.column(0).to_pylist():
                t = parse(page)
                label = teacher(t)
                for hide in (False, True):
                    x.append(node_features(t, hide)[label >= 0].tobytes())
                    y.append(label[label >= 0].astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["x", "y"])

    got = sample.select("t").mapInArrow(run, "x binary, y binary").toArrow()
    x = [np.frombuffer(v, np.float32).reshape(-1, FEATURES) for v in got["x"].to_pylist()]
    y = [np.frombuffer(v, np.int8) for v in got["y"].to_pylist()]
    label = np.concatenate(y).astype(np.float64) if y else np.zeros(0)
    if not label.any():
        return boost(np.zeros((0, FEATURES), np.float32), np.zeros(0), trees=0, base=8.0)
    return boost(np.concatenate(x), label)


def extract(df: DataFrame, forest: Forest, column: str = "html", id_col: str = "page_id") -> DataFrame:
    """(page_id, text, n_nodes, n_kept): the main text of each page.

    A null page has null text and no nodes; an empty one, or one without main text, an empty text.  Null ids and repeated
    rows give their own rows; other columns aren't read.
    """
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            pages = batch.column(1).to_pylist()
            texts: list[str | None] = [None] * len(pages)
            nodes, kept = np.zeros(len(pages), np.int64), np.zeros(len(pages), np.int64)
            for a in range(0, len(pages), 64):
                trees = [parse(x or "") for x in pages[a : a + 64]]
                x = np.concatenate([node_features(t) for t in trees])
                p = f.probability(x)
                at = 0
                for i, t in enumerate(trees, a):
                    if pages[i] is None:
                        continue
                    k = decode(t, p[at : at + len(t.tag)])
                    at += len(t.tag)
                    texts[i], nodes[i], kept[i] = text_of(t, k), len(t.tag), int(k.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(nodes), pa.array(kept)], names=[id_col, "text", "n_nodes", "n_kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{column}`").cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, text string, n_nodes bigint, n_kept bigint")
