"""Main-text extraction by a tree-structured graphical model over the DOM.

Every block element and every run of text between block boundaries is a binary variable: content or not. So are controls and
embedded objects within a line (buttons, scripts' substitutes, drawings) and their texts, which stay in their line's place where they
are content. Unary log-odds come from learned weights of its tag, the words in its class, id and role (whole and their first
letters, camel case split), and for text its length, share of links and last character; parent and child are coupled by learned potentials, one table each for elements, texts, embedded
elements and the page's topmost ones.
Sum-product messages go upward from the leaves and downward from the root and yield each text's marginal exactly;
texts with a marginal of at least one half are the main text. Weights are fitted on labelled pages by gradient ascent on the
conditional likelihood, whose gradient needs the same marginals.

Rows: null, empty and text-free pages give an empty text; pages of any size and depth are read whole, in time proportional to
their size; repeated pages give repeated rows, an empty table none. Columns named like the output are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import EMBEDDED, SLOT, Tree, parse
from .labelled_pages import labelled_pages
from .store import free_name, replace_columns

#: Pages whose trees pass messages together, and the nodes at which a group is closed earlier.
GROUP, GROUP_NODES = 256, 1 << 16
_ROOTS = {"#page", "html", "body"}
_STOPS = frozenset(".!?:;\u3002\uff01\uff1f")


def _features(tree: Tree, i: int) -> list[str]:
    """Features of an element: its tag and its names, whole and by their first four and five letters; of a text: size, links, end, place."""
    if tree.text[i] is None:
        stems = {f"stem {t[:n]}" for t in tree.attrs[i] for n in (4, 5) if len(t) > n}
        return [f"tag {tree.tag[i]}", f"named {tree.tag[i]} {bool(tree.attrs[i])}", *sorted({f"name {t}" for t in tree.attrs[i]} | stems)]
    text = tree.text[i].replace(SLOT, "")
    n = max(1, len(text))
    return [f"size {min(10, n.bit_length())}", f"links {round(4 * tree.linked[i] / n)}", f"in {tree.tag[tree.parent[i]]}", f"stop {text[-1:] in _STOPS}"]


def _kind(tree: Tree, i: int) -> int:
    """Which table couples a node to its parent: 1 for text, 2 for embedded elements, 3 for those below the page itself, 0 for others."""
    if tree.text[i] is not None:
        return 1
    if tree.tag[i] in EMBEDDED:
        return 2
    return 3 if i and tree.tag[tree.parent[i]] in _ROOTS else 0


@dataclass
class Forest:
    """Trees one after another. by_depth: node numbers of each depth; kind: which table couples a node to its parent."""

    parent: np.ndarray
    kind: np.ndarray
    by_depth: list[np.ndarray]
    unary: np.ndarray


def _forest(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    sizes = [len(t.parent) for t in trees]
    shift = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    parent = np.concatenate([np.array(t.parent) for t in trees])
    parent = np.where(parent >= 0, parent + shift, -1)
    depth = np.concatenate([np.array(t.depth) for t in trees])
    kind = np.array([_kind(t, i) for t in trees for i in range(len(t.parent))], np.int64)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 1)) if len(depth) else []
    return parent, kind, np.split(order, cuts)


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def sum_product(f: Forest, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of content for each node; and for each node but the roots, of (parent, child) labels.

    pair[kind, parent label, child label] are log-potentials.
    """
    n = len(f.parent)
    up = np.stack([np.zeros(n), f.unary], axis=1)
    message = np.zeros((n, 2))
    for nodes in reversed(f.by_depth[1:]):
        p = pair[f.kind[nodes]]
        sent = _logsum(p[:, :, 0] + up[nodes, None, 0], p[:, :, 1] + up[nodes, None, 1])
        message[nodes] = sent
        above, at = np.unique(f.parent[nodes], return_inverse=True)
        for y in (0, 1):
            up[above, y] += np.bincount(at, weights=sent[:, y], minlength=len(above))
    down, joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for nodes in f.by_depth[1:]:
        above = f.parent[nodes]
        rest = up[above] + down[above] - message[nodes]
        both = rest[:, :, None] + pair[f.kind[nodes]]
        down[nodes] = _logsum(both[:, 0], both[:, 1])
        both = both + up[nodes][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        e = np.exp(both)
        joint[nodes] = e / e.sum(axis=(1, 2), keepdims=True)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


@dataclass
class Model:
    weights: dict[str, float]
    pair: np.ndarray

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        parent, kind, by_depth = _forest(trees)
        w, seen = self.weights, {}
        unary = []
        for t in trees:
            for i in range(len(t.parent)):
                if t.text[i] is None:
                    key = (t.tag[i], t.attrs[i])
                    v = seen.get(key)
                    if v is None:
                        v = seen[key] = sum(w.get(x, 0.0) for x in _features(t, i))
                else:
                    v = sum(w.get(x, 0.0) for x in _features(t, i))
                unary.append(v)
        m, _ = sum_product(Forest(parent, kind, by_depth, np.array(unary)), self.pair)
        return np.split(m, np.cumsum([len(t.parent) for t in trees])[:-1])

    def texts(self, pages: list[str | None]) -> list[str]:
        out: list[str] = []
        group: list[Tree] = []
        size = 0
        for k, page in enumerate(pages):
            group.append(parse(page or ""))
            size += len(group[-1].parent)
            if len(group) == GROUP or size >= GROUP_NODES or k == len(pages) - 1:
                for tree, m in zip(group, self.marginals(group), strict=True):
                    out.append("\n".join(tree.blocks([p >= 0.5 for p in m])))
                group, size = [], 0
        return out


def train(pages: list[str], steps: int = 80, rate: float = 0.4, decay: float = 1e-3, mark: str = "⁣") -> Model:
    """Gradient ascent on the log-likelihood of the labels; texts that start with the mark are content.

    An element's label is that of most of the text below it.
    """
    trees = [parse(p) for p in pages]
    parent, kind, by_depth = _forest(trees)
    y = np.array([float(x is not None and x.lstrip(SLOT).startswith(mark)) for t in trees for x in t.text])
    for t in trees:
        t.text = [x.replace(mark, "") if x is not None else None for x in t.text]
    n = np.array([float(len(x)) if x is not None else 0.0 for t in trees for x in t.text])
    good, total = n * y, n.copy()
    for nodes in reversed(by_depth[1:]):
        np.add.at(good, parent[nodes], good[nodes])
        np.add.at(total, parent[nodes], total[nodes])
    y = np.where(kind == 1, y, (good > 0.5 * total).astype(float))
    names: dict[str, int] = {}
    node, feat, k = [], [], 0
    for t in trees:
        for i in range(len(t.parent)):
            for x in _features(t, i):
                node.append(k)
                feat.append(names.setdefault(x, len(names)))
            k += 1
    node, feat = np.array(node), np.array(feat)
    w, pair = np.zeros(len(names)), np.zeros((4, 2, 2))
    gw2, gp2 = np.full(len(names), 1e-8), np.full(pair.shape, 1e-8)
    child = np.flatnonzero(parent >= 0)
    yi = y.astype(int)
    seen = np.zeros_like(pair)
    np.add.at(seen, (kind[child], yi[parent[child]], yi[child]), 1)
    for _ in range(steps):
        unary = np.bincount(node, weights=w[feat], minlength=len(parent))
        m, joint = sum_product(Forest(parent, kind, by_depth, unary), pair)
        gw = np.bincount(feat, weights=(y - m)[node], minlength=len(names)) / len(trees) - decay * w
        expected = np.stack([joint[child[kind[child] == c]].sum(axis=0) for c in range(len(pair))])
        gp = (seen - expected) / len(trees) - decay * pair
        gw2, gp2 = gw2 + gw * gw, gp2 + gp * gp
        w, pair = w + rate * gw / np.sqrt(gw2), pair + rate * gp / np.sqrt(gp2)
    return Model({x: float(w[i]) for x, i in names.items()}, pair)


@cache
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """The pages with ``text`` (the main text) and ``n_chars`` (its code points)."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.arrow_udf("string")
    def main_text(col: pa.Array) -> pa.Array:
        return pa.array(sent.value.texts(col.to_pylist()), pa.string())

    t = free_name(pages, "main_text")
    with_t = pages.withColumn(t, main_text(F.col(html).cast("string")))
    return replace_columns(with_t, {"text": F.col(t), "n_chars": F.length(F.col(t)).cast("long")}).drop(t)
