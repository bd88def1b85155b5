"""A small HTML tree for text extraction: elements and text leaves of one page as parallel lists."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

#: Elements whose content is code or data and no text of the page.
RAW = {"script", "style", "template", "iframe", "noembed", "noframes", "title", "annotation", "annotation-xml"}
#: Elements that start and end a block; so do custom elements (with a hyphen). Every other element is within a line.
BLOCK = set("""address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
#: Elements within a line whose text is judged apart from that line and, where it is content, stays in its place.
EMBEDDED = {"audio", "button", "canvas", "noscript", "object", "select", "svg", "textarea", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A start tag of the key closes open elements of the values, up to the nearest element of _SCOPE.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "aside", "nav", "form", "select"}
#: Stands for an embedded leaf in the text around it; pages lose this character before they are read.
SLOT = "\0"

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


@dataclass
class Tree:
    """Node 0 is the page. text is None for elements; linked counts a leaf's characters inside links.

    ``at`` is where a leaf begins in the page; ``slots`` are the embedded leaves that its SLOT characters stand for.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    attrs: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])
    at: dict[int, int] = field(default_factory=dict)
    slots: dict[int, list[int]] = field(default_factory=dict)

    def add(self, parent: int, tag: str, attrs: tuple[str, ...], text: str | None, linked: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1

    def blocks(self, content: list[bool]) -> list[str]:
        """The content leaves' texts in page order, embedded ones in their places."""
        held = {i for leaf, inner in self.slots.items() if content[leaf] for i in inner}
        order = sorted((i for i, t in enumerate(self.text) if t is not None and content[i] and i not in held), key=lambda i: self.at[i])
        out = [self._filled(i, content) for i in order]
        return [t for t in out if t]

    def _filled(self, leaf: int, content: list[bool]) -> str:
        if leaf not in self.slots:
            return self.text[leaf] or ""
        first, *rest = (self.text[leaf] or "").split(SLOT)
        parts = [first]
        for i, t in zip(self.slots[leaf], rest, strict=True):
            parts += [self._filled(i, content) if content[i] else "", t]
        return " ".join("".join(parts).split())


def names(attributes: str) -> tuple[str, ...]:
    """The words of class, id, role and aria-label, lower-cased; camel case is split."""
    found = (a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(attributes))
    return tuple(t.lower() for x in found for t in _TOKEN.findall(_CAMEL.sub(" ", unescape(x))))


class _Line:
    """The text of a block as it is read: pieces, and numbers of embedded leaves between them."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.inner: list[int] = []
        self.linked, self.at = 0, -1


def parse(html: str) -> Tree:
    """The page's tree. Leaves hold decoded text with white space turned into single spaces."""
    html = html.replace(SLOT, "")
    tree, stack, links, pos = Tree(), [(0, "#page")], 0, 0
    line, outer = _Line(), []  # outer: (depth of an open embedded element, the line around it)
    opened: dict[str, list[int]] = defaultdict(list)
    scopes: list[int] = []

    def flush() -> int | None:
        """End the line; the number of its leaf, if it has text."""
        nonlocal line
        done, line = line, _Line()
        if not done.pieces:
            return None
        text = " ".join(unescape("".join(done.pieces)).split())
        if not text.replace(SLOT, "").strip():
            return None
        leaf = tree.add(stack[-1][0], "#text", (), text, min(done.linked, len(text)))
        tree.at[leaf] = done.at
        if done.inner:
            tree.slots[leaf] = done.inner
        return leaf

    def push(name: str, rest: str) -> None:
        stack.append((tree.add(stack[-1][0], name, names(rest) if rest else (), None, 0), name))
        opened[name].append(len(stack) - 1)
        if name in _SCOPE:
            scopes.append(len(stack) - 1)

    def cut(size: int) -> None:
        """Close elements until so many are open; an embedded one leaves its last leaf in the line around it."""
        nonlocal line
        while len(stack) > size:
            leaf = flush()
            if outer and outer[-1][0] == len(stack):
                line = outer.pop()[1]
                if leaf is not None:
                    line.pieces.append(SLOT)
                    line.inner.append(leaf)
            name = stack.pop()[1]
            opened[name].pop()
            if name in _SCOPE:
                scopes.pop()

    while True:
        m = _TAG.search(html, pos)
        run = html[pos : m.start()] if m else html[pos:]
        if run:
            if line.at < 0 and not run.isspace():
                line.at = pos
            line.pieces.append(run)
            if links:
                line.linked += len(run)
        if not m:
            break
        pos = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not rest.endswith("/"):
                pos = re.compile(rf"</{re.escape(name)}\b[^>]*>|\Z", re.I).search(html, pos).end()
            continue
        if name in EMBEDDED:
            if not closing and not rest.endswith("/"):
                outer.append((len(stack) + 1, line))
                line = _Line()
                push(name, rest)
                if name == "textarea":
                    end = re.compile(r"(?=</textarea\b)|\Z", re.I).search(html, pos).end()
                    line.pieces, line.at, pos = [html[pos:end].replace("<", "&lt;")], pos, end
            elif closing and opened[name]:
                cut(opened[name][-1])
            continue
        if name not in BLOCK and "-" not in name:
            if name == "br":
                line.pieces.append(" ")
            elif name == "a":
                links = max(0, links + (-1 if closing else 1))
            continue
        if closing:
            flush()
            if opened[name]:
                cut(opened[name][-1])
                links = 0
            continue
        flush()
        if stack[-1][1] == "p":
            cut(len(stack) - 1)
        scope = scopes[-1] if scopes else 0
        ends = [i for x in _CLOSES.get(name, ()) for i in opened[x][-1:] if i > scope]
        if ends:
            cut(min(ends))
        links = 0
        if name not in VOID:
            push(name, rest)
    cut(1)
    flush()
    return tree
