"""A small HTML tree on the standard library's parser, with the selectors that the sources need.

Markup of plain tags only (most of it) is cut by one pattern into what the parser would make of it; any other
goes to the parser whole. Nodes are kept in document order, so those below a node are a stretch of them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_RAW = frozenset(("script", "style"))
_PART = re.compile(r'([.#]?[\w:-]+|\*)|\[([\w:-]+)(?:([\^*]?)="([^"]*)")?\]')


#: A text, the end or start of a tag without anything that the parser would read in a way of its own, or any other <.
_TOKEN = re.compile(r'([^<]+)|</([a-z][a-z0-9]*)>|<([a-z][a-z0-9]*)((?:[ \n]+[a-z][a-z0-9-]*=(?:"[^"&<>]*"|\'[^\'&<>]*\'))*) ?(/?)>|(<)')
_ATTR = re.compile(r'([a-z][a-z0-9-]*)=(?:"([^"]*)"|\'([^\']*)\')')
#: Tags whose content the parser reads otherwise, or may in another version of it.
_OTHERWISE = frozenset(("iframe", "math", "noembed", "noframes", "noscript", "plaintext", "style", "svg", "textarea", "title", "xmp"))


@lru_cache(maxsize=1024)
def _compound(text: str) -> Callable[[Node], bool]:
    """Whether a node fits a compound of a selector."""
    parts = _PART.findall(text)
    tags = [n for n, *_ in parts if n and n[0] not in ".#*"]
    ids, classes = ([n[1:] for n, *_ in parts if n.startswith(c)] for c in "#.")
    attrs = [(attr, how, value) for n, attr, how, value in parts if not n]
    if len(parts) == 1 and tags:
        return lambda node, tag=tags[0]: node.tag == tag
    if len(parts) == 1 and attrs and attrs[0][2] and not attrs[0][1]:
        return lambda node, attr=attrs[0][0], value=attrs[0][2]: node.attrs.get(attr) == value
    tag, more, wanted = (tags or [None])[0], tags[1:], frozenset(classes)

    def fits(node: Node) -> bool:
        if tag is not None and node.tag != tag:
            return False
        own_attrs = node.attrs
        for attr, how, value in attrs:
            own = own_attrs.get(attr)
            if own is None or not (own.startswith(value) if how == "^" else value in own if how == "*" else not value or own == value):
                return False
        if wanted and not ("class" in own_attrs and wanted.issubset(own_attrs["class"].split())):
            return False
        for name in ids:
            if own_attrs.get("id", "") != name:
                return False
        return not more or all(node.tag == t for t in more)

    return fits


@lru_cache(maxsize=1024)
def _selector(text: str) -> tuple[list[Callable[[Node], bool]], Callable[[Node], bool]]:
    *above, last = text.split()
    return [_compound(c) for c in above], _compound(last)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "every", "place", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.every: list[Node] = [] if parent is None else parent.every  # of the document, in order
        self.place = place = len(self.every)
        self.end = place + 1  # where what is below ends in that order; right once all is parsed
        self.every.append(self)

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def walk(self) -> Iterator[Node]:
        """Every node below, in document order."""
        return iter(self.every[self.place + 1 : self.end])

    def strings(self) -> Iterator[str]:
        if self.end == self.place + 1:
            return iter(self.children)
        return (x for x in self._below() if not isinstance(x, Node))

    def _below(self) -> Iterator[Node | str]:
        """All below, in document order; however deep the markup is, without recursion."""
        open_ = [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
                continue
            yield child
            if isinstance(child, Node):
                open_.append(iter(child.children))

    def text(self) -> str:
        return "".join(self.strings())

    def tight(self, by: str = "") -> str:
        """The strings below, each stripped, without empty ones."""
        if len(self.children) == 1 and self.end == self.place + 1:
            return self.children[0].strip()
        return by.join(s for s in (x.strip() for x in self.strings()) if s)

    def inner(self) -> str:
        """The markup below."""
        out, open_ = [], [(self, iter(self.children))]
        while open_:
            node, rest = open_[-1]
            child = next(rest, None)
            if child is None:
                open_.pop()
                out.append(f"</{node.tag}>" if open_ else "")
            elif not isinstance(child, Node):
                out.append(child if node.tag in _RAW else html.escape(child, quote=False))
            else:
                attrs = "".join(f' {k}="{html.escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in child.attrs.items())
                out.append(f"<{child.tag}{attrs}/>" if child.tag in _VOID else f"<{child.tag}{attrs}>")
                if child.tag not in _VOID:
                    open_.append((child, iter(child.children)))
        return "".join(out)

    def fits(self, compound: str) -> bool:
        return _compound(compound)(self)

    def select(self, selector: str) -> Iterator[Node]:
        """Nodes below that fit a selector of compounds, each below the one before it."""
        above, last = _selector(selector)
        for node in filter(last, self.walk()):
            at, left = node.parent, list(above)
            while left and at is not None and at is not self.parent:
                if left[-1](at):
                    left.pop()
                at = at.parent
            if not left:
                yield node

    def first(self, selector: str) -> Node | None:
        above, last = _selector(selector)
        if above:
            return next(self.select(selector), None)
        return next(filter(last, self.walk()), None)

    def above(self, selector: str) -> Node | None:
        at, fits = self.parent, _compound(selector)
        while at is not None and not fits(at):
            at = at.parent
        return at

    def following(self, selector: str) -> Node | None:
        """The first fitting node after this one's start tag in the document."""
        fits = _compound(selector)
        for place in range(self.place + 1, len(self.every)):
            if fits(self.every[place]):
                return self.every[place]
        return None

    def sibling(self, selector: str) -> Node | None:
        seen = False
        for child in self.parent.children if self.parent else []:
            if seen and isinstance(child, Node) and child.fits(selector):
                return child
            seen = seen or child is self
        return None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag) -> None:
        at = self.at
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.at = at.parent

    def handle_data(self, data) -> None:
        self.at.children.append(data)


@lru_cache(maxsize=1024)
def _attrs(text: str) -> dict[str, str]:
    """A plain tag's attributes; tags that are written alike share them."""
    return {k: v or w for k, v, w in _ATTR.findall(text)}


def _plain(markup: str) -> Node | None:
    """The tree of markup that has plain tags only, as the parser would build it; None of any other."""
    root = at = Node("", {}, None)
    every, raw = root.every, False
    for text, ends, tag, attrs, empty, other in _TOKEN.findall(markup):
        if raw and not text and ends != "script":
            return None
        if text:
            at.children.append(html.unescape(text) if "&" in text and not raw else text)
        elif ends:
            raw, up = False, at
            while up is not root and up.tag != ends:
                up = up.parent
            if up is not root:
                while at is not up.parent:
                    at.end, at = len(every), at.parent
        elif other or tag in _OTHERWISE or (tag == "script" and empty):
            return None
        else:
            node = Node(tag, (_attrs(attrs) if len(attrs) < 256 else _attrs.__wrapped__(attrs)) if attrs else {}, at)
            at.children.append(node)
            if not empty and tag not in _VOID:
                at, raw = node, tag == "script"
    while at is not None:
        at.end, at = len(every), at.parent
    return None if raw else root


def _parsed(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    for node in reversed(builder.root.every[1:]):
        if node.end > node.parent.end:
            node.parent.end = node.end
    return builder.root


def parse(markup: str | None) -> Node:
    return _plain(markup or "") or _parsed(markup or "")
