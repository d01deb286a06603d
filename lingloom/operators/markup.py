"""A small reader of book markup: a tree of elements, lenient with what is not closed."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

# Elements that are segments, elements whose text is not converted, inline elements.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote figcaption dt dd".split())
SKIPPED = frozenset("script style code pre rt rp".split())
INLINE = frozenset("em strong b i u s span a mark".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that a new one of these kinds ends.
CLOSED_BY = {"p": BLOCKS - {"td", "th"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: An implied end does not reach out of these.
SCOPES = frozenset("table ul ol dl div section article body html td th li dd dt".split())
# Parts of class names, and character ranges of texts, that are left as they are.
OPAQUE_CLASSES = ("name", "title", "ruby", "con-box", "chara", "author", "illus", "label", "num", "index")
KANA = re.compile("[぀-ヿ]")
KATAKANA = re.compile("[゠-ヿ]{3,}")
CYRILLIC = re.compile("[Ѐ-ӿ\\s,.!?'\"「」]+")
LEFT, RIGHT = "\ue000", "\ue001"
MASK = re.compile(f"{LEFT}(\\d+){RIGHT}")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def inner(self) -> str:
        raw = self.tag in ("script", "style")
        return "".join((c if raw else html.escape(c, quote=False)) if isinstance(c, str) else c.outer() for c in self.children)

    def outer(self) -> str:
        attrs = "".join(f" {k}" if v is None else f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}/>" if self.tag in VOID and not self.children else f"<{self.tag}{attrs}>{self.inner()}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = self.at
        while node is not self.root:
            if tag in CLOSED_BY.get(node.tag, ()):
                self.at = node.parent
                break
            if node.tag in SCOPES:
                break
            node = node.parent
        new = Node(tag, dict(attrs), self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def has_opaque_class(node: Node | None) -> bool:
    names = ((node.attrs.get("class") or "") if node is not None else "").lower().split()
    return any(k in n for n in names for k in OPAQUE_CLASSES)


def is_opaque(node: Node) -> bool:
    """Left as it is: without text, a ruby, of a telling class, of a telling text, or inside a parent of a telling class."""
    text = node.text().strip()
    told = not text or node.tag == "ruby" or has_opaque_class(node) or has_opaque_class(node.parent)
    return bool(told or KATAKANA.fullmatch(text) or CYRILLIC.fullmatch(text) or len(text) <= 8 and KANA.search(text))


def mask(node: Node) -> list[str]:
    """Replaces the outermost opaque inline elements below node by numbered marks; returns their markup in order."""
    saved: list[str] = []

    def visit(at: Node) -> None:
        for k, child in enumerate(at.children):
            if isinstance(child, Node):
                if child.tag not in BLOCKS and is_opaque(child):
                    at.children[k] = f"{LEFT}{len(saved)}{RIGHT}"
                    saved.append(child.outer())
                else:
                    visit(child)

    visit(node)
    return saved


def unmask(text: str, saved: list[str]) -> str:
    """Marks replaced by what they stand for; a number that is not there is left."""
    return MASK.sub(lambda m: saved[int(m[1])] if int(m[1]) < len(saved) else m[0], text)


def segments(markup: str) -> list[dict]:
    """tag, kind, text, mask of every block element in order, of nested ones too, and of the title."""
    root, out = parse(markup), []
    for node in list(root.walk()):
        if node.tag in BLOCKS and not any(a.tag in SKIPPED for a in node.ancestors()) and node.text().strip():
            if any(c.tag in INLINE for c in node.walk()):
                copy = next(c for c in parse(node.outer()).children if isinstance(c, Node))
                copy.parent = node.parent
                saved = mask(copy)
                if copy.inner().strip():
                    out.append({"tag": node.tag, "kind": "html", "text": copy.inner(), "mask": saved})
            else:
                out.append({"tag": node.tag, "kind": "plain", "text": node.text(), "mask": []})
    title = next((n for n in root.walk() if n.tag == "title"), None)
    if title is not None and title.text().strip():
        out.append({"tag": "title", "kind": "title", "text": title.text().strip(), "mask": []})
    return out
