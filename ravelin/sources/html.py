"""Title, article text and links of HTML pages, in one pass of an Arrow-batched function over a small tree builder.

The tree follows the rules of HTML that matter for articles: void elements, implied ends of ``p``, list items and table
parts, raw text in scripts and styles, and unclosed elements that end with their parent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.urls import LinkPolicy, resolve_link

#: A paragraph counts from so many characters on.
MIN_PARAGRAPH = 40

# Elements that never have content, that end an open paragraph, and that end an open element of their kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt""".split()
)
ENDS_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
SCOPES = frozenset("table td th ul ol dl caption html body button".split())

# Where the article is, first match wins, and what is taken out of it: element, class or id.
ROOTS = ((("id", "mw-content-text"), ("class", "mw-parser-output")), (("id", "mw-content-text"),), (("tag", "main"),), (("tag", "body"),))
NOISE_TAGS = frozenset("style script noscript".split())
NOISE_CLASSES = frozenset("reflist references mw-references-wrap toc mw-editsection hatnote navbox sidebar thumbcaption".split())
NOISE_TABLES = frozenset("infobox navbox vertical-navbox metadata".split())

_SPACES = re.compile(r"\s+")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        """This element and all below it in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: Callable[[Node], bool] = lambda node: False) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif not skip(item):
                stack.extend(reversed(item.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def _close(self, wanted: set[str], limit: frozenset[str]) -> None:
        """End the innermost open element of a wanted kind, unless a limiting one lies between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in wanted:
                del self.open[i:]
                return
            if self.open[i].tag in limit:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, SCOPES)
        if tag in ENDS_SIBLING:
            self._close(ENDS_SIBLING[tag], SCOPES - ENDS_SIBLING[tag])
        if tag == "body" and any(n.tag == "head" for n in self.open):
            self._close({"head"}, frozenset())
        given: dict[str, str] = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        node = Node(tag, given)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing outside void elements

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p"))
        else:
            limit = frozenset({"table"}) if tag in TABLE_PARTS else frozenset({"td", "th", "caption", "table"})
            self._close({tag}, frozenset() if tag in ("body", "html") else limit - {tag})

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse_html(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _is(node: Node, kind: str, value: str) -> bool:
    if kind == "tag":
        return node.tag == value
    return node.attrs.get("id") == value if kind == "id" else value in node.classes


def _find(node: Node, path: tuple[tuple[str, str], ...]) -> Node | None:
    found: Node | None = node
    for kind, value in path:
        found = next((n for n in found.walk() if n is not found and _is(n, kind, value)), None)
        if found is None:
            return None
    return found


def _noise(node: Node) -> bool:
    classes = node.classes
    return (
        node.tag in NOISE_TAGS
        or bool(classes & NOISE_CLASSES)
        or node.attrs.get("id") == "toc"
        or (node.tag == "table" and bool(classes & NOISE_TABLES))
        or (node.tag == "sup" and "reference" in classes)
    )


def clean(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


def _tree(html: str | Node | None) -> Node:
    return html if isinstance(html, Node) else parse_html(html or "")


def page_content(html: str | Node | None) -> tuple[str, str]:
    """Title and article text. Paragraphs of ``MIN_PARAGRAPH`` characters or more, else the whole text of the article."""
    tree = _tree(html)
    title = next((n for n in tree.walk() if n.tag == "title"), None)
    title_text = clean(title.text()) if title else ""
    root = next((r for r in (_find(tree, path) for path in ROOTS) if r is not None), None)
    if root is None:  # a page without a body element has one all the same
        root = Node("body", children=[c for c in tree.children if not (isinstance(c, Node) and c.tag in ("head", "title"))])

    def skip(node: Node) -> bool:
        return node is not root and _noise(node)

    kept: list[str] = []
    stack: list[Node] = [root]
    while stack:
        node = stack.pop()
        if skip(node):
            continue
        if node.tag == "p" and node is not root:
            text = clean(node.text(skip))
            if len(text) >= MIN_PARAGRAPH:
                kept.append(text)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return title_text, "\n\n".join(kept) if kept else clean(root.text(skip))


def page_links(html: str | Node | None, base: str, policy: LinkPolicy) -> list[str]:
    """Addresses of ``a`` elements in document order that can be articles, first appearances only; see ``is_article``."""
    links: dict[str, None] = {}
    for node in _tree(html).walk():
        if node.tag == "a" and "href" in node.attrs:
            link = resolve_link(node.attrs["href"], base, policy)
            title = link.removeprefix(policy.root)
            fits = link.startswith(policy.root) and title not in ("", "Main_Page") and ":" not in title
            if fits and "(disambiguation)" not in title.lower():
                links.setdefault(link)
    return list(links)


def extract(pages: DataFrame, policy: LinkPolicy | None = None) -> DataFrame:
    """Adds ``title``, ``body`` and ``links`` to pages with ``url`` and ``html``; null html counts as empty."""
    rules = policy or LinkPolicy()

    @F.pandas_udf("title string, body string, links array<string>")
    def parts(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = []
        for page, base in zip(html, url, strict=True):
            tree = parse_html(page or "")
            rows.append((*page_content(tree), page_links(tree, base or "", rules)))
        return pd.DataFrame(rows, columns=["title", "body", "links"])

    found = pages.drop("title", "body", "links").withColumn("_parts", parts("html", "url"))
    return found.select("*", "_parts.*").drop("_parts")
