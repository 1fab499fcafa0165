"""HTML pages as trees, scanned tolerantly: no page is an error.

A page is cut into comments, declarations, tags and text. Script and style hold text up to their end tag, title and textarea text with
entities. Void elements have no content; an element of the same kind, or a block in a paragraph, ends one that was left open; an end tag closes what is
open within its element, and counts for nothing if that isn't open; the end of the page closes all. Names are in lower case. Of repeated
attributes the first counts. Null and empty pages have no elements.

A tree is a row of arrays in the order of start tags, so that a node's place is its preorder number: labels; ends (the place behind a node's
last descendant); depths; parents (places, null for roots); texts (a node's own text, entities resolved, blanks between parts kept); attributes as maps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content; with text alone; that begin anew what is left open; blocks that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW, TEXT = frozenset(("script", "style")), frozenset(("title", "textarea"))
AGAIN = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
INSIDE = {"li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_PART = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:[^"'>]+|"[^"]*"|'[^']*')*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW | TEXT}

TREE = "labels array<string>, ends array<int>, depths array<int>, parents array<int>, texts array<string>, attributes array<map<string,string>>"


class _Tree:
    """A tree as it is read."""

    def __init__(self, plain: Callable[[str], str]) -> None:
        self.plain = plain
        self.labels: list[str] = []
        self.ends: list[int] = []
        self.depths: list[int] = []
        self.parents: list[int | None] = []
        self.texts: list[list[str]] = []
        self.attributes: list[dict[str, str]] = []
        self.open: list[int] = []

    def begin(self, name: str, attributes: str) -> None:
        self.leave(name)
        given: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            given.setdefault(m[1].lower(), self.plain(next((x for x in m.groups()[1:] if x is not None), "")))
        self.labels.append(name)
        self.ends.append(len(self.labels))
        self.depths.append(len(self.open))
        self.parents.append(self.open[-1] if self.open else None)
        self.texts.append([])
        self.attributes.append(given)
        if name not in VOID:
            self.open.append(len(self.labels) - 1)

    def leave(self, name: str) -> None:
        """Elements left open that an element of this name ends."""
        ended = AGAIN.get(name, "p" if name in BLOCKS else "").split()
        border = INSIDE.get(name, "").split()
        for k in range(len(self.open) - 1, -1, -1):
            label = self.labels[self.open[k]]
            if label in border:
                return
            if label in ended:
                self.close(k)
                return

    def close(self, k: int) -> None:
        """The k-th open element and what is open in it."""
        for node in self.open[k:]:
            self.ends[node] = len(self.labels)
        del self.open[k:]

    def end(self, name: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.labels[self.open[k]] == name:
                self.close(k)
                return

    def text(self, text: str) -> None:
        if text and self.open:
            self.texts[self.open[-1]].append(text)


def read_tree(page: str | None, plain: Callable[[str], str] = unescape) -> tuple[list, ...]:
    """The arrays of a page's tree, as in TREE. plain: resolves the entities of a text."""
    tree, at, page = _Tree(plain), 0, page or ""
    while m := _PART.search(page, at):
        tree.text(plain(page[at : m.start()]))
        at = m.end()
        if m[1]:
            tree.end(m[1].lower())
        elif m[2]:
            name = m[2].lower()
            tree.begin(name, m[3])
            if name in _END:
                end = _END[name].search(page, at)
                inner = page[at : end.start() if end else len(page)]
                tree.text(inner if name in RAW else plain(inner))
                tree.end(name)
                at = end.end() if end else len(page)
    tree.text(plain(page[at:]))
    tree.close(0)
    return tree.labels, tree.ends, tree.depths, tree.parents, ["".join(t) for t in tree.texts], tree.attributes


#: Characters of pages whose trees are handed on together, about: trees take many times the room of their pages.
TREES_CHARS = 1 << 20


def _some(entities: Mapping[str, str]) -> Callable[[str], str]:
    """Resolves these entities alone."""
    known = re.compile("|".join(map(re.escape, sorted(entities, key=len, reverse=True))) or r"(?!)")
    return lambda text: known.sub(lambda m: entities[m[0]], text)


def page_trees(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", entities: Mapping[str, str] | None = None) -> DataFrame:
    """The id and the tree of each page, in one pass. entities: those that texts and attributes are resolved of, by default all of HTML."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = unescape if entities is None else _some(entities)
        made = lambda rows: pd.DataFrame(rows, columns=["_id", "labels", "ends", "depths", "parents", "texts", "attributes"])
        for df in frames:
            rows, chars = [], 0
            for i, h in zip(df["_id"], df["_html"], strict=True):
                rows.append((i, *read_tree(h if isinstance(h, str) else None, plain)))
                chars += len(h) if isinstance(h, str) else 0
                if chars >= TREES_CHARS:
                    yield made(rows)
                    rows, chars = [], 0
            yield made(rows)

    own = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))
    return own.mapInPandas(run, f"_id {own.schema['_id'].dataType.simpleString()}, {TREE}").withColumnRenamed("_id", id_col)


def links(trees: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, k, href, text of every element a with a target, k counting from 0; the text is the element's own."""
    zipped = F.filter(F.arrays_zip("labels", "texts", "attributes"), lambda x: (x.labels == "a") & F.map_contains_key(x.attributes, "href"))
    return trees.select(id_col, F.posexplode(zipped).alias("k", "x")).select(id_col, "k", F.col("x.attributes")["href"].alias("href"), F.col("x.texts").alias("text"))


def titles(trees: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id and the text of the first title (null: none)."""
    return trees.select(id_col, F.get(F.col("texts"), (F.array_position("labels", "title") - 1).cast("int")).alias("title"))

