"""A tolerant HTML tree with CSS selectors, parsed once for each page in Arrow-batched functions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A start tag of the key ends an open element of these.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
ENDS |= {t: {"p"} for t in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "pre", "form", "blockquote")}
SCOPE = {"table", "ul", "ol", "div", "body", "html", "section", "article", "dl", "select"}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)  # nodes and texts

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def siblings_after(self):
        """Elements after this one under the same parent."""
        nodes = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        return nodes[next(i for i, n in enumerate(nodes) if n is self) + 1 :] if nodes else []

    def select(self, selector: str) -> list[Node]:
        groups = compiled(selector)
        return [n for n in self.walk() if any(_fits(n, g) for g in groups)]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)


class _Builder(HTMLParser):
    def __init__(self, written: bool = False):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#document")
        self.written = written

    def feed(self, data):
        super().feed(data.replace("&", "&amp;") if self.written else data)

    def handle_starttag(self, tag, attrs):
        ends, node = ENDS.get(tag, set()), self.here
        while node.parent is not None and node.tag not in SCOPE:
            if node.tag in ends:
                self.here = node.parent
            node = node.parent
        child = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.here)
        self.here.children.append(child)
        if tag not in VOID:
            self.here = child

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        # Scripts and styles are not unescaped.
        self.here.children.append(data.replace("&amp;", "&") if self.written and self.cdata_elem else data)


def parse(html: str | None, written: bool = False) -> Node:
    """A page's tree. written: character references stay as they're written."""
    builder = _Builder(written)
    builder.feed(html or "")
    builder.close()
    return builder.root


_PART = re.compile(r"""\*|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|(?P<tag>[A-Za-z][\w-]*)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]""")


@lru_cache(maxsize=256)
def compiled(selector: str) -> tuple:
    """Selector groups as tuples of (combinator, tests), the last compound first. Raises ValueError for what isn't supported."""
    groups = []
    for group in selector.split(","):
        steps, comb, i, group = [], " ", 0, group.strip()
        if not group:
            raise ValueError(f"empty selector in {selector!r}")
        while i < len(group):
            gap = re.compile(r"\s*([>+~])\s*|\s+").match(group, i)
            if gap:
                comb, i = (gap.group(1) or " "), gap.end()
                continue
            tests = []
            while (m := _PART.match(group, i)) and i < len(group):
                tests.append(m.groupdict())
                i = m.end()
            if not tests:
                raise ValueError(f"can't read selector {selector!r} at {group[i:]!r}")
            steps.append((comb, tuple(tuple(sorted(t.items())) for t in tests)))
            comb = " "
        groups.append(tuple(reversed(steps)))
    return tuple(groups)


def _holds(node: Node, tests: tuple) -> bool:
    for t in map(dict, tests):
        if t["tag"] and node.tag != t["tag"].lower() or t["id"] and node.attrs.get("id") != t["id"] or t["cls"] and t["cls"] not in node.classes():
            return False
        if t["attr"]:
            have, want = node.attrs.get(t["attr"].lower()), t["q"] if t["q"] is not None else t["s"] if t["s"] is not None else t["bare"]
            if have is None:
                return False
            ok = {None: True, "=": have == want, "^=": bool(want) and have.startswith(want or ""), "$=": bool(want) and have.endswith(want or ""), "*=": bool(want) and (want or "") in have, "~=": want in have.split(), "|=": have == want or have.startswith(f"{want}-")}
            if not ok[t["op"]]:
                return False
    return True


def _fits(node: Node, steps: tuple) -> bool:
    (comb, tests), rest = steps[0], steps[1:]
    if not _holds(node, tests):
        return False
    if not rest:
        return True
    if comb in " >":
        up = node.parent
        while up is not None and up.tag != "#document":
            if _fits(up, rest):
                return True
            up = up.parent if comb == " " else None
        return False
    before = [c for c in node.parent.children if isinstance(c, Node)]
    before = before[: next(i for i, n in enumerate(before) if n is node)]
    return any(_fits(n, rest) for n in (before[-1:] if comb == "+" else before))


def select(html: Column, selector: str, attr: str | None = None, written: bool = False) -> Column:
    """Texts of the elements that a selector finds in a page, or an attribute of those that have it.

    written: character references stay as they're written.
    """
    compiled(selector)

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            found = parse(page, written).select(selector)
            out.append([n.text() for n in found] if attr is None else [n.attrs[attr] for n in found if attr in n.attrs])
        return pd.Series(out)

    return run(html)


def records(pages: DataFrame, rows: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """A row for each element that `rows` finds, with a string column for each field: `selector` (text, trimmed) or `selector@attribute`.

    The page is parsed once, whatever the number of fields. An empty selector means the element itself.
    """
    names = list(fields)
    keys = [c for c in pages.columns if c != html]
    schema = "array<struct<" + ",".join(f"`{n}`:string" for n in names) + ">>"

    @F.pandas_udf(schema)
    def run(column: pd.Series) -> pd.Series:
        def read(node: Node, spec: str):
            selector, _, attr = spec.partition("@")
            found = node.first(selector) if selector else node
            return None if found is None else found.attrs.get(attr) if attr else found.text().strip()

        return pd.Series([[{n: read(node, fields[n]) for n in names} for node in parse(page).select(rows)] for page in column])

    return pages.select(*keys, F.posexplode(run(F.col(html))).alias("position", "record")).select(*keys, "position", "record.*")


def anchors(html: Column, selector: str = "a[href]") -> Column:
    """Raw href values of the elements a selector finds."""
    return select(html, selector, "href")
