"""Tag soup to a preorder list of nodes: the one Python step of the library.

A small helper for the Arrow function in ``nodes.py``. It repairs markup by a fixed set of
rules and knows nothing about scoring, dates or selectors; those are Spark's work.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

from ..functions.weights import BLOCK_PREFIX

# Tag classes of the repair rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("html head title meta link script style base noscript".split())
RAW_TEXT = frozenset(("script", "style"))
CLOSES_P = frozenset(
    "address article aside blockquote center dd dir div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section table td th tr ul".split())
SCOPE = frozenset("table td th html body object button".split())
# tag -> (open tags it closes, tags the search stops at)
CLOSES_LIKE = {
    "li": (("li",), ("ul", "ol", "table", "body")),
    "dt": (("dt", "dd"), ("dl", "table", "body")),
    "dd": (("dt", "dd"), ("dl", "table", "body")),
    "option": (("option",), ("select", "body")),
    "td": (("td", "th"), ("tr", "table", "body")),
    "th": (("td", "th"), ("tr", "table", "body")),
    "tr": (("tr",), ("table", "body")),
    "a": (("a",), ("table", "td", "th", "body", "object")),
}
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<[!?](?P<decl>[^>]*+)>"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)/?>",
    re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_DIGIT = re.compile(r"\d")
# a comment with start tags of blocks has this for its tag
BLOCKS = "#blocks"
_BLOCK = re.compile("<" + BLOCK_PREFIX.removeprefix("^"), re.I)


def attributes(source: str) -> dict[str, str]:
    """Attributes of a start tag; the first of a repeated name wins."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


class Tree:
    """Open elements and the rows made so far for one page."""

    def __init__(self, path_tags: frozenset[str] = frozenset(), want_raw: bool = True):
        self.rows: list[list] = []
        self.tags: list[str] = []     # open elements, outermost first
        self.ids: list[int] = []
        self.links = 0                # how many of them are links
        self.has_body = False
        self.path_tags, self.want_raw = path_tags, want_raw
        self.path: list[int] = []     # open elements of the path tags

    def add(self, kind, tag=None, attrs=None, text=None, raw=None) -> int:
        ids, node_id = self.ids, len(self.rows) + 1
        if not (self.want_raw and raw is not None and _DIGIT.search(raw)):
            raw = None
        cls, id_attr, pairs = None, None, None
        if attrs:
            cls, id_attr, pairs = attrs.get("class"), attrs.get("id"), list(attrs.items())
        self.rows.append([
            node_id, ids[-1] if ids else 0, ids[-2] if len(ids) > 1 else 0, node_id, kind, tag, cls,
            id_attr, self.links > 0 or tag == "a", text, raw, self.path.copy(),
            pairs])
        return node_id

    def push(self, tag: str, node_id: int) -> None:
        self.tags.append(tag)
        self.ids.append(node_id)
        self.links += tag == "a"
        if tag in self.path_tags:
            self.path.append(node_id)

    def pop_to(self, depth: int) -> None:
        """Close open elements until ``depth`` are left."""
        last = len(self.rows)
        for node_id in self.ids[depth:]:
            self.rows[node_id - 1][3] = last
        self.links -= self.tags[depth:].count("a")
        if self.path:
            del self.path[bisect_left(self.path, self.ids[depth]) if depth < len(self.ids) else len(self.path):]
        del self.ids[depth:], self.tags[depth:]

    def close_open(self, tags, stops) -> None:
        for i in range(len(self.tags) - 1, -1, -1):
            tag = self.tags[i]
            if tag in tags:
                return self.pop_to(i)
            if tag in stops:
                return None
        return None

    def need_body(self) -> None:
        """Open ``html`` and ``body`` when content comes without them."""
        if not self.tags:
            self.push("html", self.add("e", "html"))
        if not self.has_body:
            self.pop_to(1)
            self.has_body = True
            self.push("body", self.add("e", "body"))

    def start(self, tag: str, attr_text: str, raw: str) -> bool:
        """Returns whether the element was left open."""
        attrs = attributes(attr_text) if attr_text.strip(" /") else {}
        if tag == "html":
            if not self.rows:
                self.push(tag, self.add("e", tag, attrs, raw=raw))
            return False
        if tag == "body":
            if self.has_body:
                return False
            if not self.tags:
                self.push("html", self.add("e", "html"))
            self.pop_to(1)
            self.has_body = True
        elif tag == "head":
            if self.has_body or len(self.tags) > 1:
                return False
            if not self.tags:
                self.push("html", self.add("e", "html"))
        elif tag not in HEAD_ONLY:
            self.need_body()
        elif not self.tags:
            self.push("html", self.add("e", "html"))
        if tag in CLOSES_P and "p" in self.tags:
            self.close_open(("p",), SCOPE)
        if tag in CLOSES_LIKE:
            self.close_open(*CLOSES_LIKE[tag])
        node_id = self.add("e", tag, attrs, raw=raw)
        if tag in VOID:
            return False
        self.push(tag, node_id)
        return True

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        stops = () if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") else ("td", "th", "body")
        self.close_open((tag,), stops)

    def text(self, source: str) -> None:
        if not source:
            return
        if not source.isspace() and not (self.tags and self.tags[-1] == "title"):
            self.need_body()
        self.add("t", text=unescape(source) if "&" in source else source, raw=source)


def parse(html: str, path_tags: frozenset[str] = frozenset(), want_raw: bool = True) -> list[list]:
    """Rows of one page in the column order of the node schema; ``path`` lists open elements of ``path_tags``."""
    tree, at, lower = Tree(path_tags, want_raw), 0, None
    scan = _TOKEN.search
    while True:
        token = scan(html, at)
        if token is None:
            tree.text(html[at:])
            break
        tree.text(html[at:token.start()])
        at = token.end()
        if token["name"]:
            tag = token["name"].lower()
            if token["close"]:
                tree.end(tag)
                continue
            opened = tree.start(tag, token["attrs"], token[0])
            if tag in RAW_TEXT:
                lower = lower if lower is not None else html.lower()
                stop = lower.find(f"</{tag}", at) if len(lower) == len(html) else html.find(f"</{tag}", at)
                stop = stop if stop >= 0 else len(html)
                if stop > at:
                    body = html[at:stop]
                    if opened:
                        tree.add("t", text=body, raw=body)
                at = stop
        elif token["comment"] is not None:
            tree.add("c", tag=BLOCKS if _BLOCK.search(token["comment"]) else None, raw=token["comment"])
    tree.pop_to(0)
    return tree.rows


def parse_or_reason(html: str, path_tags: frozenset[str] = frozenset(), want_raw: bool = True) -> tuple[list[list], str | None]:
    """The rows; for a page that can't be parsed none, and the reason. The others of its batch go on."""
    try:
        return parse(html, path_tags, want_raw), None
    except Exception as odd:   # whatever is odd about one page
        return [], f"{type(odd).__name__}: {odd}"
