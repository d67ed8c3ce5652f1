"""Article text of one page, worked out node by node on a tree: the slow check of the windows."""

import re

from pageloom.functions import weights
from pageloom.operators.html_tree import parse


class Node:
    def __init__(self, row):
        self.id, self.parent_id, self.kind, self.tag = row[0], row[1], row[4], row[5]
        self.cls, self.own_id, self.own_text = row[6] or "", row[7] or "", row[9] or ""
        self.children, self.parent, self.score = [], None, None

    def walk(self):
        yield self
        for child in self.children:
            yield from child.walk()

    def below(self, *tags):
        return [n for c in self.children for n in c.walk() if n.kind == "e" and n.tag in tags]

    @property
    def text(self):
        return "".join(n.own_text for n in self.walk())

    @property
    def density(self):
        length = len(self.text)
        return sum(len(a.text) for a in self.below("a")) / length if length else None

    @property
    def weight(self):
        total = 0
        for value in (self.cls, self.own_id):
            total -= 25 * bool(re.search(weights.NEGATIVE, value))
            total += 25 * bool(re.search(weights.POSITIVE, value))
        return total

    def cut(self):
        self.parent.children.remove(self)


def build(html):
    root = Node([0, None, None, None, "d", None, None, None, None, None])
    by_id = {0: root}
    for row in parse(html):
        node = by_id[row[0]] = Node(row)
        node.parent = by_id[row[1]]
        node.parent.children.append(node)
    return root


def fields(text):
    bare = text.rstrip(",")
    return len(bare.split(",")) if bare else 0


def one_pass(html, drop_unlikely):
    root = build(html)
    for node in [n for n in root.walk() if n.kind == "e"]:
        marks = node.cls + node.own_id
        unlikely = (re.search(weights.UNLIKELY, marks) and not re.search(weights.MAYBE, marks) and node.tag != "body")
        if node.tag in ("script", "style", "like") or (drop_unlikely and unlikely):
            node.cut()
    elements = [n for n in root.walk() if n.kind == "e"]
    for node in [n for n in elements if n.tag == "div"]:
        if not any(re.search(weights.BLOCK_PREFIX, n.tag) for c in node.children for n in c.walk() if n.kind == "e"):
            node.renamed = True
    for node in elements:
        node.tag = "p" if getattr(node, "renamed", False) else node.tag
    for node in elements:
        if node.tag in ("p", "td") and len(node.text) >= 25:
            points = 1 + fields(node.text) + min(len(node.text) // 100, 3)
            for receiver, share in ((node.parent, points), (node.parent.parent, points / 2)):
                if receiver is not None and receiver.kind == "e":
                    if receiver.score is None:
                        receiver.score = receiver.weight + {"div": 5, "blockquote": 3, "form": -3, "th": -5}.get(receiver.tag, 0)
                    receiver.score += share
    candidates = [n for n in elements if n.score is not None]
    for node in candidates:
        node.score *= 1 - node.density
    best = max(candidates, key=lambda n: (n.score, -n.id)) if candidates else next(n for n in elements if n.tag == "body")
    top = best.score or 0
    taken = []
    for s in [c for c in best.parent.children if c.kind == "e"]:
        good = s is best or (s.score is not None and s.score >= max(10, 0.2 * top))
        if s.tag == "p":
            n, d = len(s.text), s.density
            good |= n > 80 and d is not None and d < 0.25
            good |= n < 80 and d == 0 and bool(re.search(r"\.( |$)", s.text, re.M))
        if good:
            s.tag = s.tag if s.tag in ("div", "p") else "div"
            taken.append(s)
    out = Node([-1, None, None, None, "e", "out", None, None, None, None])
    for s in taken:
        s.parent = out
    out.children = taken
    doomed = [h for h in out.below("h1", "h2", "h3", "h4", "h5", "h6") if h.weight < 0 or (h.density or 0) > 0.33]
    for h in doomed + out.below("form", "object", "iframe", "embed"):
        if h in h.parent.children:
            h.cut()
    for p in out.below("p"):
        if not p.text.strip(" \t\n\r\f\v") and p in p.parent.children:
            p.cut()
    for el in out.below("table", "ul", "div"):
        if el.weight + (el.score or 0) < 0:
            el.cut()
        elif el.text.count(",") < 10:
            count = {t: len(el.below(t)) for t in ("p", "img", "li", "input")}
            length, d = len(el.text.strip(" \t\n\r\f\v")), el.density or 0
            if (count["img"] > count["p"] or (count["li"] - 100 > count["p"] and el.tag != "ul")
                    or count["input"] > count["p"] // 3
                    or (length < 25 and (count["img"] == 0 or count["img"] > 2))
                    or (el.weight < 25 and d > 0.2) or (el.weight >= 25 and d > 0.5)):
                el.cut()
    return out.text


def article(html):
    text = one_pass(html, True)
    if len(text.strip(" \t\n\r\f\v")) < 250:
        text = one_pass(html, False)
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        text = text.replace(plain, coded)
    text = re.sub("[\t ]+", " ", re.sub(r"[\r\n\f]+", "", text)).replace("&nbsp;", " ")
    return text
