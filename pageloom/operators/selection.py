"""Selectors over the nodes of one page, in one preorder pass.

Steps are joined by "somewhere below", so all that a node must know of what encloses it is how many
steps that has met: one number a node, handed down from parent to child. Cost is the nodes times the
alternatives, however deep the page.
"""

from __future__ import annotations

import re

_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def meets(step: dict, tag: str, classes: str | None, id_attr: str | None, attrs: list[tuple[str, str]] | None) -> bool:
    if step["tag"] and tag != step["tag"] or step["id"] and id_attr != step["id"]:
        return False
    if step["classes"] and not set(step["classes"]) <= set(_BLANKS.split(classes or "")):
        return False
    if not step["attr"]:
        return True
    value = dict(attrs or ()).get(step["attr"])
    return value is not None and step["value"] in ("", value)


def select(steps: list[dict], parents: list[int], tags: list[str | None], classes: list, ids: list, attrs: list) -> list[int]:
    """Ids of the nodes that the steps select, in document order. A node's id is its place from 1; 0 is the document; ``tags`` is null but for elements."""
    if not steps:
        return []
    last, met, found = len(steps) - 1, [0] * (len(parents) + 1), []
    for i, tag in enumerate(tags):
        if tag is None:
            continue
        so_far = met[parents[i]]
        if meets(steps[so_far], tag, classes[i], ids[i], attrs[i]):
            if so_far == last:
                found.append(i + 1)
            else:
                so_far += 1
        met[i + 1] = so_far
    return found


def select_any(alternatives: list[list[dict]], *nodes: list) -> list[int]:
    """Nodes of any alternative, each once, in document order."""
    if len(alternatives) == 1:
        return select(alternatives[0], *nodes)
    return sorted({i for steps in alternatives for i in select(steps, *nodes)})
