"""Weights of elements, from their tag and their class and id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col

# Words in class and id that speak against or for an element.
UNLIKELY = ("(?i)combx|comment|disqus|foot|header|menu|meta|nav|rss|shoutbox|sidebar|sponsor|like|fb"
            "|update|newprefooter|cright|upcheck|footer")
MAYBE = ("(?i)testo_articolo_dimensione|and|article|body|column|main|articolo|testoNotizia|fAbs|data"
         "|datetime")
POSITIVE = ("(?i)articolo|testo_articolo_dimensione|contenuto|article|body|content|entry|hentry|page"
            "|pagination|post|text|data|datetime")
NEGATIVE = ("(?i)combx|comment|contact|foot|footer|footnote|link|media|meta|promo|related|scroll"
            "|shoutbox|sponsor|tags|widget|upcheck")

# Tags whose start inside a div keeps it a div; matched as prefixes.
BLOCK_PREFIX = "^(?:a|blockquote|dl|img|div|ol|p|pre|table|ul)"

# Points by tag.
TAG_POINTS = {"div": 5, "blockquote": 3, "form": -3, "th": -5}

# Fixed value: points for one matching class or id.
MATCH_POINTS = 25


def _signed(value: Column) -> Column:
    text = F.coalesce(value, F.lit(""))
    minus = F.when(text.rlike(NEGATIVE), -MATCH_POINTS).otherwise(0)
    plus = F.when(text.rlike(POSITIVE), MATCH_POINTS).otherwise(0)
    return minus + plus


def class_weight(cls: Column | str, id_attr: Column | str) -> Column:
    return _signed(_col(cls)) + _signed(_col(id_attr))


def tag_points(tag: Column | str) -> Column:
    out = None
    for name, value in TAG_POINTS.items():
        hit = _col(tag) == name
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(0)


def node_base_score(tag: Column | str, cls: Column | str, id_attr: Column | str) -> Column:
    return (class_weight(cls, id_attr) + tag_points(tag)).cast("double")


def is_unlikely(tag: Column | str, cls: Column | str, id_attr: Column | str) -> Column:
    marks = F.concat(F.coalesce(_col(cls), F.lit("")), F.coalesce(_col(id_attr), F.lit("")))
    return marks.rlike(UNLIKELY) & ~marks.rlike(MAYBE) & (_col(tag) != "body")
