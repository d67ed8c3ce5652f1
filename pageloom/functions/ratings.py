"""Ratings, tags and link lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col, is_blank


def parse_evaluation(value: Column | str, missing_base: int | None = 5) -> Column:
    """``"v-base"`` to whole stars out of five; null when it cannot be told."""
    fields = F.split(F.rtrim(_col(value), F.lit("-")), "-", -1)
    score = F.regexp_extract(F.regexp_replace(F.get(fields, F.lit(0)), r"\W", "."),
                             r"^\s*(\d+(?:\.\d+)?)", 1)
    points = F.coalesce(score.try_cast("double"), F.lit(0.0))
    base_text = F.get(fields, F.lit(1))
    given = F.coalesce(F.regexp_extract(base_text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
    base = F.when(base_text.isNull(), F.lit(missing_base).cast("bigint")).otherwise(given)
    usable = ~is_blank(value) & (base != 0)
    return F.when(usable, F.floor(F.try_divide(points * 5, base)).cast("bigint"))


def changed(old: Column | str, new: Column | str) -> Column:
    """``new`` where it differs from ``old``, else null."""
    return F.when(~_col(new).eqNullSafe(_col(old)), _col(new))


def tag_array(tags: Column | str) -> Column:
    """Trimmed, lower-case, sorted tags; repeats kept."""
    fields = F.split(F.rtrim(_col(tags), F.lit(",")), ",", -1)
    return F.array_sort(F.transform(fields, lambda t: F.lower(F.trim(t))))


def tags_normalise(tags: Column | str) -> Column:
    return F.array_join(tag_array(tags), ", ")


def tag_union(old: Column | str, new: Column | str) -> Column:
    """Old tags, then new ones not yet there; unchanged when nothing differs."""
    before = F.coalesce(_col(old), F.lit(""))
    normal = tags_normalise(new)
    kept = F.filter(F.split(before, ", ", -1), lambda t: t != "")
    merged = F.array_join(F.array_union(kept, F.split(normal, ", ", -1)), ",")
    return F.when(_col(new).isNull() | (normal == before), _col(old)).otherwise(merged)


def external_links(links: Column | str, source_url: Column | str) -> Column:
    source = _col(source_url)
    return F.filter(_col(links), lambda link: ~F.contains(link, source))
