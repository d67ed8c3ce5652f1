"""Merging of extraction results and choice among extractors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank

# Fixed value: content types the html extractors take.
CONTENT_TYPES = r"^(text/(html|xml)|application/(xhtml\+xml|xml|atom\+xml))"

Extractor = Callable[[DataFrame], DataFrame]


class Registry:
    """Extractors by name; all are gated by content type."""

    def __init__(self):
        self._by_name: dict[str, Extractor] = {}

    def register(self, name: str):
        def add(function: Extractor) -> Extractor:
            self._by_name[name] = function
            return function
        return add

    def names(self) -> list[str]:
        return list(self._by_name)

    def run(self, name: str, pages: DataFrame, content_type: str = "content_type") -> DataFrame:
        gated = pages.filter(can_do(content_type)) if content_type in pages.columns else pages
        return self._by_name[name](gated)


def can_do(content_type: Column | str) -> Column:
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    return F.coalesce(c.rlike(CONTENT_TYPES), F.lit(False))


def is_fetched(title: Column | str = "title", content: Column | str = "content") -> Column:
    return ~is_blank(title) & ~is_blank(content)


def split_complete(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that need no extraction, and the rest."""
    return df.filter(is_fetched()), df.filter(~is_fetched())


def merge_attributes(seed: dict[str, Column], extracted: dict[str, Column], prefer: str = "extracted") -> dict[str, Column]:
    """One value per name; the preferred side wins where it has one."""
    first, second = (extracted, seed) if prefer == "extracted" else (seed, extracted)
    names = list(dict.fromkeys([*seed, *extracted]))
    return {n: F.coalesce(*[side[n] for side in (first, second) if n in side]) for n in names}


def merge_extras(seed: Column, extracted: Column, prefer: str = "extracted") -> Column:
    """The same for the map of config-named fields."""
    low, high = (seed, extracted) if prefer == "extracted" else (extracted, seed)
    kept = F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k))
    return F.map_concat(kept, high)


def first_complete(tries: list[DataFrame], keys: tuple[str, ...] = ("page_id",), sticky: bool = False) -> DataFrame:
    """The first complete result of several extractors, given in order of preference.

    ``sticky`` keeps fields of incomplete tries where a later one lacks them.
    """
    rows = None
    for place, frame in enumerate(tries):
        ranked = frame.withColumn("_place", F.lit(place))
        rows = ranked if rows is None else rows.unionByName(ranked, allowMissingColumns=True)
    fields = [c for c in rows.columns if c not in (*keys, "_place")]
    if sticky:
        return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_place"))).alias(c) for c in fields])
    return (rows.filter(is_fetched()).groupBy(*keys)
            .agg(F.min_by(F.struct(*fields), "_place").alias("_r")).select(*keys, "_r.*"))
