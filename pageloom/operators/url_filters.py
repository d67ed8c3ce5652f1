"""The URL filter chain: every member maps a frame with ``url`` to a smaller one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls

Member = Callable[[DataFrame], DataFrame]


def valid_documents(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL parses and is http or https."""
    return df.filter(urls.is_http(url))


scheme_filter_http = valid_documents


def fix_relative_uri(df: DataFrame, url: str = "url", referrer: str = "referring_uri") -> DataFrame:
    return df.withColumn(url, urls.resolve(url, referrer)) if referrer in df.columns else df


def normalize_uri(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn(url, urls.normalize(url))


def hostname_filter(include_hosts: DataFrame | None, url: str = "url") -> Member:
    """Keep URLs of the given hosts (a frame with ``host``); None keeps all."""
    def apply(df: DataFrame) -> DataFrame:
        if include_hosts is None:
            return df
        wanted = include_hosts.select(F.col("host").alias("_host")).distinct()
        return df.join(wanted, F.lower(urls.host(url)) == F.lower("_host"), "left_semi")
    return apply


def _any_of(patterns: list[str], url: str) -> Column:
    return F.col(url).rlike("|".join(f"(?:{p})" for p in patterns))


def url_inclusion_filter(patterns: list[str] | None, url: str = "url") -> Member:
    return lambda df: df if patterns is None else df.filter(_any_of(patterns, url))


def url_exclusion_filter(patterns: list[str] | None, url: str = "url") -> Member:
    return lambda df: df if patterns is None else df.filter(~_any_of(patterns, url))


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by ``order``. An aggregate, not a rank: copies of a hot key are
    folded on the map side, so no task ever holds them all."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
            .select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns]))


def visited_url_filter(history: DataFrame | None, order: str, url: str = "url") -> Member:
    """Keep the first of each URL in the batch, and none that history knows."""
    def apply(df: DataFrame) -> DataFrame:
        fresh = first_by(df, [url], order)
        if history is None:
            return fresh
        return fresh.join(history.select(url), url, "left_anti")
    return apply


def filter_chain(df: DataFrame, members: list[Member]) -> DataFrame:
    return reduce(DataFrame.transform, members, df)


def http_chain(order: str, include_hosts: DataFrame | None = None, include: list[str] | None = None,
               exclude: list[str] | None = None, history: DataFrame | None = None) -> list[Member]:
    """The http chain. Relative links are resolved before the scheme is tested, or they
    could never pass it; cheap row filters come first, the one shuffle last."""
    return [fix_relative_uri, scheme_filter_http, normalize_uri, hostname_filter(include_hosts),
            url_inclusion_filter(include), url_exclusion_filter(exclude),
            visited_url_filter(history, order)]


def explain_drops(df: DataFrame, include: list[str] | None = None,
                  exclude: list[str] | None = None, url: str = "url") -> DataFrame:
    """All rows, with the name of the row-wise member that drops them in ``dropped_by``."""
    why = F.when(~urls.is_http(url), "scheme_filter_http")
    if include is not None:
        why = why.when(~_any_of(include, url), "url_inclusion_filter")
    if exclude is not None:
        why = why.when(_any_of(exclude, url), "url_exclusion_filter")
    return df.withColumn("dropped_by", why)


def blacklist_filter(df: DataFrame, blacklist: DataFrame, url: str = "url") -> DataFrame:
    """Skip URLs blacklisted for their profile."""
    keyed = df.withColumn("hashed_name", urls.hashed_uri(url))
    return keyed.join(blacklist, ["hashed_name", "profile_id"], "left_anti").drop("hashed_name")
