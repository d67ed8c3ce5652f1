"""Field extraction by per-site rules.

A page is one row with its ``nodes`` array and the rules of its host, so rules are evaluated where the
page lies, by the function that parses it: in one pass over its nodes for each alternative. Selectors may use tag, ``.class``, ``#id``, ``[attr=value]``, the
descendant blank and the comma.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..functions.text import escape_markup, strip_all, strip_ws, unescape_href
from .nodes import with_nodes

CallableRule = Callable[[DataFrame], DataFrame]


def _step(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\[[^\]]*\]", "")

    def pick(pattern: str, group: int, of: Column = text) -> Column:
        return F.regexp_extract(of, pattern, group)
    return F.struct(
        F.lower(pick(r"^([A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"),
        pick(r"#([\w-]+)", 1, bare).alias("id"),
        F.regexp_extract_all(bare, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"),
        pick(r"\[@?([\w:-]+)", 1).alias("attr"),
        pick(r"\[@?[\w:-]+=['\"]?([^'\"\]]*)['\"]?\]", 1).alias("value"))


def compile_rules(site_rules: DataFrame) -> DataFrame:
    """One row per host: its rules, each a list of alternatives, each a list of steps.

    Rules of one host and field are one rule: the alternatives of their selectors, sorted as text.
    """
    merged = site_rules.groupBy("host_slug", "tag").agg(
        F.array_join(F.sort_array(F.collect_set("selector")), ",").alias("selector"))
    alternatives = F.transform(
        F.split("selector", ","),
        lambda alt: F.transform(F.split(F.trim(alt), r"\s+"), _step))
    return (merged.select("host_slug", F.struct(F.col("tag").alias("field"), alternatives.alias("alts")).alias("rule"))
            .groupBy("host_slug").agg(F.sort_array(F.collect_list("rule")).alias("rules")))


# A rule table of at most so many rules and characters is sent to all tasks; beyond, the pages of a host are dealt in so many parts.
FEW_RULES = 10_000
FEW_CHARACTERS = 1_000_000
HOST_PARTS = 32


def few_rules(site_rules: DataFrame) -> bool:
    """Is the rule table, which is counted, small enough for every task? Not known of a stream."""
    if site_rules.isStreaming:
        return False
    size = F.sum(F.length(F.concat_ws("", "host_slug", "tag", "selector")))
    counted = site_rules.agg(F.count("*").alias("rules"), F.coalesce(size, F.lit(0)).alias("characters")).first()
    return counted["rules"] <= FEW_RULES and counted["characters"] <= FEW_CHARACTERS


def with_rules(pages: DataFrame, site_rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``rules`` of the host, or else of the site's ``www`` host; null if there are none.

    Pages are never gathered by host, as one host may have most of them: they stay where they are if the rules are
    few, and else go by host and part, each rule to all parts of its host.
    """
    rules, part = compile_rules(site_rules), []
    if few_rules(site_rules):
        rules = F.broadcast(rules)
    elif not site_rules.isStreaming:
        rules, part = rules.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1)))), ["_part"]
    own = rules.withColumnsRenamed({"host_slug": "_slug", "rules": "_own"})
    www = rules.withColumnsRenamed({"host_slug": "_www", "rules": "_main"})
    return (pages.withColumns({"_slug": urls.host_slug(url), "_www": urls.host_slug_www(url)}
                              | {p: F.pmod(F.xxhash64(url), F.lit(HOST_PARTS)).cast("int") for p in part})
            .join(own, ["_slug", *part], "left").join(www, ["_www", *part], "left")
            .withColumn("rules", F.coalesce("_own", "_main"))
            .drop("_slug", "_www", "_own", "_main", *part))


def attributes_of(pages: DataFrame, selector: str, name: str, html: str = "html") -> DataFrame:
    """Add ``values``: one attribute of every node that a selector (without commas) selects, in document order."""
    steps = F.transform(F.split(F.lit(selector), r"\s+"), _step)
    nodes = F.col("nodes")
    return (with_nodes(pages, html, extra=("attrs",), rules=F.array(F.array(steps)))
            .withColumn("values", F.transform(F.col("found")[0], lambda i: F.try_element_at(F.element_at(nodes, i)["attrs"], F.lit(name))))
            .drop("nodes", "found"))


def subtree_text(nodes: Column, node: Column, with_scripts: bool = True) -> Column:
    """Text below a node; ids are positions, so this is a slice of the array."""
    part = F.slice(nodes, node["node_id"], node["end_id"] - node["node_id"] + 1)

    def wanted(n: Column) -> Column:
        keep = n["kind"] == "t"
        if with_scripts:
            return keep
        return keep & ~F.coalesce(F.try_element_at(nodes, n["parent_id"])["tag"].isin("script", "style"), F.lit(False))
    return F.array_join(F.transform(F.filter(part, wanted), lambda n: n["text"]), "")


def _first_tag(nodes: Column, tag: str) -> Column:
    hits = F.filter(nodes, lambda n: n["tag"] == tag)
    return F.transform(F.slice(hits, 1, 1), lambda n: F.struct(n["node_id"].alias("node_id"), n["end_id"].alias("end_id")))


def _clean_block(markup: Column) -> Column:
    return F.regexp_replace(markup, r"\s+", " ")


def _value(nodes: Column, field: Column, chosen: Column) -> Column:
    whole = escape_markup(F.array_join(F.transform(chosen, lambda n: subtree_text(nodes, n)), ""))
    visible = escape_markup(F.array_join(F.transform(chosen, lambda n: subtree_text(nodes, n, False)), ""))
    return (F.when(field == "title", _clean_block(visible))
            .when(field == "content", strip_ws(_clean_block(visible)))
            .otherwise(strip_all(whole)))


def rule_fields(pages: DataFrame, site_rules: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages whose host has rules, with a ``fields`` map of the rules' names.

    A selector without a match falls back to the title for ``title``, else to the body.
    Pages without rules are dropped before anything is parsed.
    """
    ruled = with_rules(pages.select("page_id", url), site_rules, url).filter("rules is not null").select("page_id", "rules")
    return fields_of(with_nodes(pages.join(ruled, "page_id"), html, extra=("attrs",), rules=F.transform("rules", lambda r: r["alts"])))


def fields_of(parsed: DataFrame) -> DataFrame:
    """The same for pages with ``rules``, ``nodes`` and what the rules ``found``."""
    nodes = F.col("nodes")

    def entry(rule: Column, i: Column) -> Column:
        ids = F.get("found", i)
        found = F.transform(ids, lambda n: F.struct(n.alias("node_id"), F.element_at(nodes, n)["end_id"].alias("end_id")))
        fallback = F.when(rule["field"] == "title", _first_tag(nodes, "title")).otherwise(_first_tag(nodes, "body"))
        # bound once, as an expression that stands twice in a lambda is worked out twice
        chosen = F.array(F.when(F.size(ids) > 0, found).otherwise(fallback))
        return F.struct(rule["field"].alias("key"), F.transform(chosen, lambda c: _value(nodes, rule["field"], c))[0].alias("value"))
    return (parsed.withColumn("fields", F.map_from_entries(F.transform("rules", entry)))
            .withColumn("links", links_of(nodes)).withColumn("generator", generator_of(nodes))
            .drop("rules", "nodes", "found"))


def links_of(nodes: Column) -> Column:
    """Link targets in document order, without those inside the page."""
    hrefs = F.transform(F.filter(nodes, lambda n: n["tag"] == "a"), lambda n: F.try_element_at(n["attrs"], F.lit("href")))
    return F.transform(F.filter(hrefs, lambda h: h.isNotNull() & ~h.startswith("#")), unescape_href)


def generator_of(nodes: Column) -> Column:
    """Content of the first ``meta`` named generator, lower case."""
    metas = F.filter(nodes, lambda n: (n["tag"] == "meta") & (F.try_element_at(n["attrs"], F.lit("name")) == "generator"))
    return F.lower(F.try_element_at(F.get(metas, F.lit(0))["attrs"], F.lit("content")))


def callable_fields(nodes: DataFrame, rules: dict[str, CallableRule], key: str = "page_id") -> DataFrame:
    """Rules given as functions from the node table to (key, value), as rows (key, field, value)."""
    frames = [rule(nodes).select(key, F.lit(name).alias("field"), "value") for name, rule in rules.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
