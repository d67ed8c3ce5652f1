"""Publish dates on pages.

A date never spans a tag, so matching is done once per text or tag that holds a digit, not
once per enclosing element. A match then counts for those enclosing elements in which it is
the first of its pattern. Rows are few after the digit test; only they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates
from .nodes import with_nodes

# Fixed value: the text reported for a page without any date.
NO_DATE = "Day, Month, Hour"


def date_candidates(pages: DataFrame, as_of: Column, keys: tuple[str, ...] = ("page_id",),
                    html: str = "html", patterns: list[tuple[str, str]] | None = None,
                    strict: bool = False) -> DataFrame:
    """(keys, tag_ord, node_id, ord, name, text, date, weight), unique by date and weight."""
    tags = [t for t, _ in dates.DATE_TAGS]

    def holders(n: Column) -> Column:
        chain = F.when(n["kind"] == "e", F.array_append(n["path"], n["node_id"])).otherwise(n["path"])
        elements = F.transform(chain, lambda i: F.struct(
            F.element_at(F.col("nodes"), i)["tag"].alias("tag"), i.alias("id")))
        return F.filter(elements, lambda e: e["tag"].isin(*tags))

    pieces = F.transform(
        F.filter("nodes", lambda n: n["raw"].isNotNull()),
        lambda n: F.struct(n["node_id"].alias("piece_id"), n["raw"].alias("raw"), holders(n).alias("holders")))
    parsed = pages if "nodes" in pages.columns else with_nodes(pages.select(*keys, html), html, extra=("raw", "path"), path_tags=tuple(tags))
    found = (parsed.select(*keys, F.explode_outer(pieces).alias("p"))
             .filter(F.size("p.holders") > 0)
             .withColumn("raw", F.regexp_replace("p.raw", "&#160;|&#xA0;|\u00a0", "&nbsp;"))
             .select(*keys, "p.piece_id", "p.holders",
                     F.explode_outer(dates.date_matches("raw", patterns)).alias("m"))
             .filter("m is not null"))
    previous = F.lag("piece_id").over(Window.partitionBy(*keys, "m.ord").orderBy("piece_id"))
    read = dates.parse_matched("name", "text") if strict else dates.parse_date_text("text")
    ranked = (found.withColumn("_prev", previous)
              .select(*keys, "m.*", "_prev", F.explode("holders").alias("h"))
              .filter(F.col("_prev").isNull() | (F.col("h.id") > F.col("_prev")))
              .select(*keys, dates.tag_order("h.tag").alias("tag_ord"), F.col("h.id").alias("node_id"),
                      "ord", "name", "text", dates.clamp_date(read, as_of).alias("date"),
                      dates.tag_weight("h.tag").alias("weight")))
    place = F.struct("tag_ord", "node_id", "ord", "name", "text")
    return (ranked.groupBy(*keys, "date", "weight").agg(F.min(place).alias("_p"))
            .select(*keys, "_p.*", "date", "weight"))


def first_date(candidates: DataFrame, as_of: Column, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The first candidate, not counting a namespace date in front, then dates of today.

    One candidate is always left.
    """
    listed = F.sort_array(F.collect_list(F.struct("tag_ord", "node_id", "ord", "date")))
    size = F.size("_c")
    namespace = (size > 1) & (F.col("_c")[0]["date"] == F.lit(dates.NAMESPACE_DATE).cast("timestamp_ntz"))
    rest = F.when(namespace, F.slice("_c", F.lit(2), size)).otherwise(F.col("_c"))
    today = as_of.cast("date")
    older = F.filter("_rest", lambda c: c["date"].cast("date") != today)
    return (candidates.groupBy(*keys).agg(listed.alias("_c"))
            .withColumn("_rest", rest)
            .select(*keys, F.coalesce(F.get(older, F.lit(0))["date"],
                                      F.element_at("_rest", -1)["date"]).alias("date")))


def publish_date(pages: DataFrame, as_of: Column, keys: tuple[str, ...] = ("page_id",),
                 url: str = "url", html: str = "html",
                 patterns: list[tuple[str, str]] | None = None, strict: bool = False) -> DataFrame:
    """(keys, published, published_text). A date in the URL wins over the page."""
    from_url = F.when(dates.url_date_text(url).isNotNull(),
                      dates.clamp_date(dates.url_date(url), as_of))
    listed = pages.select(*keys, from_url.alias("_url_date"))
    undated = pages.filter(dates.url_date_text(url).isNull())
    on_page = first_date(date_candidates(undated, as_of, keys, html, patterns, strict), as_of, keys)
    out = listed.join(on_page, list(keys), "left")
    published = F.coalesce("_url_date", "date")
    return out.select(*keys, published.alias("published"),
                      F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit(NO_DATE)).alias("published_text"))
