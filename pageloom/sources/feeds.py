"""Feeds: items and comments out of XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.dates import pub_date_format

# Generator -> field -> feed tag.
FEED_FIELDS = {
    "wordpress": {"title": "title", "author": "dc:creator", "content": "description", "url": "guid",
                  "published": "pubDate", "link": "link", "origlink": "feedburner:origLink"},
    "blogger": {"title": "title", "author": "author", "content": "content", "url": "link",
                "published": "published"},
    "typepad": {"title": "title", "author": "dc:creator", "content": "description", "url": "guid",
                "published": "pubDate"},
}
FIELDS = ("title", "author", "content", "url", "published", "link", "origlink")

_ITEM_TAGS = sorted({tag for fields in FEED_FIELDS.values() for tag in fields.values()})
# The link of an Atom entry is an attribute, and there may be several; the first counts.
_LINK = "array<struct<_VALUE:string,_href:string>>"
_ITEM = "struct<" + ",".join(f"`{t}`:{_LINK if t == 'link' else 'string'}" for t in _ITEM_TAGS) + ">"
_FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>"
_MEDIA = T.StructType([T.StructField("media:title", T.StringType()), T.StructField("media:description", T.StringType())])
RSS_ITEM = T.StructType([T.StructField("link", T.StringType()), T.StructField("pubDate", T.StringType()),
                         T.StructField("media:group", _MEDIA)])


def _rss_columns():
    return [F.col("link").alias("url"), F.col("`media:group`.`media:title`").alias("title"),
            F.col("`media:group`.`media:description`").alias("content"),
            pub_date_format("pubDate").alias("published")]


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """``item`` elements of feed files, each file one feed."""
    return spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path).select(*_rss_columns())


def rss_items_of(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """The same from a column holding one feed per row."""
    feed = T.StructType([T.StructField("channel", T.StructType([T.StructField("item", T.ArrayType(RSS_ITEM))]))])
    keys = [c for c in feeds.columns if c != xml]
    return (feeds.select(*keys, F.from_xml(F.col(xml), feed.simpleString().replace("media:group", "`media:group`")
                                           .replace("media:title", "`media:title`").replace("media:description", "`media:description`")).alias("f"))
            .select(*keys, F.explode("f.channel.item").alias("i")).select(*keys, "i.*").select(*keys, *_rss_columns()))


def feed_comments(feeds: DataFrame, xml: str = "xml", generator: str = "generator") -> DataFrame:
    """One row per comment, fields named alike whatever program made the feed."""
    keys = [c for c in feeds.columns if c not in (xml, generator)]
    items = F.coalesce("f.channel.item", "f.item", "f.entry")
    rows = (feeds.select(*keys, generator, F.from_xml(F.col(xml), _FEED).alias("f"))
            .select(*keys, generator, F.explode(items).alias("i")))
    link = F.get("i.link", F.lit(0))
    value = {t: F.col(f"i.`{t}`") for t in _ITEM_TAGS} | {"link": F.coalesce(link["_VALUE"], link["_href"])}
    tag_value = F.create_map(*[x for t in _ITEM_TAGS for x in (F.lit(t), value[t])])
    names = F.create_map(*[x for g, m in FEED_FIELDS.items() for x in (
        F.lit(g), F.create_map(*[y for k, v in m.items() for y in (F.lit(k), F.lit(v))]))])
    mine = F.try_element_at(names, F.col(generator))
    return rows.select(*keys, generator, *[
        F.try_element_at(tag_value, F.try_element_at(mine, F.lit(f))).alias(f) for f in FIELDS])
