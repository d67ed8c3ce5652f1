"""Upserts of sources, pages, comments, tags and ratings.

Each function takes the stored table and new rows and returns the next version of the table.
Ids are computed from keys, so running an upsert twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, lang, ratings, text, urls
from ..session import stored as write_once
from .keyed_table import TableVersions
from .url_filters import first_by

# Fixed value: status of a page in a language its profile does not want.
REJECTED = 50


def new_sources(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Hosts seen for the first time, one row each."""
    hosts = docs.select(urls.host_url("url").alias("url")).filter("url is not null").distinct()
    return (hosts.join(sources.select("url"), "url", "left_anti")
            .select(urls.key_id("url").alias("source_id"), "url", F.lit(None).cast("string").alias("lang"),
                    F.lit(None).cast("bigint").alias("category_id")))


def upsert_sources(sources: DataFrame, docs: DataFrame) -> DataFrame:
    columns = ["source_id", "url", "lang", "category_id"]
    return sources.select(columns).unionByName(new_sources(sources, docs).select(columns))


def url_set_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("url").union(b.select("url")).distinct()


def first_page_of_host(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """The page that creates its source: the first of its host in the run."""
    return first_by(pages.withColumn("source_url", urls.host_url("url")).filter("source_url is not null"),
                    ["source_url"], order)


def language_gate(page_lang: Column, languages: Column) -> Column:
    """50 for a page in a language the profile did not ask for."""
    unwanted = (F.size(languages) > 0) & page_lang.isNotNull() & ~F.array_contains(languages, page_lang)
    return F.when(unwanted, F.lit(REJECTED))


def page_dates(as_of: Column) -> dict[str, Column]:
    found = F.coalesce(F.col("published"), dates.parse_date_text("content"))
    published = dates.clamp_date(found, as_of)
    return {"published": published,
            "updated": dates.updated_or_published(F.col("updated"), published)}


def incoming_pages(docs: DataFrame, sources: DataFrame, profiles: DataFrame, as_of: Column, order: str = "ord") -> DataFrame:
    """(url, _fresh, _rating, _tags): what new rows say about each URL, stored once.

    Of several rows with one URL the first gives the attributes and the last rating given wins; they are
    folded by an aggregate before anything is joined.
    """
    attributes = ["title", "content", "author", "links", "profile_id", "referring_source_id", "etag",
                  "raw", "published", "updated", "lang"]
    incoming = (docs.filter(urls.is_http("url"))
                .groupBy("url")
                .agg(F.min_by(F.struct(*attributes), order).alias("_new"),
                     F.max_by("evaluation", F.when(F.col("evaluation").isNotNull(), F.col(order))).alias("_rating"),
                     F.array_join(F.sort_array(F.collect_set("tags")), ",").alias("_tags")))
    return write_once(
        incoming.select("url", "_new.*", "_rating", "_tags")
        .withColumns(page_dates(as_of))
        .withColumn("_host", urls.host_url("url"))
        .join(sources.select(F.col("url").alias("_host"), "source_id", F.col("lang").alias("_source_lang")), "_host")
        .join(profiles.select("profile_id", "languages"), "profile_id")
        .withColumn("lang", lang.index_lang("_source_lang", "lang"))
        .select("url", F.struct(
            text.strip_all("title").alias("title"), text.strip_all("content").alias("content"), "author",
            ratings.external_links("links", "_host").alias("links"), "source_id", "profile_id",
            "referring_source_id", "etag", "raw", "published", "updated", "lang",
            language_gate(F.col("lang"), F.col("languages")).alias("status")).alias("_fresh"),
            "_rating", "_tags"), "fresh", compression="zstd")


def _rating(old: Column) -> Column:
    return F.coalesce(ratings.parse_evaluation("_rating"), old)


def _tags(old: Column) -> Column:
    given = F.coalesce(F.col("_tags"), F.lit("")) != ""
    return F.when(given, ratings.tag_union(old, "_tags")).otherwise(old)


def marked_pages(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known pages whose rating or tags the new rows change; they keep all other attributes."""
    marks = fresh.filter("_rating IS NOT NULL OR coalesce(_tags, '') <> ''").select("url", "_rating", "_tags")
    both = known.join(marks, "url").withColumns({"_e": _rating(F.col("evaluation")), "_t": _tags(F.col("cached_tag_list"))})
    changed = both.filter("NOT (_e <=> evaluation AND _t <=> cached_tag_list)")
    return changed.withColumns({"evaluation": F.col("_e"), "cached_tag_list": F.col("_t")}).select(*known.columns)


def added_pages(fresh: DataFrame, known_urls: DataFrame, columns: list[str]) -> DataFrame:
    """Pages that weren't there, with all attributes."""
    return fresh.join(known_urls.select("url"), "url", "left_anti").select(
        "url", "_fresh.*", _rating(F.lit(None).cast("bigint")).alias("evaluation"),
        _tags(F.lit(None).cast("string")).alias("cached_tag_list")).select(*columns)


def upsert_pages(index: DataFrame, docs: DataFrame, sources: DataFrame, profiles: DataFrame,
                 as_of: Column, order: str = "ord") -> DataFrame:
    """Next version of a page index that is one frame.

    A new page gets all attributes, a known one keeps its own; rating and tags follow the new rows in either
    case. An index that grows batch by batch is better kept by ``upsert_index``, which doesn't write it all anew.
    """
    fresh = incoming_pages(docs, sources, profiles, as_of, order)
    marked = marked_pages(index, fresh)
    rest = index.join(marked.select("url"), "url", "left_anti")
    return rest.select(*index.columns).unionByName(marked).unionByName(added_pages(fresh, index, index.columns))


def index_changes(index: TableVersions, batch_id: int, docs: DataFrame, sources: DataFrame, profiles: DataFrame,
                  as_of: Column, order: str = "ord") -> DataFrame:
    """The same upsert on a table in buckets, as the rows that it adds or changes.

    The table is read in the buckets that the new rows fall in: its urls, and whole rows where a mark may change one.
    """
    fresh = incoming_pages(docs, sources, profiles, as_of, order)
    marks = fresh.filter("_rating IS NOT NULL OR coalesce(_tags, '') <> ''")
    changed = marked_pages(index.rows_before(batch_id, marks), marks)
    return changed.unionByName(added_pages(fresh, index.keys_before(batch_id, fresh), changed.columns))


def index_batch(tables: dict[str, TableVersions], batch_id: int, docs: DataFrame, profiles: DataFrame, as_of: Column,
                comments: DataFrame | None = None) -> None:
    """One batch of documents, and of comments, into tables of sources, pages and comments.

    Each table is read in the buckets of what comes in, and only what is new or changed is written. The
    comments table has a ``comment_id`` and buckets by ``page_url``: see ``comment_rows``.
    """
    sources, pages = tables["sources"], tables["pages"]
    hosts = docs.select(urls.host_url("url").alias("url")).filter("url IS NOT NULL").distinct()
    sources.add(batch_id, new_sources(sources.keys_before(batch_id, hosts), docs))
    own = sources.rows_before(batch_id + 1, hosts)
    changes = index_changes(pages, batch_id, docs, own, profiles, as_of)
    if comments is not None:
        given = comment_rows(comments, as_of)
        known = tables["comments"].keys_before(batch_id, given)
        fresh = write_once(given.join(known, tables["comments"].key, "left_anti"), "comments")
        tables["comments"].add(batch_id, fresh)
        changes = write_once(changes, "changes")
        talked = fresh.select(F.col("page_url").alias("url")).distinct()
        others = pages.rows_before(batch_id, talked).join(changes.select("url"), "url", "left_anti")
        earlier = tables["comments"].rows_before(batch_id, fresh, on=["page_url"])
        changes = date_by_comments(changes.unionByName(others), earlier, fresh)
    pages.add(batch_id, changes)


def comment_rows(comments: DataFrame, as_of: Column, order: str = "ord") -> DataFrame:
    """Comments as a table keeps them: one per page and content, the first of equal ones, with an id made of both."""
    nothing = comments.sparkSession.createDataFrame([], "page_url string, content string")
    return new_comments(nothing, comments, as_of, order).withColumn(
        "comment_id", F.md5(F.concat("page_url", F.lit("\n"), F.coalesce(F.concat(F.lit("="), "content"), F.lit("")))))


def real_comments(comments: DataFrame) -> DataFrame:
    return comments.filter(~(text.is_blank("content") & text.is_blank("title")))


def new_comments(stored: DataFrame, comments: DataFrame, as_of: Column, order: str = "ord") -> DataFrame:
    """Comments not stored yet, one per page and content; the first of equal ones counts."""
    columns = ["page_url", "author", "title", "content", "published"]
    read = dates.clamp_date(dates.parse_date_text("published"), as_of)
    once = first_by(real_comments(comments).select(*columns, order), ["page_url", "content"], order)
    known = stored.select("page_url", "content")
    same = (F.col("n.page_url") == F.col("k.page_url")) & F.col("n.content").eqNullSafe(F.col("k.content"))
    return (once.alias("n").join(known.alias("k"), same, "left_anti")
            .select("page_url", "author", "title", "content", read.alias("published")))


def upsert_comments(stored: DataFrame, comments: DataFrame, as_of: Column, order: str = "ord") -> DataFrame:
    return stored.unionByName(new_comments(stored, comments, as_of, order))


def date_by_comments(index: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pages with a new comment take the date of their newest comment."""
    newest = (stored.select("page_url", "published", F.lit(False).alias("is_new"))
              .unionByName(fresh.select("page_url", "published", F.lit(True).alias("is_new")))
              .groupBy("page_url").agg(F.max("published").alias("_newest"), F.bool_or("is_new").alias("_any_new")))
    moved = F.when(F.col("_any_new"), F.coalesce("_newest", "published")).otherwise(F.col("published"))
    return (index.join(newest.withColumnRenamed("page_url", "url"), "url", "left")
            .withColumn("published", moved).select(*index.columns))


def failed_keys(failed: DataFrame) -> DataFrame:
    """(md5 of url, profile) of failed fetches, each once."""
    return (failed.filter(~text.is_blank("url") & F.col("profile_id").isNotNull())
            .select(urls.hashed_uri("url").alias("hashed_name"), "profile_id").distinct())


def upsert_blacklist(blacklist: DataFrame, failed: DataFrame) -> DataFrame:
    return blacklist.unionByName(failed_keys(failed).join(blacklist, ["hashed_name", "profile_id"], "left_anti"))


def served_since(index: DataFrame, sources: DataFrame, categories: DataFrame, since: Column, limit: int | None = None) -> DataFrame:
    """(url, published, cat_name) of the pages served: not held back, published after ``since``; newest first with a limit."""
    out = served_pages(index.filter((F.col("status") != 50) & (F.col("published") > since)), sources, categories).select(
        "url", "published", "cat_name")
    return out if limit is None else out.orderBy(F.desc("published"), "url").limit(limit)


def served_pages(index: DataFrame, sources: DataFrame, categories: DataFrame) -> DataFrame:
    """Pages with the category of their source."""
    return (index.join(sources.select("source_id", "category_id"), "source_id")
            .join(categories.select("category_id", F.col("name").alias("cat_name")), "category_id"))


def retained(df: DataFrame, as_of: Column, days: int = 60, ts: str = "published") -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.expr(f"interval {int(days)} days"))
