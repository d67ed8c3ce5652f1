"""Crawl planning: who is searched for what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import in_tasks
from .url_filters import valid_documents


def not_expired(df: DataFrame, as_of: Column) -> DataFrame:
    return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def select_scrapes(scrapes: DataFrame, as_of: Column, profiles: DataFrame | None = None,
                   ignore_profiles: DataFrame | None = None, scrape_ids: DataFrame | None = None) -> DataFrame:
    """Scrapes of the named profiles, or else all that are not expired."""
    out = (not_expired(scrapes, as_of) if profiles is None
           else scrapes.join(profiles.select("profile_id"), "profile_id", "left_semi"))
    if ignore_profiles is not None:
        out = out.join(ignore_profiles.select("profile_id"), "profile_id", "left_anti")
    if scrape_ids is not None:
        out = out.join(scrape_ids.select("scrape_id"), "scrape_id", "left_semi")
    return out


def keyword_fallback(own: Column, inherited: Column) -> Column:
    return F.when(F.size(own) > 0, own).otherwise(inherited)


def search_tasks(scrapes: DataFrame, profiles: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per scrape and keyword, with both parents of the scrape."""
    p = profiles.select("profile_id", F.col("title").alias("profile_title"), F.col("keywords").alias("_inherited"))
    s = sources.select("source_id", F.col("url").alias("source_url"))
    words = keyword_fallback(F.col("keywords"), F.col("_inherited"))
    return (scrapes.join(p, "profile_id").join(s, "source_id")
            .select("scrape_id", "profile_id", "profile_title", "source_id", "source_url",
                    F.explode(words).alias("keyword")))


def result_queue(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Search results, unique per scrape and keyword, with what they inherit from the task.

    Across keywords repeats are kept: the queue is the union of all result lists. Results are counted, and
    shuffled once, by scrape and keyword, into as many tasks as that number asks for.
    """
    keys = ["scrape_id", "keyword"]
    unique = in_tasks(results.dropna(how="all", subset=["url"]), *keys).dropDuplicates([*keys, "url"])
    queue = (unique.join(tasks, keys)
             .withColumns({"referring_uri": F.col("source_url"), "referring_source_id": F.col("source_id")})
             .drop("source_url", "source_id", "profile_title"))
    return valid_documents(queue)


def plan_crawl(scrapes: DataFrame, profiles: DataFrame, sources: DataFrame, as_of: Column, **chosen) -> DataFrame:
    return search_tasks(select_scrapes(scrapes, as_of, **chosen), profiles, sources)


def due(scrapes: DataFrame, now: Column) -> DataFrame:
    """Scrapes whose time has come; those without a time are always due."""
    return scrapes.filter(F.col("due_at").isNull() | (F.col("due_at") <= now))


def advanced(done: DataFrame, now: Column) -> DataFrame:
    """Scrapes that were done, due again after their own interval."""
    return done.withColumn("due_at", (now + F.expr("make_dt_interval(every_days)")).cast("timestamp_ntz"))
