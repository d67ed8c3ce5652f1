"""Queries that run a stream over all data there is and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators.keyed_table import TableVersions
from ..plans import jobs
from ..schemas import PAGE_INDEX
from ..session import fresh_path
from ..sources.pages import PAGE_SCHEMA
from ..streaming import jobs as streams
from .page_queries import _ARTICLE, _LONG, _article_pages
from .registry import query
from .views import SRC, Tables, as_of, w

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(t: Tables):
    events = streams.file_stream(t.spark, t.folder, "events.parquet", EVENT_SCHEMA)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _pages(t: Tables):
    return streams.file_stream(t.spark, t.folder, "pages.parquet", PAGE_SCHEMA)


@query("t1_seen_hosts", "SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' AS host FROM pages")
def _(t: Tables):
    streams.state_on_disk(t.spark)
    return streams.run_available(streams.seen_hosts(_pages(t)), "hosts")


@query("t2_seen_urls", "SELECT DISTINCT user_id FROM events")
def _(t: Tables):
    return streams.run_available(streams.seen_urls(_events(t).select("user_id", "ts"), "user_id", "ts", "10 minutes").select("user_id"), "users")


def _in_files(t: Tables, frame, files: int, *keys: str):
    """The rows as a stream that takes a file a batch."""
    landing = fresh_path(t.spark, "landing")
    frame.repartition(files, *keys).write.parquet(landing)
    return t.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(landing)


@query("t1_hosts_over_batches", "SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' AS host FROM pages")
def _(t: Tables):
    """Hosts come again in every batch; the set lies on disk and goes on in a second run."""
    streams.state_on_disk(t.spark)
    stream, out, state = _in_files(t, t.pages, 4, "page_id"), fresh_path(t.spark, "hosts"), fresh_path(t.spark, "hosts-state")
    streams.run_available(streams.seen_hosts(stream), "hosts", state=state, out=out)
    return streams.run_available(streams.seen_hosts(stream), "hosts", state=state, out=out)


@query("t2_urls_over_batches", "SELECT user_id, count(*) AS times FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def _(t: Tables):
    """Keys come again in every batch, all within the delay: each is given out once."""
    stream = _in_files(t, t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), 4, "ts")
    found = streams.run_available(streams.seen_urls(stream, "user_id", "ts", "20000 days").select("user_id"), "users")
    return found.groupBy("user_id").agg(F.count("*").alias("times"))


@query("t3_stream_upsert", w(*SRC) + "SELECT 'page' AS kind, url AS key FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT DISTINCT 'source', regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' FROM pages WHERE page_id % 4 = 0 "
       "UNION ALL SELECT 'blacklist', md5(url) FROM pages WHERE page_id % 4 > 0")
def _(t: Tables):
    none = F.lit(None).cast("string")
    docs = _pages(t).select(
        "url", jobs.page_title("html").alias("title"), F.lit("text").alias("content"), none.alias("author"),
        F.array().cast("array<string>").alias("links"), F.expr("page_id % 25").alias("profile_id"), F.lit(1).cast("bigint").alias("referring_source_id"),
        none.alias("etag"), none.alias("raw"), as_of().alias("published"), as_of().alias("updated"), F.lit("en").alias("lang"),
        none.alias("evaluation"), none.alias("tags"), F.col("page_id").alias("ord"),
        F.when(F.expr("page_id % 4 = 0"), "success").otherwise("fail").alias("outcome"))
    spark = t.spark
    sources = TableVersions(spark, fresh_path(spark, "sources"), spark.createDataFrame([], "source_id bigint, url string, lang string, category_id bigint"), ("url",))
    index = TableVersions(spark, fresh_path(spark, "index"), spark.createDataFrame([], PAGE_INDEX), ("url",))
    blacklist = TableVersions(spark, fresh_path(spark, "blacklist"), spark.createDataFrame([], "hashed_name string, profile_id bigint"), ("hashed_name", "profile_id"))
    step = streams.page_upserts(sources, index, blacklist, t.profiles(), as_of())
    streams.run_batches(docs, "upsert", step).awaitTermination()
    return (index.latest().select(F.lit("page").alias("kind"), F.col("url").alias("key"))
            .unionByName(sources.latest().select(F.lit("source").alias("kind"), F.col("url").alias("key")))
            .unionByName(blacklist.latest().select(F.lit("blacklist").alias("kind"), F.col("hashed_name").alias("key"))))


@query("t4_repeat_loop", "SELECT page_id FROM pages")
def _(t: Tables):
    """The loop run twice with one state, by new objects: the second run finds nothing to add."""
    out, state = fresh_path(t.spark, "loop"), fresh_path(t.spark, "loop-state")
    for _ in range(2):
        step = streams.extraction_step(lambda b: b.select("page_id"), out)
        streams.run_batches(_pages(t), "loop", step, state=state).awaitTermination()
    return t.spark.read.schema("page_id bigint, batch_id int").parquet(out).select("page_id")


@query("t5_running_page_date", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY user_id")
def _(t: Tables):
    versions = TableVersions(t.spark, fresh_path(t.spark, "newest"), t.spark.createDataFrame([], "user_id bigint, newest timestamp"), ("user_id",))

    def each(batch, batch_id):
        merged = versions.rows_before(batch_id, batch).unionByName(batch).groupBy("user_id").agg(F.max("newest").alias("newest"))
        versions.put(batch_id, merged)
    streams.run_batches(streams.newest_comment(_events(t), "user_id", "ts"), "newest", each, mode="update").awaitTermination()
    return versions.latest().select("user_id", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("t6_stage_windows", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
  WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def _(t: Tables):
    out = streams.run_available(streams.stage_windows(_events(t), "event_type", "ts"), "windows")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("t7_stream_extraction")
def _(t: Tables):
    sink = fresh_path(t.spark, "articles")
    streams.run_batches(_pages(t), "articles", streams.extraction_step(lambda b: jobs.extract_main_text(b), sink)).awaitTermination()
    return t.spark.read.schema("page_id bigint, title string, content string, batch_id int").parquet(sink).select("page_id", "title", "content")


@query("t7_stream_articles", f"SELECT doc_id AS page_id, 'Doc ' || doc_id AS title, md5(CASE WHEN {_LONG} THEN {_ARTICLE} ELSE '' END) AS content FROM documents "
       f"WHERE {_LONG} AND length({_ARTICLE}) > 25")
def _(t: Tables):
    """Articles of pages that land in four files, a file a batch."""
    sink, stream = fresh_path(t.spark, "articles"), _in_files(t, _article_pages(t), 4, "page_id")
    streams.run_batches(stream, "articles", streams.extraction_step(lambda b: jobs.extract_main_text(b), sink)).awaitTermination()
    return t.spark.read.schema("page_id bigint, title string, content string, batch_id int").parquet(sink).select("page_id", "title", F.md5("content").alias("content"))


_START = "1995-01-01 00:00:00"


@query("t4_rounds", f"""WITH RECURSIVE s AS (SELECT page_id, (page_id % 3 + 1)::INT AS every, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS due FROM pages),
  r AS (SELECT 0 AS round, page_id, every, due FROM s
    UNION ALL SELECT round + 1, page_id, every, CASE WHEN due <= round THEN round + every ELSE due END FROM r WHERE round < 3)
  SELECT round::BIGINT AS round, page_id AS scrape_id FROM r WHERE due <= round""")
def _(t: Tables):
    """The loop over four days: each round plans what is due then, and moves it on by its own interval."""
    spark, ticks, plans = t.spark, fresh_path(t.spark, "ticks"), fresh_path(t.spark, "plans")
    start = F.lit(_START).cast("timestamp_ntz")
    scrapes = t.pages.select(F.col("page_id").alias("scrape_id"), F.expr("CAST(page_id % 3 + 1 AS INT)").alias("every_days"),
                             F.when(F.expr("page_id % 2 = 0"), start).otherwise(start + F.expr("interval 1 day")).alias("due_at"))
    table = TableVersions(spark, fresh_path(spark, "scrapes"), scrapes.filter("false"), ("scrape_id",))
    table.add(0, scrapes)
    for day in range(4):    # one file after the other, as a stream takes them by their time
        spark.range(1).select((start + F.expr(f"make_dt_interval({day})")).alias("tick")).coalesce(1).write.mode("append").parquet(ticks)
    clock = spark.readStream.schema("tick timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(ticks)

    def work(due, round_):
        due.select(F.lit(round_).cast("bigint").alias("round"), "scrape_id").write.mode("overwrite").parquet(f"{plans}/round={round_}")
    streams.run_batches(clock, "rounds", streams.crawl_rounds(table, work)).awaitTermination()
    return spark.read.schema("round bigint, scrape_id bigint").option("recursiveFileLookup", "true").parquet(plans)
