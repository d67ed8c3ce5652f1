"""Queries for crawl planning, upserts, loading and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, ratings, text, urls
from ..operators import crawl, index, merge, metrics, url_filters
from ..operators.keyed_table import TableVersions
from ..plans import jobs
from ..schemas import PAGE_INDEX, SOURCE, STORED_COMMENT
from ..session import fresh_path, stored
from ..sources import pages as page_source, sinks
from .registry import query
from .views import AS_OF_TEXT, CRAWL_AS_OF_TEXT, SRC, TASKS, Tables, as_of, crawl_as_of, w

# crawl planning
_TASK_COLUMNS = "scrape_id, profile_id, profile_title, source_id, source_url, keyword"
@query("p1_plan_crawl", w(*TASKS) + f"SELECT {_TASK_COLUMNS} FROM tasks")
def _(t: Tables):
    return t.tasks()


@query("j4_scrape_keywords", w(*TASKS) + "SELECT scrape_id, unnest(CASE WHEN len(s.keywords) > 0 THEN s.keywords ELSE p.keywords END) AS keyword "
       "FROM scrapes s JOIN profiles p USING (profile_id) JOIN crawl_sources c USING (source_id)")
def _(t: Tables):
    """All scrapes, expired ones too, with each keyword of their own or of their profile."""
    return crawl.search_tasks(t.scrapes(), t.profiles(), t.crawl_sources()).select("scrape_id", "keyword")


@query("j3_scrape_parents", w(*TASKS) + "SELECT scrape_id, p.title AS profile_title, c.url AS source_url FROM scrapes s JOIN profiles p USING (profile_id) JOIN crawl_sources c USING (source_id)")
def _(t: Tables):
    p = t.profiles().select("profile_id", F.col("title").alias("profile_title"))
    s = t.crawl_sources().select("source_id", F.col("url").alias("source_url"))
    return t.scrapes().join(p, "profile_id").join(s, "source_id").select("scrape_id", "profile_title", "source_url")


@query("j5_profile_scrapes", w(*TASKS) + "SELECT scrape_id FROM scrapes WHERE profile_id IN (SELECT profile_id FROM profiles WHERE list_contains(languages, 'fr'))")
def _(t: Tables):
    return crawl.select_scrapes(t.scrapes(), crawl_as_of(), profiles=t.profiles().filter("array_contains(languages, 'fr')")).select("scrape_id")


@query("j6_ignored_profiles", w(*TASKS) + "SELECT scrape_id FROM due WHERE profile_id NOT IN (SELECT profile_id FROM profiles WHERE list_contains(languages, 'fr'))")
def _(t: Tables):
    return crawl.select_scrapes(t.scrapes(), crawl_as_of(), ignore_profiles=t.profiles().filter("array_contains(languages, 'fr')")).select("scrape_id")


@query("j7_listed_scrapes", w(*TASKS) + "SELECT scrape_id FROM due WHERE scrape_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t: Tables):
    listed = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scrape_id"))
    return crawl.select_scrapes(t.scrapes(), crawl_as_of(), scrape_ids=listed).select("scrape_id")


@query("f20_keyword_fallback", w(*TASKS) + "SELECT scrape_id, array_to_string(CASE WHEN len(s.keywords) > 0 THEN s.keywords ELSE p.keywords END, '|') AS keywords FROM scrapes s JOIN profiles p USING (profile_id)")
def _(t: Tables):
    both = t.scrapes().alias("s").join(t.profiles().alias("p"), "profile_id")
    return both.select("scrape_id", F.array_join(crawl.keyword_fallback(F.col("s.keywords"), F.col("p.keywords")), "|").alias("keywords"))


@query("f21_not_expired", w(*TASKS) + "SELECT scrape_id FROM due")
def _(t: Tables):
    return crawl.not_expired(t.scrapes(), crawl_as_of()).select("scrape_id")


_QUEUE = (w(*TASKS, "results") + "SELECT r.scrape_id, r.keyword, r.url, t.profile_id, t.source_url AS referring_uri, t.source_id AS referring_source_id "
          "FROM (SELECT DISTINCT * FROM results WHERE url LIKE 'http%') r JOIN tasks t ON t.scrape_id = r.scrape_id AND t.keyword = r.keyword")
@query("k3_result_merge", _QUEUE)
def _(t: Tables):
    return crawl.result_queue(t.tasks(), stored(t.results(), "results"))


@query("u3_result_queue", _QUEUE)
def _(t: Tables):
    """Result lists that overlap make one queue."""
    results = stored(t.results(), "results")
    return crawl.result_queue(t.tasks(), results.filter("length(url) % 2 = 0").unionByName(results).unionByName(results.filter("scrape_id % 2 = 1")))


@query("a1_distinct_results", w(*TASKS, "results") + "SELECT DISTINCT scrape_id, keyword, url FROM results")
def _(t: Tables):
    return t.results().dropDuplicates(["scrape_id", "keyword", "url"]).dropna(how="all")


@query("a14_stage_metrics", f"SELECT profile_id, referring_source_id, keyword, count(*) AS results, (SELECT count(*) FROM ({_QUEUE})) AS observed FROM ({_QUEUE}) GROUP BY ALL")
def _(t: Tables):
    """The rows observed while the queue was written stand beside the counts of what was written."""
    queue, watch = metrics.observed(crawl.result_queue(t.tasks(), stored(t.results(), "results")), "queue")
    written = stored(queue, "queue")
    return metrics.stage_counts(written).withColumn("observed", F.lit(watch.get["rows"]).cast("bigint"))


# joins with stored tables
@query("j1_page_source", w(*SRC, "page_hosts") + "SELECT page_id, source_id FROM page_hosts")
def _(t: Tables):
    s = t.sources().select("source_id", F.col("url").alias("host"))
    return t.pages.select("page_id", urls.host_url("url").alias("host")).join(s, "host").select("page_id", "source_id")


@query("j2_page_profile", w("profiles") + "SELECT page_id, title FROM pages JOIN profiles ON profile_id = page_id % 25")
def _(t: Tables):
    return t.pages.select("page_id", F.expr("page_id % 25").alias("profile_id")).join(t.profiles(), "profile_id").select("page_id", "title")


@query("j8_rule_lookup", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '\W+', '-', 'g') AS slug FROM pages),
  r AS (SELECT DISTINCT slug FROM p WHERE slug LIKE 'www-%' OR slug LIKE 'm-%'), q AS (SELECT page_id, slug, regexp_replace(slug, '^[^-]*', 'www') AS www FROM p)
  SELECT page_id, coalesce(a.slug, b.slug) AS rule FROM q LEFT JOIN r a ON a.slug = q.slug LEFT JOIN r b ON b.slug = q.www""")
def _(t: Tables):
    from ..operators.selectors import with_rules
    slugs = t.pages.select(urls.host_slug("url").alias("host_slug")).distinct().filter("host_slug LIKE 'www-%' OR host_slug LIKE 'm-%'")
    rules = slugs.select("host_slug", F.col("host_slug").alias("tag"), F.lit("h1").alias("selector"))
    return with_rules(t.pages, rules).select("page_id", F.get("rules", F.lit(0))["field"].alias("rule"))


_SERVED = (w(*SRC, "categories", "page_hosts") + "SELECT p.url, c.name AS cat_name FROM page_hosts p JOIN sources s USING (source_id) JOIN categories c USING (category_id) "
           "WHERE page_id % 7 <> 3 AND page_id % 25 < 12 AND s.category_id = 2")
_SERVED_INDEX = "CASE WHEN page_id % 7 = 3 THEN 50 ELSE 0 END AS status", "page_id % 25 AS profile_id"
for _name, _limit in (("j12_pages_sources_categories", None), ("o4_limit", 30)):
    @query(_name, _SERVED + (f" ORDER BY url LIMIT {_limit}" if _limit else ""))
    def _(t: Tables, limit=_limit):
        known = t.sources().select(F.col("url").alias("host"), "source_id")
        idx = t.pages.selectExpr("url", *_SERVED_INDEX).withColumn("host", urls.host_url("url")).join(known, "host")
        out = index.served_pages(idx, t.sources(), t.categories()).filter("status <> 50 AND profile_id < 12 AND category_id = 2").select("url", "cat_name")
        return out.orderBy("url").limit(limit) if limit else out


_SINCE = (w(*SRC, "categories", "page_hosts") + "SELECT p.url, strftime(DATE '2001-01-01' + (page_id % 7000)::INT, '%Y-%m-%d') AS published, c.name AS cat_name "
          "FROM page_hosts p JOIN sources s USING (source_id) JOIN categories c USING (category_id) WHERE page_id % 7 <> 3 AND page_id % 7000 > 10")


def _dated_index(t: Tables):
    known = t.sources().select(F.col("url").alias("host"), "source_id")
    return t.pages.selectExpr("url", *_SERVED_INDEX, "CAST(date_add(DATE '2001-01-01', CAST(page_id % 7000 AS INT)) AS TIMESTAMP_NTZ) AS published").withColumn(
        "host", urls.host_url("url")).join(known, "host")


@query("f16_served_pages", _SINCE)
def _(t: Tables):
    since = F.lit("2001-01-11 00:00:00").cast("timestamp_ntz")
    return index.served_since(_dated_index(t), t.sources(), t.categories(), since).withColumn("published", F.date_format("published", "yyyy-MM-dd"))


@query("s14_page_source_category", _SINCE + " ORDER BY published DESC, url LIMIT 25")
def _(t: Tables):
    """From stored tables, the newest pages first; the limit is the feature."""
    tables = [stored(x, n) for x, n in ((_dated_index(t), "pages"), (t.sources(), "sources"), (t.categories(), "categories"))]
    since = F.lit("2001-01-11 00:00:00").cast("timestamp_ntz")
    return index.served_since(*tables, since, limit=25).withColumn("published", F.date_format("published", "yyyy-MM-dd"))


# page loading
_OK = "page_id % 4 = 0"


@query("f12_status", f"SELECT page_id, CASE WHEN {_OK} THEN 'success' ELSE 'fail' END AS outcome FROM pages")
def _(t: Tables):
    return t.fetched().select("page_id", page_source.fetch_outcome("status").alias("outcome"))


@query("f13_content_type_gate", "SELECT page_id FROM pages WHERE page_id % 3 = 0")
def _(t: Tables):
    return t.fetched().filter(merge.can_do("content_type")).select("page_id")


_TYPE = "CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/octet-stream' END ELSE 'application/pdf' END"


@query("f14_octet_sniff", f"SELECT page_id, {_TYPE} AS content_type FROM pages")
def _(t: Tables):
    return t.fetched().select("page_id", page_source.sniffed_type(F.col("content_type"), F.col("raw").cast("string")).alias("content_type"))


@query("p3_load_pages", f"""SELECT page_id, {_TYPE} AS content_type, CASE WHEN {_OK} THEN 'success' ELSE 'fail' END AS outcome,
  CASE WHEN page_id % 5 < 2 THEN md5(body) ELSE NULL END AS hash FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE substr(html, 2) END AS body FROM pages)""")
def _(t: Tables):
    loaded = page_source.load_pages(t.fetched())
    return loaded.select("page_id", "content_type", "outcome", F.when(F.expr("page_id % 5 < 2"), F.md5("html")).alias("hash"))


# fetched tests and merging
@query("f10_is_fetched", "SELECT doc_id, regexp_matches(text, '\\S') AND doc_id % 3 > 0 AS v FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", merge.is_fetched(F.expr("element_at(array(NULL, ' x', text), CAST(doc_id % 3 AS INT) + 1)"), F.col("text")).alias("v"))


@query("f11_skip_complete", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'given' ELSE 'extracted' END AS how FROM pages")
def _(t: Tables):
    rows = t.pages.select("page_id", F.expr("CASE WHEN page_id % 3 = 0 THEN 'title' END").alias("title"), F.lit("body").alias("content"))
    done, todo = merge.split_complete(rows)
    return done.select("page_id", F.lit("given").alias("how")).unionByName(todo.select("page_id", F.lit("extracted").alias("how")))


@query("f29_attribute_merge", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'found' ELSE 'seed' END AS title, 'seed' AS author, CASE WHEN page_id % 2 = 0 THEN 'k=new|s=1' ELSE 'k=old|s=1' END AS extra FROM pages")
def _(t: Tables):
    found = F.expr("CASE WHEN page_id % 2 = 0 THEN 'found' END")
    merged = merge.merge_attributes({"title": F.lit("seed"), "author": F.lit("seed")}, {"title": found})
    extra = merge.merge_extras(F.expr("map('k', 'old', 's', '1')"), F.expr("CASE WHEN page_id % 2 = 0 THEN map('k', 'new') ELSE CAST(map() AS MAP<STRING, STRING>) END"))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries(extra), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return t.pages.select("page_id", *[c.alias(n) for n, c in merged.items()], flat.alias("extra"))


@query("f25_result_length", "SELECT doc_id FROM documents WHERE length(replace(text, chr(10), '')) > 40")
def _(t: Tables):
    """Pages whose article is longer than the limit; all others give no row. Made so that the limit cuts."""
    from ..plans import jobs
    page = F.concat(F.lit("<body><div class='article'><p>"), F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[\\n\\r\\t]", ""), "[<>&]", "x"), " ", "_"),
                    F.lit("</p></div></body>"))
    pages = t.documents.select(F.col("doc_id").alias("page_id"), page.alias("html"))
    return jobs.extract_main_text(pages, min_length=40).select(F.col("page_id").alias("doc_id"))


@query("s4_result_csv", "SELECT url, CASE WHEN page_id % 4 = 0 THEN regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) END AS lang, "
       "CASE WHEN page_id % 4 = 0 THEN md5(url) ELSE 'Error. Page not exist or page redirect' END AS found FROM pages")
def _(t: Tables):
    from ..functions.lang import lang_from_attr
    rows = t.pages.select("url", F.md5("url").alias("found"), lang_from_attr("html").alias("lang"), F.expr("page_id % 4 <> 0").alias("bad"))
    path = fresh_path(t.spark, "report")
    sinks.write_csv(sinks.report_rows(rows, F.col("bad")), path)
    return t.spark.read.csv(path, schema="url string, found string, lang string")


# upserts
_SOURCES = w(*SRC)
for _name in ("s10_source_upsert",):
    @query(_name, _SOURCES + "SELECT source_id, url, CASE WHEN lang = 'en' THEN 'en' END AS lang, CASE WHEN lang = 'en' THEN category_id END AS category_id FROM sources")
    def _(t: Tables):
        return index.upsert_sources(t.some_sources(), t.pages)


@query("u2_url_set_merge", _SOURCES + "SELECT url FROM sources UNION SELECT 'http://supplier' || s_suppkey || '.example.com/' FROM supplier")
def _(t: Tables):
    return index.url_set_merge(t.sources(), t.crawl_sources().unionByName(t.crawl_sources()))


@query("w9_first_page_of_host", "SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' AS source_url, min(page_id) AS page_id FROM pages GROUP BY 1")
def _(t: Tables):
    return index.first_page_of_host(t.pages.select("page_id", "url")).select("source_url", "page_id")


_LANG = "coalesce(source_lang, html_lang, 'ot')"
_STATUS = f"CASE WHEN len(languages) > 0 AND NOT list_contains(languages, {_LANG}) THEN 50 END"
_PUBLISHED = ("CASE WHEN page_id % 4 > 0 THEN least((DATE '2018-01-01' + (page_id % 4000)::INT)::TIMESTAMP, "
              f"TIMESTAMP '{AS_OF_TEXT}') ELSE TIMESTAMP '{AS_OF_TEXT}' END")
_RATING = "CASE WHEN page_id % 2 = 0 THEN floor((page_id % 11 + 0.5) * 5 / 10)::BIGINT END"
_NEW_TAGS = "list_sort(['alpha', 'b' || (page_id % 4), 'news'])"
_INDEX = (w(*SRC, "profiles", "page_hosts") + ", st AS (SELECT url, page_id, CASE WHEN page_id % 5 = 0 THEN 50 END AS status, page_id % 6 AS evaluation, "
          "CASE WHEN page_id % 2 = 0 THEN 'alpha, b2, news' WHEN page_id % 7 = 0 THEN 'old' END AS tags FROM page_hosts WHERE source_lang IS NULL), "
          f"nw AS (SELECT p.url, p.page_id, {_LANG} AS lang, {_STATUS} AS status, strftime({_PUBLISHED}, '%Y-%m-%d') AS published, "
          f"strftime(CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-05-05' ELSE {_PUBLISHED} END, '%Y-%m-%d') AS updated, "
          f"{_RATING} AS evaluation, CASE WHEN page_id % 3 > 0 THEN {_NEW_TAGS} END AS tags, "
          "'http://else.example.com/' || page_id AS links, source_id, 'body ' || page_id || ' x' AS content FROM page_hosts p JOIN profiles ON profile_id = page_id % 25), "
          "ix AS (SELECT n.url, CASE WHEN s.url IS NULL THEN n.content ELSE 'old' END AS content, CASE WHEN s.url IS NULL THEN n.links ELSE '' END AS links, source_id, "
          "CASE WHEN s.url IS NULL THEN n.published ELSE '2011-02-03' END AS published, CASE WHEN s.url IS NULL THEN n.updated ELSE '2011-02-03' END AS updated, "
          "CASE WHEN s.url IS NULL THEN n.lang ELSE 'xx' END AS lang, (CASE WHEN s.url IS NULL THEN n.status ELSE s.status END)::BIGINT AS status, "
          "coalesce(n.evaluation, s.evaluation) AS evaluation, CASE WHEN n.tags IS NULL OR array_to_string(n.tags, ', ') = s.tags THEN s.tags "
          "WHEN s.tags IS NULL THEN array_to_string(n.tags, ',') "
          "ELSE array_to_string(list_concat(string_split(s.tags, ', '), [x for x in n.tags if NOT list_contains(string_split(s.tags, ', '), x)]), ',') END AS tags "
          "FROM nw n LEFT JOIN st s ON s.url = n.url) ")


def _flat(df):
    return df.select("url", "content", F.array_join("links", "|").alias("links"), "source_id",
                     F.date_format("published", "yyyy-MM-dd").alias("published"), F.date_format("updated", "yyyy-MM-dd").alias("updated"),
                     "lang", F.col("status").cast("bigint").alias("status"), "evaluation", F.col("cached_tag_list").alias("tags"))


@query("s9_page_upsert", _INDEX + "SELECT * FROM ix")
def _(t: Tables):
    return _flat(index.upsert_pages(t.stored_index(), t.index_docs(), t.sources(), t.profiles(), as_of()))


@query("f15_language_gate", _INDEX + "SELECT url, lang, status::BIGINT AS status FROM nw")
def _(t: Tables):
    empty = t.spark.createDataFrame([], PAGE_INDEX)
    out = index.upsert_pages(empty, t.index_docs(), t.sources(), t.profiles(), as_of())
    return out.select("url", "lang", F.col("status").cast("bigint").alias("status"))


@query("f18_external_links", _SOURCES + "SELECT page_id, 'http://else.example.com/' || page_id AS links FROM pages")
def _(t: Tables):
    host = urls.host_url("url")
    links = F.array(F.concat(host, F.lit("in")), F.concat(F.lit("http://else.example.com/"), F.col("page_id").cast("string")), host)
    return t.pages.select("page_id", F.array_join(ratings.external_links(links, host), "|").alias("links"))


@query("f17_blank_comments", w("comments") + "SELECT page_url, ord FROM comments WHERE regexp_matches(content, '\\S') OR regexp_matches(title, '\\S')")
def _(t: Tables):
    return index.real_comments(t.comments()).select("page_url", "ord")


_NEWC = w("comments", "stored_comments", "new_comments")
_COMMENT_COLUMNS = "page_url, author, title, content, strftime(published, '%Y-%m-%d') AS published"


def _comments(df):
    return df.withColumn("published", F.date_format("published", "yyyy-MM-dd"))


@query("j15_new_comments", _NEWC + f"SELECT {_COMMENT_COLUMNS} FROM new_comments")
def _(t: Tables):
    return _comments(index.new_comments(t.stored_comments(), t.comments(), as_of()))


@query("s11_comment_upsert", _NEWC + f"SELECT {_COMMENT_COLUMNS} FROM new_comments UNION ALL SELECT {_COMMENT_COLUMNS} FROM stored_comments")
def _(t: Tables):
    return _comments(index.upsert_comments(t.stored_comments(), t.comments(), as_of()))


_DATED = (_NEWC + ", base AS (SELECT DISTINCT page_url AS url, TIMESTAMP '2019-01-01' AS published FROM comments), "
          "allc AS (SELECT page_url, published, false AS fresh FROM stored_comments UNION ALL SELECT page_url, published, true FROM new_comments), "
          "m AS (SELECT page_url, max(published) AS newest, bool_or(fresh) AS fresh FROM allc GROUP BY page_url) ")


@query("a8_last_comment_date", _DATED + "SELECT url, strftime(CASE WHEN fresh THEN newest ELSE published END, '%Y-%m-%d') AS published FROM base LEFT JOIN m ON page_url = url")
def _(t: Tables):
    base = t.comments().select(F.col("page_url").alias("url"), F.lit("2019-01-01").cast("timestamp_ntz").alias("published")).distinct()
    old = t.stored_comments()
    out = index.date_by_comments(base, old, index.new_comments(old, t.comments(), as_of()))
    return out.select("url", F.date_format("published", "yyyy-MM-dd").alias("published"))


@query("w8_latest_comment", w("comments", "stored_comments") + "SELECT page_url, content FROM (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY published DESC, content DESC) AS r FROM stored_comments) WHERE r = 1")
def _(t: Tables):
    return t.stored_comments().groupBy("page_url").agg(F.max_by("content", F.struct("published", "content")).alias("content"))


_BLACK = "SELECT md5(url) AS hashed_name, page_id % 25 AS profile_id FROM pages"


@query("s12_blacklist_upsert", f"SELECT DISTINCT * FROM ({_BLACK} WHERE page_id % 4 > 0 OR page_id % 3 = 1)")
def _(t: Tables):
    known = t.pages.filter("page_id % 3 = 1").select(urls.hashed_uri("url").alias("hashed_name"), F.expr("page_id % 25").alias("profile_id"))
    failed = t.fetched().filter(page_source.fetch_outcome("status") == "fail")
    return index.upsert_blacklist(known, failed.unionByName(failed))


@query("j17_blacklist_anti", f"SELECT page_id, url FROM pages WHERE md5(url) NOT IN (SELECT hashed_name FROM ({_BLACK} WHERE page_id % 3 = 1))")
def _(t: Tables):
    known = t.pages.filter("page_id % 3 = 1").select(urls.hashed_uri("url").alias("hashed_name"), F.expr("page_id % 25").alias("profile_id"))
    return url_filters.blacklist_filter(t.fetched().select("page_id", "url", "profile_id"), known).select("page_id", "url")


@query("p11_index_pages", _INDEX + "SELECT * FROM ix")
def _(t: Tables):
    stored_tables = {"sources": t.sources(), "pages": t.stored_index(), "comments": t.stored_comments()}
    return _flat(jobs.index_pages(t.index_docs(), t.comments(), stored_tables, t.profiles(), as_of())["pages"])


def _tables(t: Tables) -> dict[str, TableVersions]:
    """The stored tables in buckets, as batch 0 left them; pages and comments come in several batches."""
    spark = t.spark
    made = {name: TableVersions(spark, fresh_path(spark, f"table-{name}"), spark.createDataFrame([], schema), key, by)
            for name, schema, key, by in (("sources", SOURCE, ("url",), None), ("pages", PAGE_INDEX, ("url",), None),
                                          ("comments", STORED_COMMENT, ("comment_id",), ("page_url",)))}
    made["sources"].add(0, t.sources())
    made["pages"].add(0, t.stored_index())
    read = t.stored_comments().withColumn("published", F.date_format("published", "yyyy/MM/dd")).withColumn("ord", F.lit(0))
    made["comments"].add(0, index.comment_rows(read, as_of()))
    return made


@query("p11_index_in_buckets", _INDEX + "SELECT * FROM ix")
def _(t: Tables):
    """The same upsert on tables in buckets, in three batches; each writes what it adds or changes."""
    tables, docs = _tables(t), t.index_docs()
    for batch in range(3):
        index.index_batch(tables, batch + 1, docs.filter(F.pmod(F.xxhash64("url"), F.lit(3)) == batch), t.profiles(), as_of(),
                          t.comments().filter(F.pmod(F.xxhash64("page_url"), F.lit(3)) == batch))
    return _flat(tables["pages"].latest())


@query("s11_comments_in_buckets", _NEWC + f"SELECT {_COMMENT_COLUMNS} FROM new_comments UNION ALL SELECT {_COMMENT_COLUMNS} FROM stored_comments")
def _(t: Tables):
    tables = _tables(t)
    index.index_batch(tables, 1, t.index_docs(), t.profiles(), as_of(), t.comments())
    return _comments(tables["comments"].latest().drop("comment_id"))


@query("a8_page_date_in_buckets", _DATED + "SELECT url, strftime(CASE WHEN fresh THEN newest ELSE published END, '%Y-%m-%d') AS published FROM base LEFT JOIN m ON page_url = url")
def _(t: Tables):
    """Pages that are talked about, in a table in buckets: known pages move by their newest comment."""
    tables = _tables(t)
    none = {c: F.lit(None).cast(f.dataType) for c, f in zip(PAGE_INDEX.fieldNames(), PAGE_INDEX.fields)}
    talked = t.comments().select(F.col("page_url").alias("url")).distinct().select(*[
        {"url": F.col("url"), "published": F.lit("2019-01-01").cast("timestamp_ntz")}.get(c, v).alias(c) for c, v in none.items()])
    tables["pages"].add(0, talked)
    index.index_batch(tables, 1, t.index_docs(), t.profiles(), as_of(), t.comments())
    return tables["pages"].latest().join(talked.select("url"), "url", "left_semi").select("url", F.date_format("published", "yyyy-MM-dd").alias("published"))


@query("p14_retention", f"SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{CRAWL_AS_OF_TEXT}' - INTERVAL 60 DAYS")
def _(t: Tables):
    return index.retained(t.orders, crawl_as_of(), 60, "o_orderdate").select("o_orderkey")
