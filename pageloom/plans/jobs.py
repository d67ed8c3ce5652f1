"""The jobs users call.

Functions return frames. Those that read something several times write it to the shared folder first, and
so run jobs of their own: ``parse_pages``, ``fetch_and_extract``, ``full_run``, ``index_pages``, and language
detection, for its table of frequent words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lang, text, urls
from ..functions.dates import DATE_TAGS
from ..operators import bloom, crawl, index, language, page_dates, scoring, selectors, url_filters
from ..operators.merge import Registry, is_fetched, merge_attributes
from ..operators.metrics import StageLog
from ..operators.nodes import page_tasks, parsed_once
from ..session import forget, shuffles_freed, stored as write_once, stored_by
from ..sources.sinks import report_rows

EXTRACTORS = Registry()


def filter_urls(docs: DataFrame, order: str, **settings) -> DataFrame:
    return url_filters.filter_chain(docs, url_filters.http_chain(order, **settings))


def detect_language(docs: DataFrame, lexicon: DataFrame | None = None, filters: DataFrame | None = None,
                    key: str = "doc_id", body: str = "text", languages: list[str] | None = None) -> DataFrame:
    """Language by word hits: exact with ``lexicon``, or by Bloom ``filters``.

    With ``languages`` reading stops early once one of them leads clearly.
    """
    toks = language.tokens(docs, key, body)
    how = "inner" if languages is None else "left"
    hits = (language.lexicon_hits(toks, lexicon, how) if filters is None
            else bloom.word_hits(toks, filters, how=how))
    counts = language.hit_counts(hits, key) if languages is None else language.early_exit_counts(hits, languages, key)
    best = language.top_by_margin(counts, key)
    return (docs.select(key).join(best, key, "left")
            .select(key, F.coalesce("detected", F.lit("")).alias("detected"),
                    F.coalesce("hits", F.lit(0)).alias("hits")))


@EXTRACTORS.register("rules")
def extract_by_rules(pages: DataFrame, site_rules: DataFrame | None = None) -> DataFrame:
    out = selectors.rule_fields(pages, site_rules)
    return out.withColumns({"title": F.try_element_at("fields", F.lit("title")),
                            "content": F.try_element_at("fields", F.lit("content"))})


@EXTRACTORS.register("scoring")
def extract_main_text(pages: DataFrame, min_length: int = 25, parsed: DataFrame | None = None, **limits) -> DataFrame:
    """(page_id, title, content); pages with too little text give no row. ``parsed`` has the nodes of the pages, if there are any yet."""
    body = scoring.main_text(pages if parsed is None else parsed, **limits).filter(F.length("content") > min_length)
    titles = pages.select("page_id", page_title("html").alias("title"))
    return titles.join(body, "page_id")


@EXTRACTORS.register("default")
def default_extract(pages: DataFrame) -> DataFrame:
    """Title and whole body text, by expressions alone."""
    return pages.withColumns({"title": page_title("html"), "content": body_text("html")})


def page_title(html: Column | str) -> Column:
    return text.clean_title(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def body_text(html: Column | str) -> Column:
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)", 1)
    return text.strip_ws(text.strip_html_block(text.strip_comments(body)))


def finish(value: Column | str) -> Column:
    return text.strip_all(text.decode_entities(value))


def with_text_language(rows: DataFrame, texts: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """``rows`` with a language by the words of their text, where ``lang`` is still null.

    ``texts`` has page_id and text. Only the texts of rows without a language are tokenised.
    """
    if lexicon is None:
        return rows
    open_ = rows.filter("lang is null").select("page_id").join(texts, "page_id")
    found = detect_language(open_, lexicon, key="page_id", body="text").select(
        "page_id", F.nullif("detected", F.lit("")).alias("_by_text"))
    return rows.join(found, "page_id", "left").withColumn("lang", F.coalesce("lang", "_by_text")).drop("_by_text")


def parse_pages(pages: DataFrame, site_rules: DataFrame, parts: int | None = None) -> DataFrame:
    """(page_id, url, rules, nodes, found, parse_error), written once: the one parse that rules, scoring, dates and links read.

    With ``parts`` it lies in so many buckets of page_id.
    """
    ruled = selectors.with_rules(pages.select("page_id", "url", "html"), site_rules)
    # pages are dealt before they are parsed, if they don't lie so: nodes are larger
    parsed = parsed_once(ruled.repartition(parts, "page_id") if parts else ruled, path_tags=tuple(tag for tag, _ in DATE_TAGS))
    return stored_by(parsed, "nodes", "page_id", parts, lies_so=True) if parts else write_once(parsed, "nodes", compression="zstd")


def _filled(value: Column) -> Column:
    # bound once, as an expression that stands twice is worked out twice
    return F.get(F.filter(F.array(value), lambda v: ~text.is_blank(v)), F.lit(0))


# Fields beside title and content that rules may name, kept whichever extractor gives the text.
EXTRAS = ("author", "evaluation", "tags")


def fetch_and_extract(pages: DataFrame, site_rules: DataFrame, as_of: Column, lexicon: DataFrame | None = None,
                      parsed: DataFrame | None = None, parts: int | None = None, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Complete pages pass; others go through rules, then scoring, then the default. Each page is parsed once.

    A page that comes with a title or a content only keeps it where no extractor finds one; author,
    evaluation and tags that rules find stay, whichever extractor gives the text. The language is that of the
    markup, else of the host's end, else, with a lexicon, that of the words. ``parse_error`` says why a page
    could not be read.

    Each later extractor runs only on the pages that are still open. What the rules found is
    written once, since it is both a result and the test of what is still open.

    Pages and their nodes that lie in ``parts`` buckets of page_id are joined where they lie, and what is
    written on the way lies so, too. ``scratch`` gets all that: the files are needed until the result is written.
    """
    seed = pages.columns
    known = [c if c in seed else F.lit(None).cast("string").alias(c) for c in ("title", "content")]
    rows = pages.select("page_id", "url", "html", *known)
    parsed = parse_pages(rows, site_rules, parts) if parsed is None else parsed
    scratch = [] if scratch is None else scratch
    done = rows.filter(is_fetched()).select("page_id", "title", "content", F.lit("given").alias("extractor"))
    todo = rows.filter(~is_fetched())

    ruled = parsed.filter("rules IS NOT NULL")
    if {"title", "content"} <= set(seed):   # else no page is complete
        ruled = ruled.join(todo.select("page_id"), "page_id", "left_semi")
    fields = selectors.fields_of(ruled).select("page_id", *[
        finish(F.try_element_at("fields", F.lit(c))).alias(c) for c in ("title", "content", *EXTRAS)])
    fields = stored_by(fields, "ruled", "page_id", parts) if parts else write_once(fields, "ruled")
    scratch.append(fields)
    by_rules = fields.filter(is_fetched()).select("page_id", "title", "content")
    rest = todo.join(by_rules.select("page_id"), "page_id", "left_anti")
    by_score = extract_main_text(rest, parsed=parsed.join(rest.select("page_id"), "page_id", "left_semi"),
                                 parts=parts, scratch=scratch).select(
        "page_id", finish("title").alias("_title"), finish("content").alias("_content"))
    scored_ok = F.coalesce(is_fetched("_title", "_content"), F.lit(False))
    # read here, behind the join, the whole body is worked out only for pages that scoring left open
    whole = {"title": finish(page_title("html")), "content": finish(body_text("html"))}
    picked = {c: F.when(F.col("_scored"), F.col(f"_{c}")).otherwise(_filled(whole[c])) for c in ("title", "content")}
    merged = merge_attributes({c: F.col(c) for c in ("title", "content")}, picked)
    fallback = rest.join(by_score.withColumn("_scored", scored_ok), "page_id", "left").withColumn("_scored", F.coalesce("_scored", F.lit(False))).select(
        "page_id", *[F.coalesce(merged[c], F.lit("")).alias(c) for c in ("title", "content")],
        F.when(F.col("_scored"), "scoring").otherwise("default").alias("extractor"))
    # under a new name of the key Spark sees that the parts of the union lie alike
    picked = [x.withColumnRenamed("page_id", "_page") for x in (done, by_rules.withColumn("extractor", F.lit("rules")), fallback)]
    picked = picked[0].unionByName(picked[1]).unionByName(picked[2]).join(fields.select(F.col("page_id").alias("_page"), *EXTRAS), "_page", "left")
    dated = page_dates.publish_date(parsed, as_of).select("page_id", "published")
    heads = pages.select("page_id", "url", F.coalesce(lang.lang_from_attr("html"), lang.lang_from_tld("url")).alias("lang"))
    if lexicon is not None:
        picked = write_once(picked, "picked")
        scratch.append(picked)
    heads = with_text_language(heads, picked.select(F.col("_page").alias("page_id"), F.col("content").alias("text")), lexicon)
    return (heads.join(picked, F.col("page_id") == F.col("_page")).drop("_page").join(dated, "page_id").join(parsed.select("page_id", "parse_error"), "page_id")
            .withColumn("outcome", F.when(is_fetched(), "success").otherwise("fail")))


def index_pages(docs: DataFrame, comments: DataFrame, stored: dict[str, DataFrame], profiles: DataFrame,
                as_of: Column) -> dict[str, DataFrame]:
    """Next versions of sources, pages and comments. ``stored`` holds the present ones."""
    sources = index.upsert_sources(stored["sources"], docs)
    pages = index.upsert_pages(stored["pages"], docs, sources, profiles, as_of)
    fresh = index.new_comments(stored["comments"], comments, as_of)
    return {"sources": sources,
            "pages": index.date_by_comments(pages, stored["comments"], fresh),
            "comments": stored["comments"].unionByName(fresh)}


def extract_report(url_list: DataFrame, pages: DataFrame, as_of: Column, lexicon: DataFrame | None = None) -> DataFrame:
    """(url, found date, lang) per listed URL, or an error row where no page landed."""
    by_markup = pages.withColumn("lang", F.coalesce(lang.lang_from_attr("html"), lang.lang_from_tld("url")))
    pages = with_text_language(by_markup, pages.select("page_id", text.decode_entities(text.strip_html_block("html")).alias("text")), lexicon)
    landed = url_list.join(pages, "url", "left")
    dated = page_dates.publish_date(pages.join(url_list.select("url").distinct(), "url", "left_semi"), as_of)
    out = landed.join(dated, "page_id", "left").select(
        "url", F.col("page_id").isNull().alias("_failed"), F.col("published_text").alias("found"),
        "lang")
    return report_rows(out, F.col("_failed"))


def review_listings(found: DataFrame, selector: str, marker: str, site_host: str) -> DataFrame:
    """(url) of the review lists that search result pages link to, each once."""
    links = selectors.attributes_of(found, selector, "href").select(F.explode("values").alias("href"))
    return links.select(urls.search_result_link("href", marker, site_host).alias("url")).filter("url is not null").distinct()


def opinion_links(listings: DataFrame, selector: str) -> DataFrame:
    """(listing, url): the real links of the opinions on landed review lists, taken from their click handlers."""
    calls = selectors.attributes_of(listings, selector, "onmousedown").select(F.col("url").alias("listing"), F.explode("values").alias("call"))
    return calls.filter("call is not null").select("listing", text.unwrap_js_link("call").alias("url"))


def review_extract(pages: DataFrame, site_rules: DataFrame, drop_date_dots: bool = False,
                   listings: DataFrame | None = None) -> DataFrame:
    """(author, published, url, evaluation) of review pages, by a rule set; review lists give a row of their URL alone."""
    found = selectors.rule_fields(pages, site_rules)
    field = lambda name: F.try_element_at("fields", F.lit(name))
    out = found.select("url", text.clean_field(field("author")).alias("author"),
                       text.clean_field(field("published"), drop_date_dots).alias("published"),
                       field("evaluation").alias("evaluation"))
    if listings is None:
        return out
    none = F.lit(None).cast("string")
    return out.unionByName(listings.select("url", none.alias("author"), none.alias("published"), none.alias("evaluation")))


def full_run(scrapes: DataFrame, profiles: DataFrame, stored: dict[str, DataFrame], results: DataFrame,
             landed: DataFrame, site_rules: DataFrame, as_of: Column, days: int = 60,
             comments: DataFrame | None = None, lexicon: DataFrame | None = None, log: StageLog | None = None) -> dict[str, DataFrame]:
    """Plan, filter, extract, index and retain for all profiles at once: next versions of all tables.

    ``stored`` holds sources and pages, and may hold comments and a blacklist: blacklisted pages are
    not worked on, and pages without text come on it. Tables that several later steps read are
    written once to the shared folder: the search tasks, the pages to work on, their nodes and their texts;
    ``log`` notes for each of these stages how long it took and its rows by profile. ``landed`` may have an etag.

    The pages lie in buckets of page_id, so that texts move only to get there and by url, and files go once no step,
    and no table returned, reads them any more.
    """
    with shuffles_freed(scrapes.sparkSession):
        return _full_run(scrapes, profiles, stored, results, landed, site_rules, as_of, days, comments, lexicon, log or StageLog())


def _full_run(scrapes: DataFrame, profiles: DataFrame, stored: dict[str, DataFrame], results: DataFrame, landed: DataFrame, site_rules: DataFrame,
              as_of: Column, days: int, comments: DataFrame | None, lexicon: DataFrame | None, log: StageLog) -> dict[str, DataFrame]:
    scratch = []
    tasks = log.written(crawl.plan_crawl(scrapes, profiles, stored["sources"], as_of), "tasks")
    queue = crawl.result_queue(tasks, results)
    wanted = filter_urls(queue.withColumn("_ord", F.col("scrape_id")), "_ord",
                         history=stored["pages"].select("url"))
    banned = stored.get("blacklist")
    if banned is None:
        banned = scrapes.sparkSession.createDataFrame([], "hashed_name string, profile_id bigint")
    wanted = url_filters.blacklist_filter(wanted, banned)
    none = F.lit(None).cast("string")
    if "etag" not in landed.columns:
        landed = landed.withColumn("etag", none)
    parts = max(int(scrapes.sparkSession.conf.get("spark.sql.shuffle.partitions")), page_tasks(landed))
    bodies = log.written(landed.withColumn("url", urls.normalize("url")).join(
        wanted.select("url", "profile_id", "referring_source_id"), "url"), "bodies", "page_id", parts)
    parsed = parse_pages(bodies, site_rules, parts)
    texts = fetch_and_extract(bodies.select("page_id", "url", "html"), site_rules, as_of, lexicon, parsed, parts, scratch)
    of_page = bodies.select("page_id", "profile_id", "referring_source_id", "etag", F.col("html").alias("raw"))
    found = log.written(texts.join(of_page.select("page_id", "profile_id"), "page_id"), "texts", "page_id", parts)
    forget(*scratch)
    failed = write_once(found.filter("outcome <> 'success'").select("url", "profile_id"), "failed")
    blacklist = index.upsert_blacklist(banned, failed)
    links = parsed.select("page_id", selectors.links_of(F.col("nodes")).alias("links"))
    docs = (found.filter("outcome = 'success'").drop("profile_id").join(of_page, "page_id").join(links, "page_id")
            .select("url", "title", "content", "author", "links",
                    "profile_id", "referring_source_id", "etag", "raw", "published",
                    F.lit(None).cast("timestamp_ntz").alias("updated"), "lang", "evaluation",
                    "tags", F.col("page_id").alias("ord")))
    docs = log.written(docs, "docs")
    log.settle()
    forget(bodies, parsed, found)
    if comments is None:
        # hosts are few: a table of known size needs no exchange of pages by host
        sources = write_once(index.upsert_sources(stored["sources"], docs), "sources")
        tables = {"sources": sources, "pages": index.upsert_pages(stored["pages"], docs, sources, profiles, as_of)}
    else:
        tables = index_pages(docs, comments, stored, profiles, as_of)
    return tables | {"pages": index.retained(tables["pages"], as_of, days), "blacklist": blacklist}
