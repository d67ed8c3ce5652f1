"""What is wrong with a batch: one row for each fault, beside the rows that go on.

A fault of one page or rule never stops the others. Some lose the page (``lost``), some are mended on the
way: bad bytes are dropped, rules of one field on one host are one rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text, urls

# What the reasons are called; a page that can't be parsed has the parser's own words after it.
BAD_URL, NO_MARKUP, BAD_BYTES, NOT_PARSED, DOUBLED_RULE = "bad url", "no markup", "bad bytes dropped", "not parsed", "rules merged"
FAULT = "subject string, key string, reason string, lost boolean"


def _rows(pages: DataFrame, reason, lost: bool) -> DataFrame:
    return pages.select(F.lit("page").alias("subject"), F.col("page_id").cast("string").alias("key"),
                        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(lost).alias("lost"))


def page_faults(fetched: DataFrame) -> DataFrame:
    """Faults of landed pages (page_id, url, charset, raw). Bytes are judged where the charset is UTF-8 or ASCII; others take any."""
    name, raw = F.upper(F.trim("charset")), F.col("raw")
    bad_utf8 = name.isin("UTF-8", "UTF8") & ~F.is_valid_utf8(raw.cast("string"))
    bad_ascii = name.isin("US-ASCII", "ASCII") & F.decode(raw, "ISO-8859-1").rlike(r"[^\x00-\x7f]")
    good_url = F.coalesce(urls.is_http("url"), F.lit(False))
    empty = raw.isNull() | (F.length(raw) == 0)
    return (_rows(fetched.filter(~good_url), BAD_URL, True)
            .unionByName(_rows(fetched.filter(good_url & empty), NO_MARKUP, True))
            .unionByName(_rows(fetched.filter(good_url & F.coalesce(bad_utf8 | bad_ascii, F.lit(False))), BAD_BYTES, False)))


def parse_faults(parsed: DataFrame) -> DataFrame:
    """Pages (page_id, parse_error) that have no nodes for a reason."""
    return _rows(parsed.filter("parse_error IS NOT NULL"), F.concat(F.lit(NOT_PARSED + ": "), "parse_error"), True)


def rule_faults(site_rules: DataFrame) -> DataFrame:
    """Fields of a host with several selectors, or with one that is given twice."""
    doubled = site_rules.groupBy("host_slug", "tag").agg(F.count("*").alias("n")).filter("n > 1")
    return doubled.select(F.lit("rule").alias("subject"), F.concat_ws(" ", "host_slug", "tag").alias("key"), F.lit(DOUBLED_RULE).alias("reason"), F.lit(False).alias("lost"))


def good_pages(loaded: DataFrame) -> DataFrame:
    """Loaded pages that can be worked on."""
    return loaded.filter(F.coalesce(urls.is_http("url"), F.lit(False)) & ~text.is_blank("html"))
