"""Queries for the string, URL and rating expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from ..functions import dates, lang, ratings, text, urls, weights
from ..operators import url_filters
from ..plans import jobs
from ..session import dealt, fresh_path
from ..sources import lists, pages as page_source
from .registry import query
from .views import Tables, as_of

_BODY = "regexp_extract(html, '(?is)<body[^>]*>(.*)', 1)"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
# The named references that occur in the given pages.
_SEEN = ("amp", "quot", "copy", "middot")


def _sql_decode(expr: str) -> str:
    pairs = ", ".join(f"'{n}': chr({name2codepoint[n]})" for n in _SEEN)
    return (f"string_split({expr}, '&')[1] || array_to_string([coalesce(map {{{pairs}}}[regexp_extract(p, '^([A-Za-z]+);', 1)]"
            f" || substr(p, length(regexp_extract(p, '^([A-Za-z]+);', 1)) + 2), '&' || p)"
            f" for p in string_split({expr}, '&')[2:]], '')")


@query("s1_page_scan", "SELECT page_id, url, length(html)::BIGINT AS n FROM pages")
def _(t: Tables):
    path = fresh_path(t.spark, "pages")
    t.pages.write.parquet(path)
    return page_source.scan(t.spark, path).select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query("s2_url_csv", "SELECT url FROM pages")
def _(t: Tables):
    path = fresh_path(t.spark, "urls")
    t.pages.select("url", "page_id").write.csv(path)
    return lists.url_csv(t.spark, path)


@query("s3_plain_url_list", "SELECT DISTINCT trim(u) AS url FROM (SELECT regexp_extract(url, '^([^?#]*)', 1) AS u FROM pages "
                            "UNION ALL SELECT ' ' || url || ' ' FROM pages)")
def _(t: Tables):
    path = fresh_path(t.spark, "lines")
    lines = t.pages.select(F.regexp_extract("url", "^([^?#]*)", 1).alias("value"))
    padded = t.pages.select(F.concat(F.lit(" "), "url", F.lit(" ")).alias("value"))
    lines.union(padded).union(t.pages.select(F.lit("").alias("value"))).write.text(path)
    return lists.plain_url_list(t.spark, path)


def _latin_file(t: Tables, lines) -> str:
    """The lines as a file in Latin-1."""
    path = fresh_path(t.spark, "words")
    lines.write.csv(path, encoding="ISO-8859-1", sep="\u0001", quote="")    # the text writer knows UTF-8 only
    return path


@query("s7_affix_word_list", "SELECT p_name || 'é' AS word FROM part")
def _(t: Tables):
    lines = t.part.select(F.concat("p_name", F.lit("é/AB"), "p_size").alias("value"))
    return lists.affix_word_list(t.spark, _latin_file(t, lines))


@query("s8_coded_word_list", "SELECT unnest([p_name || 'ü', lower(p_brand)]) AS word FROM part WHERE p_size > 5")
def _(t: Tables):
    line = F.concat(F.when(F.col("p_size") > 5, F.concat("p_size", F.lit("r"), "p_size")).otherwise("x"),
                    F.lit("<n>"), "p_name", F.lit("ü , "), F.lower("p_brand"), F.lit(":rest"))
    return lists.coded_word_list(t.spark, _latin_file(t, t.part.select(line.alias("value"))))


def _scalar(name: str, column, sql: str, table: str = "pages", key: str = "page_id"):
    """One expression over a whole table."""
    @query(name, f"SELECT {key}, {sql} AS v FROM {table}")
    def _(t: Tables):
        return getattr(t, table).select(key, column().alias("v"))


_scalar("c1_strip_tags", lambda: text.strip_tags("html"), "regexp_replace(html, '</?[^>]+?>', '', 'g')")
_scalar("c2_strip_ct_nl", lambda: text.strip_ct_nl("text"), r"regexp_replace(text, '[\t\r\n]', '', 'g')", "documents", "doc_id")
_scalar("c3_strip_all", lambda: text.strip_all("html"),
        r"regexp_replace(regexp_replace(regexp_replace(html, '</?[^>]+?>', '', 'g'), '[\t\r\n]', '', 'g'), '^\s+|\s+$', '', 'g')")
_scalar("c4_strip_comments", lambda: text.strip_comments("html"), "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')")
_BLOCK = (r"regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<(?:script|style).*?>.*?</(?:script|style).*?>', '', 'g'), "
          r"'(?s)<.+?>', '', 'g'), '\s+', ' ', 'g')")
_scalar("c5_strip_html_block", lambda: text.strip_html_block("html"), _BLOCK.format("html"))
_scalar("c6_clean_title", lambda: text.clean_title("html"), r"regexp_replace(html, '<[^>]*>|\n|\t', '', 'g')")
_scalar("c7_article_text_clean", lambda: text.article_text_clean(F.concat("html", F.lit(" &nbsp;\r\n\t x"))),
        r"regexp_replace(replace(regexp_replace(regexp_replace(html || ' &nbsp;' || chr(13) || chr(10) || chr(9) || ' x', '[\r\n\f]+', '', 'g'), "
        r"'[\t ]+', ' ', 'g'), '&nbsp;', ' '), '</?[^>]+?>', '', 'g')")
_scalar("c8_squeeze_ws", lambda: text.squeeze_ws("text"),
        r"regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '\s{2,}', ' ', 'g')", "documents", "doc_id")
_scalar("c9_decode_entities", lambda: text.decode_entities("html"), _sql_decode("html"))
_scalar("c10_unescape_href", lambda: text.unescape_href(F.concat("url", F.lit("?a=1&amp;b=&#233;&lt;&copy;"))),
        "url || '?a=1&b=' || chr(233) || '<&copy;'")
_scalar("c11_to_utf8", lambda: text.to_utf8(F.encode("html", "UTF-8"), F.lit("utf-8")), "html")


def _coded():
    """(charset, bytes in front, what they mean), the page's url after them; the last two are broken."""
    return (("windows-1252", "93", "“"), ("windows-1251", "EFF0E8E2E5F2", "привет"), ("Shift_JIS", "93FA967B", "日本"),
            ("no-such-charset", "E9", "é"), ("utf-8", "C3A9FFEFBFBD", "é\ufffd"), ("utf-16le", None, ""))


@query("c11_charsets", "SELECT page_id, [" + ", ".join(f"'{meant}'" for _, _, meant in _coded()) + "][page_id % 6 + 1] || url AS v FROM pages")
def _(t: Tables):
    """Each page's url in one of six charsets; a stray byte ends the last one."""
    which = F.expr("CAST(page_id % 6 AS INT) + 1")
    names = F.array(*[F.lit(n) for n, _, _ in _coded()])
    front = F.array(*[F.unhex(F.lit(x or "")) for _, x, _ in _coded()])
    wide = F.concat(F.encode("url", "UTF-16LE"), F.unhex(F.lit("FF")))
    raw = F.when(which == 6, wide).otherwise(F.concat(F.element_at(front, which), F.encode("url", "UTF-8")))
    return t.pages.select("page_id", text.to_utf8(raw, F.element_at(names, which)).alias("v"))


_scalar("c12_to_latin", lambda: F.hex(text.to_latin(F.concat(F.lit("€Œ¤ж"), F.col("doc_id").cast("string")))),
        "'A4BC' || hex(doc_id::VARCHAR)", "documents", "doc_id")
_scalar("c13_hashed_uri", lambda: urls.hashed_uri("url"), "md5(url)")
_scalar("c14_host_url", lambda: urls.host_url("url"), "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/'")
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_scalar("c15_host_slug", lambda: urls.host_slug("url"), rf"regexp_replace({_HOST}, '\W+', '-', 'g')")
_scalar("c16_host_slug_www", lambda: urls.host_slug_www("url"),
        rf"regexp_replace(regexp_replace({_HOST}, '\W+', '-', 'g'), '^[^-]*', 'www')")
_scalar("c17_url_tld", lambda: urls.tld("url"), f"string_split({_HOST}, '.')[-1]")
_scalar("c18_keyword_query", lambda: urls.keyword_query("text", "http://video.example.com/q=", "&output=rss"),
        "'http://video.example.com/q=' || " + "replace(" * (len(urls.UNESCAPED) + 1)
        + "url_encode(replace(text, ' ', '+'))"
        + "".join(f", '%{ord(c):02X}', '{c if c != chr(39) else chr(39) * 2}')" for c in urls.UNESCAPED)
        + ", '%2A', '*') || '&output=rss'", "documents", "doc_id")
_scalar("c19_unwrap_js_link", lambda: text.unwrap_js_link(
    F.concat(F.lit("this.href=jlinkBuild('http://a', '"), "url", F.lit("', '/SortOrder/2');   return false;"))),
        "'http://a' || url || ''")
_scalar("c20_clean_field", lambda: text.clean_field(F.concat(F.lit("  12.\t"), "html", F.lit("  ")), drop_dots=True),
        "replace(regexp_replace(" + _sql_decode("'12.' || chr(9) || html") + r", '[\t\r\n]', '', 'g'), '.', '')")
_scalar("c21_class_weight", lambda: weights.class_weight("event_type", F.lit("article-footer")).cast("bigint"),
        "(CASE WHEN regexp_matches(event_type, '(?i)combx|comment|contact|foot|footer|footnote|link|media|meta|promo|related|scroll"
        "|shoutbox|sponsor|tags|widget|upcheck') THEN -25 ELSE 0 END + CASE WHEN regexp_matches(event_type, "
        "'(?i)articolo|contenuto|article|body|content|entry|hentry|page|pagination|post|text|data|datetime') THEN 25 ELSE 0 END)::BIGINT",
        "events", "event_id")
_scalar("c22_node_base_score", lambda: weights.node_base_score(
    F.expr("element_at(array('div','blockquote','form','th','p'), CAST(event_id % 5 AS INT) + 1)"), "event_type", F.lit(None).cast("string")),
        "[5, 3, -3, -5, 0][event_id % 5 + 1]::DOUBLE", "events", "event_id")
_scalar("c23_paragraph_score", lambda: text.paragraph_score("text"),
        "(1 + CASE WHEN rtrim(text, ',') = '' THEN 0 ELSE len(string_split(rtrim(text, ','), ',')) END + least(length(text) // 100, 3))::DOUBLE",
        "documents", "doc_id")
_scalar("c24_sentence_end", lambda: text.has_sentence_end("text"), r"regexp_matches(text, '(?m)\.( |$)')", "documents", "doc_id")

# dates rendered in six layouts, read back
_RENDER = ("CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MMM-d') "
           "WHEN 2 THEN date_format(o_orderdate, 'dd-MM-yyyy') WHEN 3 THEN date_format(o_orderdate, 'd MMMM yyyy') "
           "WHEN 4 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE date_format(o_orderdate, 'dd/MM/yy') END")


@query("d1_parse_date_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders")
def _(t: Tables):
    return dealt(t.orders, "o_orderkey").select("o_orderkey", F.date_format(dates.parse_date_text(F.expr(_RENDER)), "yyyy-MM-dd").alias("v"))


_scalar("d2_month_to_int", lambda: dates.month_to_int(F.date_format("o_orderdate", "MMMM")).cast("bigint"),
        "month(o_orderdate)::BIGINT", "orders", "o_orderkey")
_scalar("d3_two_digit_year", lambda: dates.full_year(F.year("o_orderdate") % 100).cast("bigint"),
        "year(o_orderdate)::BIGINT", "orders", "o_orderkey")
_scalar("d4_clamp_date", lambda: F.date_format(dates.clamp_date("o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")), "yyyy-MM-dd"),
        "strftime(least(o_orderdate, TIMESTAMP '1998-01-01'), '%Y-%m-%d')", "orders", "o_orderkey")
_scalar("d5_url_date", lambda: F.date_format(dates.url_date(F.concat(F.lit("http://a.example.com/"), F.expr(
    "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE date_format(o_orderdate, 'd-M-yyyy') END"), F.lit("/x"))), "yyyy-MM-dd"),
        "strftime(o_orderdate, '%Y-%m-%d')", "orders", "o_orderkey")


@query("d6_date_pattern_match", """
SELECT o_orderkey, 'eng' AS name, strftime(o_orderdate, '%-d %B %Y') AS txt FROM orders
UNION ALL SELECT o_orderkey, 'eng2', strftime(o_orderdate, '%-d %B %Y') FROM orders
UNION ALL SELECT o_orderkey, 'content7', strftime(o_orderdate, '%Y-%m-%d') FROM orders
UNION ALL SELECT o_orderkey, 'content4', strftime(o_orderdate, '%d/%m/%Y') FROM orders
UNION ALL SELECT o_orderkey, 'content5b', strftime(o_orderdate, '%d/%m/') || substr(strftime(o_orderdate, '%Y'), 1, 2) FROM orders WHERE year(o_orderdate) < 2000
UNION ALL SELECT o_orderkey, 'content5a', regexp_extract(strftime(o_orderdate, '%Y-%m-%d'), '((?:0[1-9]|[12][0-9]|3[01]|[0123]?[0-9])-(?:0[1-9]|1[012]|[0-9]?[0-9])-[019][0-9])', 1)
  FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '((?:0[1-9]|[12][0-9]|3[01]|[0123]?[0-9])-(?:0[1-9]|1[012]|[0-9]?[0-9])-[019][0-9])')
""")
def _(t: Tables):
    markup = F.concat(F.lit("<p>"), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("; "), F.date_format("o_orderdate", "dd/MM/yyyy"),
                      F.lit("; "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</p>"))
    return (dealt(t.orders, "o_orderkey").select("o_orderkey", F.explode(dates.date_matches(markup)).alias("m"))
            .select("o_orderkey", "m.name", F.col("m.text").alias("txt")))


@query("d7_date_pattern_match_10", """
SELECT o_orderkey, 'eng' AS name, strftime(o_orderdate, '%-d %B %Y') AS txt FROM orders
UNION ALL SELECT o_orderkey, 'eng2', strftime(o_orderdate, '%-d %B %Y') FROM orders
UNION ALL SELECT o_orderkey, 'content3', strftime(o_orderdate, '%Y.%m.%d') FROM orders WHERE month(o_orderdate) <> 10
UNION ALL SELECT o_orderkey, 'content6', regexp_extract(strftime(o_orderdate, '%Y.%m.%d'), '((?:0[1-9]|[12][0-9]|3[01]|[0123]?[0-9])[.](?:0[1-9]|1[012]|[0-9]?[0-9])[.][019][0-9])', 1)
  FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y.%m.%d'), '((?:0[1-9]|[12][0-9]|3[01]|[0123]?[0-9])[.](?:0[1-9]|1[012]|[0-9]?[0-9])[.][019][0-9])')
""")
def _(t: Tables):
    markup = F.concat(F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("; "), F.date_format("o_orderdate", "yyyy.MM.dd"))
    return (dealt(t.orders, "o_orderkey").select("o_orderkey", F.explode(dates.date_matches(markup, dates.MARKUP_PATTERNS_10)).alias("m"))
            .select("o_orderkey", "m.name", F.col("m.text").alias("txt")))


_scalar("d8_tag_weight", lambda: dates.tag_weight(
    F.expr("element_at(array('small','strong','span','p','div','td','meta','url'), CAST(event_id % 8 AS INT) + 1)")).cast("bigint"),
        "[4, 3, 2, 2, 3, 2, 4, 5][event_id % 8 + 1]::BIGINT", "events", "event_id")
_scalar("d9_to_italian_date", lambda: F.date_format(dates.to_italian_date(F.expr(
    "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'd/M/yyyy') ELSE date_format(o_orderdate, 'd/M/yy') END")), "yyyy-MM-dd"),
        "CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '20' || strftime(o_orderdate, '%y-%m-%d') END"
        .replace("strftime(o_orderdate, '%y-%m-%d')", "substr(strftime(o_orderdate, '%Y-%m-%d'), 3)"), "orders", "o_orderkey")


@query("d10_valid_calendar_text", """
SELECT o_orderkey, try_strptime('29-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || year(o_orderdate), '%d-%m-%Y') IS NOT NULL AS dmy,
  try_strptime('30-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || year(o_orderdate), '%d-%m-%Y') IS NOT NULL AS mdy,
  try_strptime('31-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || year(o_orderdate), '%d-%m-%Y') IS NOT NULL AS ymd,
  false AS mixed FROM orders""")
def _(t: Tables):
    m, y = F.expr("CAST(o_orderkey % 14 AS STRING)"), F.year("o_orderdate").cast("string")
    return t.orders.select(
        "o_orderkey",
        dates.valid_calendar_text(F.concat(F.lit("29-"), m, F.lit("-"), y), "dmy").alias("dmy"),
        dates.valid_calendar_text(F.concat(m, F.lit("/30/"), y), "mdy").alias("mdy"),
        dates.valid_calendar_text(F.concat(y, F.lit("."), m, F.lit(".31")), "ymd").alias("ymd"),
        dates.valid_calendar_text(F.concat(F.lit("10-"), m, F.lit("/"), y), "dmy").alias("mixed"))


_scalar("d11_pub_date_format", lambda: dates.pub_date_format(F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))),
        "strftime(o_orderdate, '%d-%m-%Y')", "orders", "o_orderkey")
_scalar("d12_updated_or_published", lambda: F.date_format(dates.updated_or_published(
    F.expr("CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP_NTZ '2001-01-01 00:00:00' END"), F.col("o_orderdate")), "yyyy-MM-dd"),
        "CASE WHEN o_orderkey % 2 = 0 THEN '2001-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END", "orders", "o_orderkey")

_scalar("l1_lang_from_attr", lambda: lang.lang_from_attr("html"), "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)")
_TLDS = "element_at(array('com','it','sm','uk','de','fr','es','edu','gov','ro','org'), CAST(page_id % 11 AS INT) + 1)"
_SQL_TLDS = "['com','it','sm','uk','de','fr','es','edu','gov','ro','org'][page_id % 11 + 1]"
_SQL_LABELS = "[NULL,'it','it','uk','de','fr','es','edu','gov','ro',NULL][page_id % 11 + 1]"
_scalar("l2_lang_from_tld", lambda: lang.lang_from_tld(F.concat(F.lit("http://site.example."), F.expr(_TLDS), F.lit("/a/"))), _SQL_LABELS)
_scalar("l3_lang_from_url", lambda: lang.lang_from_url(F.concat(F.lit("http://x."), F.expr(_TLDS), F.lit("/q"))),
        "[NULL,'it','sm','uk','de','fr','es','edu','gov','ro',NULL][page_id % 11 + 1]")
_scalar("l4_lang_cascade", lambda: lang.lang_cascade(
    F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("<html><body>x</body></html>"),
    F.concat(F.lit("http://x."), F.expr(_TLDS), F.lit("/q")), F.lit("italian")),
        "CASE WHEN page_id % 2 = 0 THEN regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) ELSE coalesce(" + _SQL_LABELS + ", 'Italian') END")
_scalar("l5_index_lang", lambda: lang.index_lang(F.expr("CASE WHEN page_id % 3 = 0 THEN 'en' END"), F.expr("CASE WHEN page_id % 3 = 1 THEN 'fr' END")),
        "CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'ot' END")
_scalar("m1_parse_evaluation", lambda: ratings.parse_evaluation(F.expr(
    "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN concat(event_id % 9, '-10') WHEN 1 THEN concat(event_id % 5, ',5-5') WHEN 2 THEN CAST(event_id % 6 AS STRING) "
    "WHEN 3 THEN concat(event_id, '-0') ELSE '' END")),
        "CASE event_id % 5 WHEN 0 THEN floor((event_id % 9) * 5 / 10) WHEN 1 THEN floor(((event_id % 5) + 0.5) * 5 / 5) "
        "WHEN 2 THEN event_id % 6 END::BIGINT".replace("END::BIGINT", "END").join(["(", ")::BIGINT"]), "events", "event_id")
_scalar("m2_changed_only_rating", lambda: ratings.changed(F.expr("CASE WHEN event_id % 3 > 0 THEN event_id % 3 END"), F.expr("event_id % 2")),
        "CASE WHEN (CASE WHEN event_id % 3 > 0 THEN event_id % 3 END) IS DISTINCT FROM event_id % 2 THEN event_id % 2 END", "events", "event_id")
_scalar("m3_margin_percent", lambda: F.round(lang.margin_percent(F.col("l_quantity"), F.col("l_discount")), 6),
        "round((l_quantity - l_discount) / ((l_quantity + l_discount) / 2.0) * 100, 6)", "lineitem", "l_orderkey")
_SQL_TAGS = "array_to_string(list_sort(['zed', lower(p_name), lower(p_brand)]), ', ')"
_scalar("k1_tags_normalise", lambda: ratings.tags_normalise(F.concat(F.lit(" Zed ,"), F.upper("p_name"), F.lit(","), "p_brand")), _SQL_TAGS, "part", "p_partkey")
_scalar("o3_tag_sort", lambda: F.array_join(ratings.tag_array(F.concat("p_type", F.lit(", "), "p_brand", F.lit(" ,"), "p_type", F.lit(","), "p_name")), "|"),
        "array_to_string(list_sort([lower(p_type), lower(p_brand), lower(p_type), lower(p_name)]), '|')", "part", "p_partkey")
_scalar("a9_tag_union", lambda: ratings.tag_union(F.lit("old, zed"), F.concat(F.lit(" Zed ,"), F.upper("p_name"), F.lit(","), "p_brand")),
        "'old,zed,' || array_to_string(list_sort([lower(p_name), lower(p_brand)]), ',')", "part", "p_partkey")
_scalar("u1_tag_array_union", lambda: ratings.tag_union(F.when(F.expr("p_partkey % 3 > 0"), F.lower("p_brand")), F.when(F.expr("p_partkey % 4 > 0"), F.col("p_brand"))),
        "CASE WHEN p_partkey % 3 > 0 THEN lower(p_brand) WHEN p_partkey % 4 > 0 THEN lower(p_brand) END", "part", "p_partkey")


@query("k2_tokenise", r"SELECT doc_id, pos, word FROM (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM "
                      r"(SELECT doc_id, [x for x in string_split_regex(lower(text), '\s+') if x <> ''] AS ws FROM documents))")
def _(t: Tables):
    from ..operators.language import tokens
    return tokens(t.documents).withColumn("pos", F.col("pos").cast("bigint"))


# URL filters
_MIXED = ("CASE CAST(page_id % 5 AS INT) WHEN 0 THEN url WHEN 1 THEN upper(substring(url, 1, 4)) || substring(url, 5) "
          "WHEN 2 THEN 'ftp://' || substring(url, 8) WHEN 3 THEN 'mailto:a@example.com' ELSE 'http://bad host/' || page_id END")
_SQL_MIXED = _MIXED.replace("CAST(page_id % 5 AS INT)", "page_id % 5").replace("substring", "substr")
for _name, _member in (("f1_valid_document", url_filters.valid_documents), ("f2_scheme_filter_http", url_filters.scheme_filter_http)):
    @query(_name, f"SELECT page_id, u AS url FROM (SELECT page_id, {_SQL_MIXED} AS u FROM pages) WHERE regexp_matches(u, '^(?i)https?://[^ ]*$')")
    def _(t: Tables, member=_member):
        return t.pages.select("page_id", F.expr(_MIXED).alias("url")).transform(member)


@query("f3_fix_relative_uri", r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://abs.example.com/x' WHEN 1 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example.com/y'
  WHEN 2 THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/root' WHEN 3 THEN regexp_extract(url, '^(.*)/[^/]*$', 1) || '/leaf'
  ELSE regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/up' END AS url FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS url FROM pages)""")
def _(t: Tables):
    ref = t.pages.withColumn("referring_uri", F.col("url")).withColumn("url", F.expr(
        "element_at(array('https://abs.example.com/x', '//cdn.example.com/y', '/root', 'leaf', '/a/../up'), CAST(page_id % 5 AS INT) + 1)"))
    return url_filters.fix_relative_uri(ref).select("page_id", "url")


@query("f4_normalize_uri", r"""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || CASE WHEN page_id % 3 = 0 THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) END AS url FROM pages""")
def _(t: Tables):
    host = urls.host("url")
    noisy = (F.when(F.col("page_id") % 3 == 0, F.concat(F.upper(urls.part("url", "PROTOCOL")), F.lit("://"), F.upper(host),
                    F.when(F.col("url").startswith("https"), ":443").otherwise(":80"), F.lit("#frag")))
             .otherwise(F.col("url")))
    return t.pages.select("page_id", noisy.alias("url")).transform(url_filters.normalize_uri)


@query("f5_hostname_filter", f"SELECT page_id, url FROM pages WHERE {_HOST} IN (SELECT h FROM (SELECT {_HOST} AS h, count(*) AS n FROM pages GROUP BY 1) WHERE n >= 3)")
def _(t: Tables):
    hosts = t.pages.groupBy(urls.host("url").alias("host")).count().filter("count >= 3")
    return t.pages.select("page_id", "url").transform(url_filters.hostname_filter(hosts))


@query("f6_url_inclusion_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '/en/|/fr/')")
def _(t: Tables):
    return t.pages.select("page_id", "url").transform(url_filters.url_inclusion_filter(["/en/", "/fr/"]))


@query("f7_url_exclusion_filter", r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, 'pills|[.]html$')")
def _(t: Tables):
    return t.pages.select("page_id", "url").transform(url_filters.url_exclusion_filter(["pills", "[.]html$"]))


_VISIT = "regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '^https?://(www[.]|m[.])?', 'http://')"


@query("f8_visited_url_filter", f"""SELECT min(page_id) AS page_id, u AS url FROM (SELECT page_id, {_VISIT} AS u FROM pages) GROUP BY u
  HAVING u NOT IN (SELECT {_VISIT} FROM pages WHERE regexp_matches(url, '/de/'))""")
def _(t: Tables):
    bare = t.pages.select("page_id", F.expr(_VISIT).alias("url"), F.col("url").alias("given"))
    history = bare.filter("given LIKE '%/de/%'").select("url")
    return bare.drop("given").transform(url_filters.visited_url_filter(history, "page_id")).select("page_id", "url")


_CHAIN_SQL = f"""SELECT min(page_id) AS page_id, u AS url FROM (SELECT page_id, CASE WHEN instr(substr(url, 9), '/') = 0 THEN regexp_extract(url, '^([^?#]*)', 1) || '/' ELSE regexp_extract(url, '^([^#]*)', 1) END AS u
  FROM pages WHERE regexp_matches(url, '^https?://')) WHERE regexp_matches(u, 'example[.](com|org)') AND NOT regexp_matches(u, 'pills') GROUP BY u"""
def _with_copies(t: Tables):
    return t.pages.select("page_id", "url").unionByName(t.pages.select(
        F.col("page_id") + 1000000000, F.concat("url", F.lit("#again"))).toDF("page_id", "url"))


@query("f9_filter_chain", _CHAIN_SQL)
def _(t: Tables):
    """The members one by one; a chain of any members in any order is a list."""
    members = [url_filters.scheme_filter_http, url_filters.normalize_uri, url_filters.url_exclusion_filter(["pills"]),
               url_filters.url_inclusion_filter(["example[.](com|org)"]), url_filters.visited_url_filter(None, "page_id")]
    return url_filters.filter_chain(_with_copies(t), members).select("page_id", "url")


@query("p2_filter_urls", _CHAIN_SQL)
def _(t: Tables):
    return jobs.filter_urls(_with_copies(t), "page_id", include=["example[.](com|org)"], exclude=["pills"]).select("page_id", "url")


_HOST_OF = "regexp_extract(u, '^[a-z]+://([^/?#]+)', 1)"


@query("p2_hosts_and_history", f"""WITH v AS (SELECT page_id, CASE WHEN instr(substr(url, 9), '/') = 0 THEN regexp_extract(url, '^([^?#]*)', 1) || '/' ELSE regexp_extract(url, '^([^#]*)', 1) END AS u
    FROM pages WHERE regexp_matches(url, '^https?://'))
  SELECT min(page_id) AS page_id, u AS url FROM v WHERE ends_with({_HOST_OF}, '.com') AND regexp_matches(u, 'example') AND NOT regexp_matches(u, 'pills')
    AND u NOT IN (SELECT u FROM v WHERE page_id % 3 = 0) GROUP BY u""")
def _(t: Tables):
    """The whole chain: hosts to include, patterns both ways, and the URLs that are in the index."""
    hosts = t.pages.select(urls.host("url").alias("host")).filter("host LIKE '%.com'")
    seen = t.pages.filter("page_id % 3 = 0").select(urls.normalize("url").alias("url"))
    return jobs.filter_urls(_with_copies(t), "page_id", include_hosts=hosts, include=["example"], exclude=["pills"], history=seen).select("page_id", "url")


@query("f9_dropped_by", f"""SELECT page_id, CASE WHEN NOT regexp_matches(u, '^(?i)https?://[^ ]*$') THEN 'scheme_filter_http'
  WHEN NOT regexp_matches(u, 'example') THEN 'url_inclusion_filter' WHEN regexp_matches(u, '/de/') THEN 'url_exclusion_filter' END AS dropped_by
  FROM (SELECT page_id, {_SQL_MIXED} AS u FROM pages)""")
def _(t: Tables):
    mixed = t.pages.select("page_id", F.expr(_MIXED).alias("url"))
    return url_filters.explain_drops(mixed, include=["example"], exclude=["/de/"]).select("page_id", "dropped_by")


@query("f26_search_result_links", f"""SELECT DISTINCT 'http://www.reviews.example.com' || regexp_replace(url, '^[a-z]+://[^/]*', '') || '/SortOrder/2' AS url FROM pages WHERE url LIKE '%/en/%'""")
def _(t: Tables):
    link = urls.search_result_link("url", "/en/", "www.reviews.example.com")
    return t.pages.select(link.alias("url")).dropna().dropDuplicates()


@query("p7_default_extract", f"""SELECT page_id, regexp_replace({_TITLE}, '<[^>]*>|\\n|\\t', '', 'g') AS title,
  trim({_BLOCK.format("regexp_replace(" + _BODY + ", '(?s)<!--.*?-->', '', 'g')")}) AS content FROM pages""")
def _(t: Tables):
    return jobs.default_extract(t.pages).select("page_id", "title", "content")


@query("flagship_host_profile", f"""SELECT host, lang, count(*) AS pages, sum(length(body))::BIGINT AS chars FROM (
  SELECT {_HOST} AS host, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, {_TITLE} AS title,
    trim({_BLOCK.format("regexp_replace(" + _BODY + ", '(?s)<!--.*?-->', '', 'g')")}) AS body
  FROM pages WHERE regexp_matches(url, '^https?://')) WHERE regexp_matches(title, '\\S') AND regexp_matches(body, '\\S') GROUP BY host, lang""")
def flagship(t: Tables):
    """Pages and text per host and language: valid URLs with a title and a body."""
    from ..operators.merge import is_fetched
    rows = jobs.default_extract(url_filters.valid_documents(t.pages)).filter(is_fetched())
    return (rows.groupBy(urls.host("url").alias("host"), lang.lang_from_attr("html").alias("lang"))
            .agg(F.count("*").alias("pages"), F.sum(F.length("content")).alias("chars")))
