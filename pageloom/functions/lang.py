"""Language expressions that need no word statistics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col
from .urls import tld

# Top-level domains that tell a language, in the order tried.
TLD_LANG = [("it", ["it", "sm"]), ("uk", ["uk"]), ("de", ["de"]), ("fr", ["fr"]), ("es", ["es"]),
            ("edu", ["edu"]), ("gov", ["gov"]), ("ro", ["ro"])]

# The older form, looked for anywhere in the URL; the last match wins.
URL_LANG = ["it/|it\\.|sm/", "uk/|uk\\.", "de/|de\\.", "fr/|fr\\.", "es/|es\\.", "edu/", "gov/", "ro/"]


def _attribute(html: Column, name: str) -> Column:
    """An attribute of the root element, read from its start tag."""
    start_tag = F.regexp_extract(html, r"(?is)^(?:\s|<!--.*?-->|<[!?][^>]*>)*<[a-z][^\s>]*(\s[^>]*)>", 1)
    value = F.regexp_extract(start_tag, rf"(?i)\s{name}\s*=\s*[\"']?([^\"'\s>]*)", 1)
    return F.when(value != "", value)


def lang_from_attr(html: Column | str) -> Column:
    """``xml:lang`` of the root element if set, else its ``lang``."""
    return F.coalesce(_attribute(_col(html), "xml:lang"), _attribute(_col(html), "lang"))


def lang_from_tld(url: Column | str) -> Column:
    last = F.lower(tld(url))
    out = None
    for label, names in TLD_LANG:
        out = F.when(last.isin(*names), label) if out is None else out.when(last.isin(*names), label)
    return out


def lang_from_url(url: Column | str) -> Column:
    found = [F.regexp_substr(_col(url), F.lit(p)) for p in reversed(URL_LANG)]
    return F.regexp_replace(F.coalesce(*found), "/$", "")


def margin_percent(first: Column, second: Column) -> Column:
    """Gap of two counts as a percentage of their mean."""
    return F.try_divide(first - second, (first + second) / F.lit(2.0)) * 100


def lang_cascade(html: Column | str, url: Column | str, detected: Column | str) -> Column:
    return F.coalesce(lang_from_attr(html), lang_from_tld(url), F.initcap(_col(detected)))


def index_lang(source_lang: Column | str, page_lang: Column | str) -> Column:
    return F.coalesce(_col(source_lang), _col(page_lang), F.lit("ot"))
