"""URL expressions. A URL that does not parse gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col, is_blank


def part(url: Column | str, name: str) -> Column:
    return F.try_parse_url(_col(url), F.lit(name))


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, "PROTOCOL"))


def is_http(url: Column | str) -> Column:
    return F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def host(url: Column | str) -> Column:
    return part(url, "HOST")


def host_url(url: Column | str) -> Column:
    """``scheme://host/``, the key of a source."""
    return F.concat(part(url, "PROTOCOL"), F.lit("://"), host(url), F.lit("/"))


def host_slug(url: Column | str) -> Column:
    dashed = F.regexp_replace(host(url), "[^A-Za-z0-9_]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-+|-$", "")


def host_slug_www(url: Column | str) -> Column:
    """The slug with its first label replaced, for sub-domains without rules."""
    return F.regexp_replace(host_slug(url), "^[^-]*", "www")


def tld(url: Column | str) -> Column:
    return F.element_at(F.split(host(url), r"\."), -1)


def hashed_uri(url: Column | str) -> Column:
    return F.when(~is_blank(url), F.md5(_col(url)))


def key_id(text: Column | str) -> Column:
    """A 60-bit id computed from the key alone: the same in every run, on every executor."""
    return F.conv(F.substring(F.md5(_col(text)), 1, 15), 16, 10).cast("bigint")


def resolve(url: Column | str, referrer: Column | str) -> Column:
    """Absolute form of ``url`` as found on the page ``referrer``."""
    link, ref = F.trim(_col(url)), _col(referrer)
    ref_scheme, ref_auth = part(ref, "PROTOCOL"), part(ref, "AUTHORITY")
    root = F.concat(ref_scheme, F.lit("://"), ref_auth)
    folder = F.regexp_extract(F.coalesce(part(ref, "PATH"), F.lit("")), "^(.*)/[^/]*$", 1)
    bare_ref = F.regexp_replace(ref, "[#].*$", "")
    joined = F.concat(root, folder, F.lit("/"), link)
    out = (F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
           .when(ref.isNull(), link)
           .when(link.startswith("//"), F.concat(ref_scheme, F.lit(":"), link))
           .when(link.startswith("/"), F.concat(root, link))
           .when(link == "", bare_ref)
           .when(link.startswith("#"), F.concat(bare_ref, link))
           .when(link.startswith("?"), F.concat(F.regexp_replace(bare_ref, "[?].*$", ""), link))
           .otherwise(joined))
    return _drop_dot_segments(out)


def _drop_dot_segments(url: Column) -> Column:
    """Fold ``.`` and ``..`` path segments, as a stack over the path's segments."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    segments = F.split(F.substr(path, F.lit(2)), "/", -1)
    last = F.element_at(segments, -1)
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    closed = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    new_path = F.regexp_replace(F.concat(F.lit("/"), F.array_join(folded, "/"), closed), "^//$", "/")
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    tail = F.substr(url, F.length(head) + F.length(path) + 1)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(head, new_path, tail)).otherwise(url)


def normalize(url: Column | str) -> Column:
    """Lower-case scheme and host, no default port, no fragment, never an empty path."""
    u = F.trim(_col(url))
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?"
    sch = F.lower(F.regexp_extract(u, pattern, 1))
    auth = F.regexp_extract(u, pattern, 2)
    user = F.regexp_extract(auth, "^(.*@)", 1)
    hostport = F.lower(F.substr(auth, F.length(user) + 1))
    hostport = F.when(sch == "http", F.regexp_replace(hostport, ":(80)?$", "")) \
        .when(sch == "https", F.regexp_replace(hostport, ":(443)?$", "")).otherwise(hostport)
    path = F.regexp_extract(u, pattern, 3)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(u, pattern, 4)
    return F.when(u.rlike(pattern), F.concat(sch, F.lit("://"), user, hostport, path, query))


# Characters a search URL keeps as they are.
UNESCAPED = ";/?:@&=+$,[]!~'()"


def keyword_query(keyword: Column | str, before: str, after: str) -> Column:
    """A search URL: blanks of the keyword become ``+``, unsafe characters are escaped."""
    escaped = F.url_encode(F.replace(_col(keyword), F.lit(" "), F.lit("+")))
    for char in UNESCAPED:
        escaped = F.replace(escaped, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return F.concat(F.lit(before), escaped, F.lit(after))


def search_result_link(href: Column | str, marker: str, site_host: str) -> Column:
    """A listing link to the review list it stands for; null if it is something else."""
    link = _col(href)
    path = F.regexp_replace(link, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(link.contains(marker),
                  F.concat(F.lit(f"http://{site_host}"), path, F.lit("/SortOrder/2")))
