"""Date expressions. ``as_of`` stands for "now" and is always passed in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col

# Italian and English month stems, January first.
MONTH_STEMS = ["gen|jan", "feb", "mar", "apr", "mag|may", "giu|jun",
               "lug|jul", "ago|aug", "set|sep", "ott|oct", "nov", "dic|dec"]

# The six layouts tried on a lower-case text, in order:
# (pattern, group of the year, of the month, of the day).
TEXT_LAYOUTS = [
    (r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})", 1, 2, 3),
    (r"(\d{4})\W+(\w+)\W+(\d{1,2})", 1, 2, 3),
    (r"(\d{1,2})\D+(\d{1,2})\D+(\d{4})", 3, 2, 1),
    (r"(\d{1,2})\D+(\d{1,2})\D+(\d{2})", 3, 2, 1),
    (r"(\d{1,2})\W+(\w+)\W+(\d{2,4})", 3, 2, 1),
    (r"(\d{1,2})\D+(\d{1,2})\D+(\d{2})", 3, 2, 1),
]

# Month names and number pieces used by the markup patterns below.
_EN = (r"(?:Jan(?:uary)?|Feb(?:ruary)?|Ma(?:r(?:ch)?|y)|Apr(?:il)?|Ju(?:ly?|ne?)|Aug(?:ust)?"
       r"|Oct(?:ober)?|(?:Sep(?=\b|t)t?|Nov|Dec)(?:ember)?)")
_EN_SHORT = r"(?:Jan|Feb|Ma(?:r(?:ch)?|y)|Apr|Ju(?:ly?|ne?)|Aug|Oct|(?:Sep(?=\b|t)t?|Nov|Dec))"
_IT = (r"(?:gen(?:naio)?|feb(?:braio)?|mar(?:zo)?|apr(?:ile)?|mag(?:gio)?|giu(?:gno)?|lug(?:lio)?"
       r"|ago(?:sto)?|set(?:tembre)?|ott(?:obre)?|nov(?:embre)?|dic(?:embre)?)")
_IT_LONG = (r"(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre"
            r"|novembre|dicembre)")
_DAY = "(?:0[1-9]|[12][0-9]|3[01]|[0123]?[0-9])"
_MONTH = "(?:0[1-9]|1[012]|[0-9]?[0-9])"
_YEAR = "(?:19|20)[0-9][0-9]"
_YY = "[019][0-9]"
_ENG = (r"(?:31(?! (?:Feb(?:ruary)?|Apr(?:il)?|June?|(?:Sep(?=\b|t)t?|Nov)(?:ember)?))"
        r"|(?:30|29)(?! Feb(?:ruary)?)"
        r"|29(?= Feb(?:ruary)(?:st|nd|th)?? (?:(?:1[6-9]|[2-9]\d)(?:0[48]|[2468][048]|[13579][26])"
        r"|(?:16|[2468][048]|[3579][26])00))"
        r"|0?[1-9]|1\d|2[0-8]) " + _EN + r" (?:1[6-9]|[2-9]\d)\d{2}")

# Fixed values: (name, pattern) in the order in which they are tried on one piece of markup.
MARKUP_PATTERNS = [
    ("eng", _ENG),
    ("eng2", rf"(?i)[0-9]?[0-9](?:st|th|nd|rd)?\s?{_EN} (?:{_YEAR}|[0-9]*[0-9])"),
    ("eng3", rf"(?i){_EN}\.?,?\s{_DAY}(?:st|th|nd|rd)?,?\s{_YEAR}"),
    ("content1", rf"(?i){_EN_SHORT}\s(?:0[1-9]|[12][0-9]|3[01])\s[012][0-9]:[0-5][0-9]:[0-5][0-9]"
                 rf"\s\+\d{{4}}\s{_YEAR}"),
    ("content2", rf"(?i){_IT},?\s[0-9]?[0-9](?:st|th|nd|rd)?,?\s{_YEAR}"),
    ("content3", rf"(?i)[0-9]?[0-9]\s{_IT}(?:&nbsp;)?\s?{_YEAR}"),
    ("content4", rf"{_DAY}/{_MONTH}/{_YEAR}"),
    ("content4a", rf"{_DAY}-{_MONTH}-{_YEAR}"),
    ("content4b", rf"{_DAY}\.{_MONTH}\.{_YEAR}"),
    ("content5", rf"{_DAY}\.{_MONTH}\.{_YY}"),
    ("content5a", rf"{_DAY}-{_MONTH}-{_YY}"),
    ("content5b", rf"{_DAY}/{_MONTH}/{_YY}"),
    ("content6", rf"(?i){_DAY}[\s-]?{_IT}[,\s-]?\s?(?:{_YEAR}|{_YY})\.?"),
    ("content7", rf"{_YEAR}-(?:0[1-9]|1[012])-{_DAY}"),
    ("content7a", rf"{_YEAR}/(?:0[1-9]|1[012])/{_DAY}"),
    ("content7b", rf"{_YEAR}\.(?:0[1-9]|1[012])\.{_DAY}"),
]

# The older list of ten; its year-first pattern knows no month 10.
MARKUP_PATTERNS_10 = [
    ("eng", _ENG),
    ("eng2", rf"(?i)[0-9]?[0-9](?:st|th|nd)?\s?{_EN} (?:{_YEAR}|[0-9]*[0-9])"),
    ("eng3", rf"(?i){_EN},?\s{_DAY}(?:st|th|nd)?,?\s{_YEAR}"),
    ("content1", dict(MARKUP_PATTERNS)["content1"]),
    ("content2", rf"(?i){_IT}\s[0-9]?[0-9],?\s{_YEAR}"),
    ("content3", rf"{_YEAR}[-/.](?:0[1-9]|1[12])[-/.](?:0[1-9]|[12][0-9]|3[0-1])"),
    ("content4", rf"(?i)[0-9]?[0-9]\s{_IT_LONG}(?:&nbsp;)?\s?{_YEAR}"),
    ("content5", rf"{_DAY}[-/.]{_MONTH}[-/.]{_YEAR}"),
    ("content6", rf"{_DAY}[-/.]{_MONTH}[-/.]{_YY}"),
    ("content7", dict(MARKUP_PATTERNS)["content6"]),
]

# Tags searched for dates, most important first, with their weight.
DATE_TAGS = [("small", 4), ("strong", 3), ("span", 2), ("p", 2), ("div", 3), ("td", 2), ("meta", 4)]

# Fixed value: weight of a date found in the URL.
URL_WEIGHT = 5

# Fixed value: the date in the address of a well-known namespace, not a publish date.
NAMESPACE_DATE = "1999-02-22"

# Dates in a URL, year first or year last.
URL_YEAR_FIRST = rf"{_YEAR}[/-][0-9]?[0-9][/-][0-9]?[0-9]"
URL_YEAR_LAST = rf"[0-9]?[0-9][/-][0-9]?[0-9][/-]{_YEAR}"


def month_to_int(word: Column | str) -> Column:
    """A month given in digits or by name; null if it is neither."""
    text = F.lower(_col(word))
    leading = F.coalesce(F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.lit(0))
    out = F.when(text.rlike(r"\d"), leading)
    for number, stem in enumerate(MONTH_STEMS, start=1):
        out = out.when(text.rlike(stem), number)
    return out


def full_year(year: Column) -> Column:
    return (F.when(year < 69, year + 2000).when(year < 139, year + 1900).otherwise(year))


def _parts(text: Column, pattern: str, y: int, m: int, d: int) -> Column:
    """[year, month, day] texts of the first match; null without one."""
    match = F.regexp_substr(text, F.lit(pattern))
    return F.split(F.regexp_replace(match, pattern, f"${y}\u0001${m}\u0001${d}"), "\u0001")


def _date(parts: Column) -> Column:
    year, month, day = (F.get(parts, F.lit(i)) for i in range(3))
    return F.try_make_timestamp_ntz(full_year(year.try_cast("int")), month_to_int(month),
                                    day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0))


def _first_real(readings: list[Column]) -> Column:
    """The first reading that is a real date."""
    made = F.transform(F.array(*readings), _date)
    return F.get(F.filter(made, lambda d: d.isNotNull()), F.lit(0))


def parse_date_text(text: Column | str) -> Column:
    """First of the six layouts that gives a real date; null if none does."""
    low = F.lower(_col(text))
    return _first_real([_parts(low, *layout) for layout in TEXT_LAYOUTS])


# For strict reading, which part comes first in each markup pattern.
_MONTH_FIRST = {"eng3", "content2"}
_YEAR_FIRST = {"content7", "content7a", "content7b"}


def parse_matched(name: Column | str, text: Column | str) -> Column:
    """Strict reading: the layout is the one of the pattern that matched."""
    low, which = F.lower(_col(text)), _col(name)
    month_first = _parts(low, r"([a-z]+)[.,]*\s+(\d{1,2})\D+(\d{4})", 3, 1, 2)
    stamp = _parts(low, r"([a-z]+)\s(\d{1,2})\s[\d:]+\s\+\d{4}\s(\d{4})", 3, 1, 2)
    year_first = _parts(low, r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 1, 2, 3)
    day_word = _parts(low, r"(\d{1,2})(?:st|th|nd|rd)?[\s-]*([a-z]+)(?:&nbsp;)?[,\s-]*(\d{2,4})", 3, 2, 1)
    day_first = _parts(low, r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})", 3, 2, 1)
    return _first_real([F.when(which.isin(*_MONTH_FIRST), month_first)
                        .when(which == "content1", stamp)
                        .when(which.isin(*_YEAR_FIRST), year_first)
                        .when(which.isin("eng", "eng2", "content3", "content6"), day_word)
                        .otherwise(day_first)])


def clamp_date(date: Column | str, as_of: Column) -> Column:
    d = _col(date)
    return F.when(d.isNull() | (d > as_of), as_of).otherwise(d)


def url_date_text(url: Column | str) -> Column:
    first = F.regexp_extract(_col(url), f"({URL_YEAR_FIRST})", 1)
    last = F.regexp_extract(_col(url), f"({URL_YEAR_LAST})", 1)
    return F.when(first != "", first).when(last != "", last)


def url_date(url: Column | str) -> Column:
    return parse_date_text(url_date_text(url))


def date_matches(markup: Column | str, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Every pattern that matches gives (order, name, first match)."""
    text = _col(markup)
    found = []
    for order, (name, pattern) in enumerate(patterns or MARKUP_PATTERNS):
        match = F.regexp_substr(text, F.lit(pattern))
        if "(?:&nbsp;)?" in pattern:
            match = F.replace(match, F.lit("&nbsp;"), F.lit(""))
        found.append(F.struct(F.lit(order).alias("ord"), F.lit(name).alias("name"),
                              match.alias("text")))
    return F.filter(F.array(*found), lambda m: m["text"].isNotNull())


def tag_weight(tag: Column | str) -> Column:
    out = F.when(_col(tag) == "url", URL_WEIGHT)
    for name, weight in DATE_TAGS:
        out = out.when(_col(tag) == name, weight)
    return out


def tag_order(tag: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name, _ in DATE_TAGS]), _col(tag))


def to_italian_date(text: Column | str, separator: str = "/") -> Column:
    """``d/m/y``; a two-digit year is in this century. Null unless there are three parts."""
    fields = F.split(_col(text), f"[{separator}]", -1)
    year = F.get(fields, F.lit(2))
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    date = F.try_make_timestamp_ntz(year.try_cast("int"), F.get(fields, F.lit(1)).try_cast("int"),
                                    F.get(fields, F.lit(0)).try_cast("int"),
                                    F.lit(0), F.lit(0), F.lit(0))
    return F.when(F.size(fields) == 3, date).cast("date")


def valid_calendar_text(text: Column | str, layout: str) -> Column:
    """Is the whole text a real date in ``dmy``, ``mdy`` or ``ymd``, same separator twice?"""
    t = _col(text)
    if layout == "ymd":
        pattern = r"^(\d{4})([-/.])(0?\d|1[012])\2([012]?\d|3[01])$"
        y, m, d = (F.regexp_extract(t, pattern, i) for i in (1, 3, 4))
    else:
        pattern = r"^(\d{1,2})([-/.])(\d{1,2})\2((?:1[6-9]|[2-9]\d)?\d{2})$"
        a, b, y = (F.regexp_extract(t, pattern, i) for i in (1, 3, 4))
        d, m = (a, b) if layout == "dmy" else (b, a)
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).try_cast("int")
    real = F.try_make_timestamp_ntz(year, m.try_cast("int"), d.try_cast("int"),
                                    F.lit(0), F.lit(0), F.lit(0))
    return F.coalesce(t.rlike(pattern) & real.isNotNull(), F.lit(False))


def pub_date_format(text: Column | str) -> Column:
    """A feed date (day, month name, year somewhere in the text) as ``dd-MM-yyyy``."""
    t = F.lower(_col(text))
    day_first = _parts(t, r"(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})", 3, 2, 1)
    year_first = _parts(t, r"(\d{4})-(\d{1,2})-(\d{1,2})", 1, 2, 3)
    return F.date_format(_first_real([day_first, year_first]), "dd-MM-yyyy")


def updated_or_published(updated: Column | str, published: Column | str) -> Column:
    return F.coalesce(_col(updated), _col(published))
