"""String clean-up expressions."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from . import charsets

# The eight code points where ISO-8859-15 differs from ISO-8859-1.
LATIN9_CHARS = "€ŠšŽžŒœŸ"
LATIN9_SLOTS = "¤¦¨´¸¼½¾"

# Pieces deleted from the click handler of a review link, in this order.
JS_LINK_PIECES = ["', '", "this.href=jlinkBuild('", "/SortOrder/2');   return false;"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# What ``\\s`` matches, and the line ends beyond it that ``$`` may stand before.
SPACES = " \t\n\x0b\f\r"
OTHER_LINE_ENDS = "\u0085\u2028\u2029"


def strip_ws(c: Column | str) -> Column:
    """Trim all whitespace, not only blanks; whitespace before a line end that isn't whitespace itself, too.

    Only texts with such a line end go by a pattern, as that is tried at every character.
    """
    def bare(x: Column) -> Column:
        odd = F.lit(False)
        for end in OTHER_LINE_ENDS:
            odd = odd | x.endswith(end)
        return F.when(odd, F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.btrim(x, F.lit(SPACES)))
    # bound once, as an expression that stands twice is worked out twice
    return F.get(F.transform(F.array(_col(c)), bare), F.lit(0))


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(_col(c), F.lit("")).rlike(r"\S")


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "</?[^>]+?>", "")


def strip_ct_nl(c: Column | str) -> Column:
    out = _col(c)
    for char in "\t\r\n":
        # a text without it is left as it is; translate makes every text anew, character by character
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def strip_all(c: Column | str) -> Column:
    return strip_ws(strip_ct_nl(strip_tags(c)))


def strip_comments(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "(?s)<!--.*?-->", "")


def strip_html_block(c: Column | str) -> Column:
    """Drop script and style blocks, then tags, then squeeze whitespace."""
    no_blocks = F.regexp_replace(
        _col(c), r"(?s)<(?:script|style).*?>.*?</(?:script|style).*?>", "")
    return F.regexp_replace(F.regexp_replace(no_blocks, "(?s)<.+?>", ""), r"\s+", " ")


def clean_title(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"<[^>]*>|\n|\t", "")


def article_text_clean(c: Column | str) -> Column:
    no_breaks = F.regexp_replace(_col(c), r"[\r\n\f]+", "")
    return strip_tags(F.replace(F.regexp_replace(no_breaks, "[\t ]+", " "),
                                F.lit("&nbsp;"), F.lit(" ")))


def escape_markup(c: Column | str) -> Column:
    """Plain text to the markup a serializer gives for it."""
    out = _col(c)
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def squeeze_ws(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"[\r\n]", " "), r"\s{2,}", " ")


@lru_cache(maxsize=1)
def _named_entities() -> dict[str, str]:
    table = {name: chr(code) for name, code in name2codepoint.items()}
    table["apos"] = "'"
    return table


def _entity_map(names: dict[str, str]) -> Column:
    # one literal, folded by the optimizer, in place of a call per entry
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _code_point(body: Column) -> Column:
    """Text of a numeric reference body such as ``#233`` or ``#xE9``; null if invalid."""
    is_hex = F.lower(F.substring(body, 2, 1)) == "x"
    digits = F.when(is_hex, F.substring(body, 3, 8)) \
        .otherwise(F.substring(body, 2, 8))
    number = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def _decode(c: Column, lookup: Column, numeric: bool) -> Column:
    """One left-to-right pass: what a reference decodes to is never decoded again."""
    def piece(p: Column) -> Column:
        body = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        char = F.try_element_at(lookup, body)
        if numeric:
            char = F.when(body.startswith("#"), _code_point(body)).otherwise(char)
        rest = F.substr(p, F.length(body) + 2)
        return F.when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), p))

    parts = F.split(c, "&", -1)
    tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)
    decoded = F.concat(F.element_at(parts, 1), F.array_join(tail, ""))
    return F.when(c.contains("&"), decoded).otherwise(c)


def decode_entities(c: Column | str) -> Column:
    """HTML character references, named and numeric, to characters."""
    return _decode(_col(c), _entity_map(_named_entities()), numeric=True)


def unescape_href(c: Column | str) -> Column:
    """The five basic references and numeric ones, for link targets."""
    # The basic references.
    basic = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
    return _decode(_col(c), _entity_map(basic), numeric=True)


def to_utf8(body: Column | str, charset: Column | str) -> Column:
    """Bytes to text by the stated charset, else Latin-1; bad bytes are dropped, whatever the charset.

    Sound UTF-8, ASCII, Latin-1 and Latin-9 are read by Spark. All else goes to one Arrow function,
    which gets null for the rows that don't need it.
    """
    raw, name = _col(body), F.upper(F.trim(_col(charset)))
    as_text = raw.cast("string")
    utf8 = name.isin("UTF-8", "UTF8") & F.is_valid_utf8(as_text)
    ascii_only = name.isin("US-ASCII", "ASCII")
    latin1 = name.isNull() | name.isin("ISO-8859-1", "LATIN1", "")
    latin9 = name.isin("ISO-8859-15", "LATIN9")
    spark_reads = F.coalesce(utf8 | ascii_only | latin1 | latin9, F.lit(False))
    plain = F.decode(raw, "ISO-8859-1")
    return (F.when(utf8, as_text)
            .when(ascii_only, F.regexp_replace(plain, r"[^\x00-\x7f]", ""))
            .when(latin9, F.translate(plain, LATIN9_SLOTS, LATIN9_CHARS))
            .when(latin1, plain)
            .otherwise(charsets.decoded(F.when(~spark_reads, raw), name)))


def to_latin(c: Column | str) -> Column:
    """Text to ISO-8859-15 bytes; characters it lacks are dropped."""
    kept = F.regexp_replace(_col(c), f"[^\\x00-\\u00ff{LATIN9_CHARS}]|[{LATIN9_SLOTS}]", "")
    return F.encode(F.translate(kept, LATIN9_CHARS, LATIN9_SLOTS), "ISO-8859-1")


def unwrap_js_link(c: Column | str) -> Column:
    out = _col(c)
    for fragment in JS_LINK_PIECES:
        out = F.replace(out, F.lit(fragment), F.lit(""))
    return out


def clean_field(c: Column | str, drop_dots: bool = False) -> Column:
    out = strip_ct_nl(decode_entities(strip_ws(c)))
    return F.replace(out, F.lit("."), F.lit("")) if drop_dots else out


def has_sentence_end(c: Column | str) -> Column:
    return _col(c).rlike(r"(?m)\.( |$)")


def comma_fields(c: Column | str) -> Column:
    """Number of comma-separated fields, trailing empty ones not counted."""
    bare = F.rtrim(_col(c), F.lit(","))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, ",", -1)))


def paragraph_score(c: Column | str) -> Column:
    text = _col(c)
    bonus = F.least(F.floor(F.length(text) / 100), F.lit(3))
    return (1 + comma_fields(text) + bonus).cast("double")


def words(c: Column | str) -> Column:
    """Lower-case words, split at whitespace; no empty words."""
    return F.filter(F.split(F.lower(_col(c)), r"\s+"), lambda w: w != "")
