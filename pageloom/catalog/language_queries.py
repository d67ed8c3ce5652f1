"""Queries for lexicons, Bloom filters and language detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bloom, language
from ..plans import jobs
from ..session import dealt, fresh_path, stored
from .registry import query
from .views import Tables

LANGUAGES = ["en", "fr", "de", "es"]
# A report of the most frequent words of each language; the ranking is the feature of that report alone.
TOP_WORDS = 300

_TOKENS = (r"ws AS (SELECT doc_id, lang, [x for x in string_split_regex(lower(text), '\s+') if x <> ''] AS ws FROM documents), "
           "toks AS (SELECT doc_id, lang, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM ws), "
           "cnt AS (SELECT lang, word, count(*) AS n FROM toks GROUP BY lang, word), "
           "lex AS (SELECT * FROM cnt)")
_HITS = _TOKENS + ", hits AS (SELECT t.doc_id, t.pos, l.lang FROM toks t JOIN lex l USING (word))"
_COUNTS = _HITS + ", counts AS (SELECT doc_id, lang, count(*) AS hits FROM hits GROUP BY doc_id, lang)"
_BEST = (", best AS (SELECT doc_id, lang, hits, coalesce(nxt, 0) AS second_hits, "
         "(hits - coalesce(nxt, 0)) / ((hits + coalesce(nxt, 0)) / 2.0) * 100 AS margin FROM ("
         "SELECT *, lead(hits) OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) AS nxt, "
         "row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) AS r FROM counts) WHERE r = 1)")
_BITS = (_TOKENS + ", u AS (SELECT DISTINCT lang, word, sha1(word) AS s FROM lex), bits AS ("
         + " UNION ".join(
             "SELECT lang, ('0x' || " + " || ".join(f"substr(s, {start + 2 * i}, 2)" for i in (3, 2, 1, 0))
             + ")::BIGINT % 2000000 + 1 AS bit FROM u" for start in (1, 9)) + ")")
_TOK_BITS = (", tb AS (SELECT word, " + ", ".join(
    "('0x' || " + " || ".join(f"substr(sha1(word), {start + 2 * i}, 2)" for i in (3, 2, 1, 0)) + f")::BIGINT % 2000000 + 1 AS b{start}"
    for start in (1, 9)) + " FROM (SELECT DISTINCT word FROM toks)), "
    "mem AS (SELECT tb.word, x.lang FROM tb JOIN bits x ON x.bit = tb.b1 JOIN bits y ON y.bit = tb.b9 AND y.lang = x.lang), "
    "hits AS (SELECT t.doc_id, t.pos, m.lang FROM toks t JOIN mem m USING (word))")


def lexicon(t: Tables):
    """All words of all languages, written once."""
    return stored(language.build_lexicon(dealt(t.documents, "doc_id")), "lexicon")


@query("a13_lexicon", f"WITH {_TOKENS} SELECT lang, word, n FROM cnt")
def _(t: Tables):
    return language.build_lexicon(t.documents)


@query("a13_lexicon_top", f"WITH {_TOKENS} SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM cnt) WHERE r <= {TOP_WORDS}")
def _(t: Tables):
    return language.build_lexicon(t.documents, top_k=TOP_WORDS)


@query("j13_token_lexicon", f"WITH {_HITS} SELECT doc_id, pos, string_agg(lang, ',' ORDER BY lang) AS langs FROM hits GROUP BY doc_id, pos")
def _(t: Tables):
    hits = language.lexicon_hits(language.tokens(dealt(t.documents, "doc_id")), lexicon(t))
    return hits.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.array_join("langs", ",").alias("langs"))


@query("a7_language_hits", f"WITH {_COUNTS} SELECT doc_id, lang, hits FROM counts")
def _(t: Tables):
    return language.hit_counts(language.lexicon_hits(language.tokens(dealt(t.documents, "doc_id")), lexicon(t)))


@query("w5_top_margin", f"WITH {_COUNTS} {_BEST} SELECT doc_id, CASE WHEN margin > 6 THEN lang ELSE '' END AS detected, hits, second_hits, round(margin, 6) AS margin FROM best")
def _(t: Tables):
    counts = language.hit_counts(language.lexicon_hits(language.tokens(dealt(t.documents, "doc_id")), lexicon(t)))
    return language.top_by_margin(counts).withColumn("margin", F.round("margin", 6))


@query("o2_language_sort", f"WITH {_COUNTS} SELECT doc_id, string_agg(lang || ':' || hits, ' ' ORDER BY hits DESC, lang) AS ranking FROM counts GROUP BY doc_id")
def _(t: Tables):
    counts = language.hit_counts(language.lexicon_hits(language.tokens(dealt(t.documents, "doc_id")), lexicon(t)))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("hits")).alias("k"), "lang", "hits")))
    return counts.groupBy("doc_id").agg(ranked.alias("_r")).select("doc_id", F.array_join(
        F.transform("_r", lambda r: F.concat(r["lang"], F.lit(":"), r["hits"].cast("string"))), " ").alias("ranking"))


_DETECTED = ("SELECT d.doc_id, coalesce(CASE WHEN margin > 6 THEN b.lang ELSE '' END, '') AS detected, coalesce(hits, 0) AS hits "
             "FROM documents d LEFT JOIN best b USING (doc_id)")


@query("p10_detect_language", f"WITH {_COUNTS} {_BEST} {_DETECTED}")
def _(t: Tables):
    return jobs.detect_language(dealt(t.documents, "doc_id"), lexicon(t))


@query("p13_language_by_text", f"WITH {_COUNTS} {_BEST} SELECT 'http://pages.example.com/' || doc_id AS url, 'Day, Month, Hour' AS found, "
       "nullif(coalesce(CASE WHEN margin > 6 THEN b.lang ELSE '' END, ''), '') AS lang FROM documents d LEFT JOIN best b USING (doc_id)")
def _(t: Tables):
    """Pages without a language in markup or host: the words decide."""
    from .views import as_of
    url = F.concat(F.lit("http://pages.example.com/"), "doc_id")
    markup = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pages = t.documents.select(F.col("doc_id").alias("page_id"), url.alias("url"), F.concat(F.lit("<html><body><em>"), markup, F.lit("</em></body></html>")).alias("html"))
    return jobs.extract_report(pages.select("url"), pages, as_of(), lexicon(t))


_EXIT = (", run AS (SELECT t.doc_id, t.pos, " + ", ".join(
    f"sum(CASE WHEN list_contains(coalesce(h.langs, []), '{x}') THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS n_{x}" for x in LANGUAGES)
    + " FROM toks t LEFT JOIN (SELECT doc_id, pos, list(lang) AS langs FROM hits GROUP BY doc_id, pos) h ON h.doc_id = t.doc_id AND h.pos = t.pos), "
    "rk AS (SELECT *, list_reverse_sort([" + ", ".join(f"n_{x}" for x in LANGUAGES) + "]) AS s FROM run), "
    "stop AS (SELECT doc_id, coalesce(min(pos) FILTER (WHERE pos % 4 = 0 AND s[2] > 0 AND s[1] > 4 AND (s[1] > s[2] * 2 OR s[1] - s[2] > 25)), max(pos)) AS stop_at FROM rk GROUP BY doc_id), "
    "counts AS (" + " UNION ALL ".join(
        f"SELECT r.doc_id, '{x}' AS lang, n_{x}::BIGINT AS hits, stop_at FROM rk r JOIN stop s ON s.doc_id = r.doc_id AND r.pos = s.stop_at WHERE n_{x} > 0" for x in LANGUAGES) + ")")


@query("w6_early_exit", f"WITH {_HITS} {_EXIT} SELECT doc_id, lang, hits, stop_at::BIGINT AS words_read FROM counts")
def _(t: Tables):
    seen = language.lexicon_hits(language.tokens(dealt(t.documents, "doc_id")), lexicon(t), "left")
    out = language.early_exit_counts(seen, LANGUAGES)
    return out.withColumn("words_read", F.col("words_read").cast("bigint"))


@query("p10_detect_language_early", f"WITH {_HITS} {_EXIT} {_BEST} {_DETECTED}")
def _(t: Tables):
    return jobs.detect_language(dealt(t.documents, "doc_id"), lexicon(t), languages=LANGUAGES)


@query("a10_bloom_build", f"WITH {_BITS} SELECT lang, ((bit - 1) // 32768 + 1)::BIGINT AS bucket, count(*) AS n FROM bits GROUP BY ALL")
def _(t: Tables):
    return bloom.build(lexicon(t)).select("lang", "bucket", F.bitmap_count("bitmap").alias("n"))


_OWN = ["length(word) * 37", "ascii(word) * 101", "length(word) * 5 + ascii(word)"]


def _own_hasher(n: int):
    """A hasher of ``n`` positions."""
    return lambda w: [x.cast("bigint") for x in (F.length(w) * 37, F.ascii(w) * 101, F.length(w) * 5 + F.ascii(w))[:n]]


@query("x5_custom_hasher", f"WITH {_TOKENS}, w AS (SELECT DISTINCT word FROM cnt) " + " UNION ALL ".join(
    f"SELECT {n}::BIGINT AS positions, lang, count(*) AS known FROM (SELECT w.word, l.lang FROM w, (SELECT lang, "
    + ", ".join(f"list(DISTINCT ({e})::BIGINT % 1024) AS b{i}" for i, e in enumerate(_OWN[:n]))
    + " FROM cnt GROUP BY lang) l WHERE " + " AND ".join(
        "(" + " OR ".join(f"list_contains(b{j}, ({e})::BIGINT % 1024)" for j in range(n)) + ")" for e in _OWN[:n])
    + ") GROUP BY lang" for n in (1, 2, 3)))
def _(t: Tables):
    """Filters of one, two and three positions, built and probed with all words."""
    known = lexicon(t)
    words = known.select("word").distinct()
    found = [bloom.known_words(words, bloom.build(known, _own_hasher(n), 1024), _own_hasher(n), 1024)
             .select(F.lit(n).cast("bigint").alias("positions"), F.explode("langs").alias("lang")) for n in (1, 2, 3)]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("positions", "lang").agg(F.count("*").alias("known"))


@query("a11_bits_set", f"WITH {_BITS} SELECT lang, count(*) AS bits_set FROM bits GROUP BY lang")
def _(t: Tables):
    return bloom.bits_set(bloom.build(lexicon(t)))


@query("a12_filter_overlap", f"""WITH {_BITS}, n AS (SELECT lang, count(*) AS c FROM bits GROUP BY lang)
  SELECT a.lang AS lang1, b.lang AS lang2, any_value(n1.c) AS bits1, any_value(n2.c) AS bits2, count(*) AS common_bits
  FROM bits a JOIN bits b ON a.bit = b.bit AND a.lang < b.lang JOIN n n1 ON n1.lang = a.lang JOIN n n2 ON n2.lang = b.lang GROUP BY a.lang, b.lang""")
def _(t: Tables):
    return bloom.overlap(bloom.build(lexicon(t)))


@query("s13_bloom_save_load", f"WITH {_BITS} SELECT lang, count(*) AS bits_set FROM bits GROUP BY lang")
def _(t: Tables):
    path = fresh_path(t.spark, "bloom")
    bloom.save(bloom.build(lexicon(t)), path)
    return bloom.bits_set(bloom.load(t.spark, path))


@query("j14_token_bloom", f"WITH {_BITS} {_TOK_BITS} SELECT doc_id, pos, string_agg(lang, ',' ORDER BY lang) AS langs FROM hits GROUP BY doc_id, pos")
def _(t: Tables):
    filters = stored(bloom.build(lexicon(t)), "bloom")
    hits = bloom.word_hits(language.tokens(dealt(t.documents, "doc_id")), filters)
    return hits.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.array_join("langs", ",").alias("langs"))


@query("p10_detect_language_bloom", f"WITH {_BITS} {_TOK_BITS}, counts AS (SELECT doc_id, lang, count(*) AS hits FROM hits GROUP BY doc_id, lang) {_BEST} {_DETECTED}")
def _(t: Tables):
    return jobs.detect_language(dealt(t.documents, "doc_id"), filters=stored(bloom.build(lexicon(t)), "bloom"))
