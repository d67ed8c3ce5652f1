"""One query for each operator, over its whole table; each digest column comes from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import (decontaminate, hard_negatives, language_id, line_dedup, merge_codec, multiset_hash, phrases, piece_codec, pieces, secrets_scan, sharding,
               simhash, token_counts, toxicity)
from .batches import crc_of_id, sha256_hex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql.strip()
        return function
    return add


@query("op6_multiset_fingerprints")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.compare_with_edited(table(spark, folder, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.pmod(crc_of_id(), F.lit(3)) == 1
    model = language_id.learn(docs.where(~held_out).select("doc_id", "lang", "text"))
    return language_id.identify(docs, model, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_shards")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_decontaminate", rf"""
  WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
  b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark),
  w AS (SELECT item, ws, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0),
  wins AS (SELECT DISTINCT item, m, array_to_string(ws[s:s + m - 1], ' ') AS win FROM w),
  places AS (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM wins) WHERE len(ws) >= m),
  found AS (SELECT a.r, a.p, a.m, wins.item FROM (SELECT r, p, m, array_to_string(ws[p:p + m - 1], ' ') AS win FROM places) a JOIN wins USING (m, win)),
  hit AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(p, p + m)) AS pos FROM found) GROUP BY r),
  items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
         sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
  FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return found.select(
        "row.doc_id", "found.n_words", "n_hit", F.size("found.items").cast("long").alias("n_items"),
        sha256_hex(F.concat_ws(",", "found.items")).alias("items_sha256"), "contaminated")


@query("op3_simhash_groups")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 0
    model = toxicity.learn(docs.where(~held_out), labels.where(~held_out))
    return toxicity.scored(docs, model, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "score").select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op4_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets_scan.find_secrets(table(spark, folder, "documents"), ["doc_id"])

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), sha256_hex(secrets_scan.joined("base")).alias("base_sha256"),
                        secrets_scan.joined("spans").alias("spans"))


@query("op7_line_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, folder, "documents"), ["doc_id"])
    return found.select("row.doc_id", "text", F.size("removed").alias("n_removed"),
                        F.aggregate("removed", F.lit(0), lambda n, r: n + r["length"]).alias("chars_removed"))


@query("op1_sentencepiece")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs, vocabulary = table(spark, folder, "documents"), pieces.load()
    found = piece_codec.there_and_back(docs, vocabulary, ["doc_id"])
    return found.select("row.doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted(table(spark, folder, "documents"), pieces.load(), ["doc_id"]).select(
        "row.doc_id", "n_pretokens", "n_tokens", "n_unigram")


@query("op11_hard_negatives", """
  WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pairs AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
  pos AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id NULLS LAST, b) <= 5),
  neg AS (SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
      row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.other_id NULLS LAST, n.b) AS rank
    FROM pos p JOIN pairs n ON n.a = p.a AND NOT n.same WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
  SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


@query("op12_merge_codec")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = merge_codec.there_and_back(table(spark, folder, "documents"), merge_codec.load(), ["doc_id"])
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_hex(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
                        sha256_hex(F.col("decoded")).alias("decoded_sha256"))


_PIECES = r"""SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents"""


@query("op13_phrases", rf"""
  WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM ({_PIECES})),
  s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p WHERE len(ws) > 0),
  g AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m AS size FROM s, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(ws)),
  c AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE size = 1 GROUP BY lang),
  f AS (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE f >= 30),
  cuts AS (SELECT lang, phrase, f AS a, size, ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
  cut AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ')),
  best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  subs AS (SELECT lang, f, ws, size, unnest(range(2, size)) AS m FROM f WHERE size > 2),
  places AS (SELECT lang, f, ws, m, unnest(range(1, size - m + 2)) AS s FROM subs),
  longer AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(f) AS f FROM places GROUP BY ALL),
  kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * b.a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
