"""Bloom filters as bitmap tables: one row per (lang, bucket of 32768 bits)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .language import heavy_words

# Fixed value: bits per filter.
WIDTH = 2_000_000

# One column for each position that a word sets.
Hasher = Callable[[Column], list[Column]]


def sha1_pair(word: Column) -> list[Column]:
    """The first two 32-bit little-endian words of SHA-1 of the trimmed, lower-case word."""
    digest = F.sha1(F.lower(F.trim(word)))

    def little_endian(start: int) -> Column:
        pairs = [F.substring(digest, start + 2 * i, 2) for i in (3, 2, 1, 0)]
        return F.conv(F.concat(*pairs), 16, 10).cast("bigint")
    return [little_endian(1), little_endian(9)]


def bit_positions(word: Column | str, hasher: Hasher = sha1_pair, width: int = WIDTH) -> Column:
    """Bit numbers, counted from 1, that a word sets."""
    column = F.col(word) if isinstance(word, str) else word
    return F.array(*[F.pmod(h, F.lit(width)) + 1 for h in hasher(column)])


def build(lexicon: DataFrame, hasher: Hasher = sha1_pair, width: int = WIDTH) -> DataFrame:
    """(lang, bucket, bitmap). At most width / 8 bytes per language, whatever the input."""
    bits = lexicon.select("lang", F.explode(bit_positions("word", hasher, width)).alias("bit"))
    return (bits.groupBy("lang", F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")))


def bits_set(filters: DataFrame) -> DataFrame:
    return filters.groupBy("lang").agg(F.sum(F.bitmap_count("bitmap")).alias("bits_set"))


def overlap(filters: DataFrame) -> DataFrame:
    """Bits of each and common bits, for every two languages."""
    a = filters.select(F.col("lang").alias("lang1"), "bucket", F.col("bitmap").alias("b1"))
    b = filters.select(F.col("lang").alias("lang2"), "bucket", F.col("bitmap").alias("b2"))
    # AND of two bitmaps, as the aggregate over the pair
    pairs = (a.join(b, "bucket").filter("lang1 < lang2")
             .select("lang1", "lang2", "bucket", F.explode(F.array("b1", "b2")).alias("bitmap"))
             .groupBy("lang1", "lang2", "bucket")
             .agg(F.bitmap_count(F.bitmap_and_agg("bitmap")).alias("common"))
             .groupBy("lang1", "lang2").agg(F.sum("common").alias("common_bits")))
    sizes = bits_set(filters)
    return (pairs.join(sizes.toDF("lang1", "bits1"), "lang1").join(sizes.toDF("lang2", "bits2"), "lang2")
            .select("lang1", "lang2", "bits1", "bits2", "common_bits"))


# Fixed value: bits per probe row. A row of 32 bits is cheap to carry along with a token.
PROBE_BITS = 32
WIDEST = 16_000_000     # half a million probe rows at most


def probe_rows(filters: DataFrame) -> DataFrame:
    """(slot, words): for every 32 bits of width, the bits of each language as a number.

    At most width / 32 rows (62,500), whatever was put into the filters.
    """
    per_bucket = 32768 // PROBE_BITS
    pieces = filters.select("lang", "bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.lit(per_bucket - 1))).alias("i"))
    bits = F.expr("CAST(conv(hex(substring(bitmap, i * 4 + 1, 4)), 16, 10) AS BIGINT)")
    return (pieces.select("lang", ((F.col("bucket") - 1) * per_bucket + F.col("i")).alias("slot"), bits.alias("bits"))
            .filter("bits <> 0")
            .groupBy("slot").agg(F.collect_list(F.struct("lang", "bits")).alias("words")))


def known_words(words: DataFrame, filters: DataFrame, hasher: Hasher = sha1_pair,
                width: int = WIDTH, how: str = "inner") -> DataFrame:
    """Rows with a ``word``, and the ``langs`` whose filter has all its bits; false positives possible.

    The probe rows are bounded by the width of a filter. Up to ``WIDEST`` bits they go to the words, which
    stay where they are; for wider filters the join is left to Spark. ``left`` keeps all words, with null ``langs``.
    """
    probes = probe_rows(filters)
    out = words.withColumn("_bits", bit_positions("word", hasher, width))
    found = []
    for i in range(len(hasher(F.col("word")))):
        # bytes of a bitmap lie in order, the bits inside a byte from the low end
        shift = F.expr(f"CAST((3 - ((_bits[{i}] - 1) % 32) DIV 8) * 8 + (_bits[{i}] - 1) % 8 AS INT)")
        side = probes.select(F.col("slot").alias("_slot"), F.col("words").alias("_words"))
        # never null: the join would else test every token for a null slot where it is read, and hash it for that
        out = (out.withColumn("_slot", F.coalesce(F.expr(f"(_bits[{i}] - 1) DIV {PROBE_BITS}"), F.lit(-1)))
               .join(F.broadcast(side) if width <= WIDEST else side, "_slot", how).withColumn("_shift", shift)
               .withColumn(f"_found{i}", F.transform(
                   F.filter("_words", lambda w: F.getbit(w["bits"], F.col("_shift")) == 1), lambda w: w["lang"]))
               .drop("_slot", "_words", "_shift"))
        found.append(f"_found{i}")
    langs = F.sort_array(reduce(F.array_intersect, map(F.col, found)))
    out = out.withColumn("langs", F.when(F.size(langs) > 0, langs)).drop("_bits", *found)
    return out if how == "left" else out.filter("langs IS NOT NULL")


def word_hits(toks: DataFrame, filters: DataFrame, hasher: Hasher = sha1_pair,
              width: int = WIDTH, how: str = "inner") -> DataFrame:
    """Tokens with the languages whose filter holds them; ``left`` keeps all tokens.

    Each token is looked up where it is read: what is shuffled later is what the caller counts, not words. Hashing
    is the dear part, so the words that a sample shows to be frequent, a bounded number, are hashed once.
    """
    heavy = stored(known_words(heavy_words(toks), filters, hasher, width, "left").select("word", "langs"), "heavy")
    near = toks.join(F.broadcast(heavy), "word")
    far = known_words(toks.join(F.broadcast(heavy.select("word")), "word", "left_anti"), filters, hasher, width, how)
    return (near.filter("langs IS NOT NULL") if how == "inner" else near).unionByName(far)


def save(filters: DataFrame, path: str) -> None:
    filters.write.parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema("lang string, bucket bigint, bitmap binary").parquet(path)
