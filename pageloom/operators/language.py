"""Word statistics and language detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lang import margin_percent
from ..functions.text import words
from ..session import stored

# The winner must lead by more than this percentage; limits of the early exit.
MARGIN = 6
EXIT_EVERY = 4
EXIT_LEAST = 4
EXIT_GAP = 25


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: (key, pos from 1, word)."""
    return (docs.select(key, F.posexplode(words(text)).alias("pos", "word"))
            .withColumn("pos", F.col("pos") + 1))


def build_lexicon(docs: DataFrame, lang: str = "lang", text: str = "text",
                  top_k: int | None = None) -> DataFrame:
    """(lang, word, n) from labelled text, optionally the ``top_k`` of each language.

    A language may hold a third of all words, so ranking is done twice: within slices of a
    language, then among the slices' survivors. The result is the same as one ranking.
    """
    counts = (docs.select(F.col(lang).alias("lang"), F.explode(words(text)).alias("word"))
              .groupBy("lang", "word").agg(F.count("*").alias("n")))
    if top_k is None:
        return counts
    best = [F.desc("n"), F.col("word")]
    slices = Window.partitionBy("lang", "_slice").orderBy(*best)
    whole = Window.partitionBy("lang").orderBy(*best)
    return (counts.withColumn("_slice", F.pmod(F.xxhash64("word"), F.lit(64)))
            .withColumn("_r", F.row_number().over(slices)).filter(F.col("_r") <= top_k)
            .withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= top_k)
            .drop("_r", "_slice"))


# Words that a sample of the texts shows to be frequent travel to the texts: so many at most, none longer than this.
HEAVY, HEAVY_LENGTH = 20_000, 64
SAMPLE = 64     # one text in so many


def heavy_words(toks: DataFrame) -> DataFrame:
    """(word): the most frequent words of a sample of the texts (the first column names the text); a bounded number."""
    some = toks.filter((F.pmod(F.xxhash64(F.col(toks.columns[0])), F.lit(SAMPLE)) == 0) & (F.length("word") <= HEAVY_LENGTH))
    return some.groupBy("word").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "word").limit(HEAVY).select("word")


def lexicon_hits(toks: DataFrame, lexicon: DataFrame, how: str = "inner") -> DataFrame:
    """Words found in a lexicon, with the ``langs`` that know them; ``left`` keeps all words.

    Frequent words are looked up where they are read, in a bounded table; a word that is in every text
    would else be one key. Only the rare ones are shuffled by word. The sample decides which way a word
    goes, never what is found.
    """
    by_word = lexicon.groupBy("word").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    heavy = stored(heavy_words(toks).join(by_word, "word", "left"), "heavy")
    near = toks.join(F.broadcast(heavy), "word")
    far = toks.join(F.broadcast(heavy.select("word")), "word", "left_anti").join(by_word, "word", how)
    return (near.filter("langs IS NOT NULL") if how == "inner" else near).unionByName(far)


def hit_counts(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of words found per (text, language); repeats count."""
    return hits.select(key, F.explode("langs").alias("lang")).groupBy(key, "lang").agg(F.count("*").alias("hits"))


def top_by_margin(counts: DataFrame, key: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """The leading language where its lead is clear, else an empty string."""
    w = Window.partitionBy(key).orderBy(F.desc("hits"), "lang")
    first, second = F.col("hits"), F.coalesce(F.col("_second"), F.lit(0))
    return (counts.withColumn("_second", F.lead("hits").over(w))
            .withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .withColumn("margin", margin_percent(first, second))
            .select(key, F.when(F.col("margin") > margin, F.col("lang")).otherwise("").alias("detected"),
                    "hits", second.alias("second_hits"), "margin"))


def early_exit_counts(seen: DataFrame, languages: list[str], key: str = "doc_id") -> DataFrame:
    """Counts as they stand when reading stops early, or at the end of the text.

    ``seen`` holds all words of a text, with the ``langs`` that know them or null. At every
    fourth word reading stops if at least two languages were seen and the first leads clearly.
    The window is one text wide.
    """
    order = Window.partitionBy(key).orderBy("pos")
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flags = seen.select(key, "pos", *[F.coalesce(F.array_contains("langs", lang), F.lit(False)).cast("tinyint").alias(f"_f{i}")
                                      for i, lang in enumerate(languages)])
    n = [F.col(f"_n{i}") for i in range(len(languages))]
    run = flags.select(key, "pos", *[F.sum(f"_f{i}").over(w).alias(f"_n{i}") for i in range(len(languages))],
                       F.lead("pos").over(order).isNull().alias("_last"))
    zero = F.lit(0).cast("bigint")
    first = F.greatest(zero, zero, *n)
    second = F.greatest(zero, zero, *[F.least(a, b) for i, a in enumerate(n) for b in n[i + 1:]])
    stop = ((F.col("pos") % EXIT_EVERY == 0) & (second > 0) & (first > EXIT_LEAST)
            & ((first > second * 2) | (first - second > EXIT_GAP)))
    # of each text the places where reading may stop, and its end; the first of them counts
    ends = run.withColumn("_stop", stop).filter("_stop OR _last")
    counts = F.array(*[F.struct(c.alias("hits"), F.lit(lang).alias("lang")) for c, lang in zip(n, languages)])
    return (ends.groupBy(key).agg(F.min_by(counts, "pos").alias("_c"), F.min("pos").alias("words_read"))
            .select(key, "words_read", F.inline("_c"))
            .filter("hits > 0").select(key, "lang", F.col("hits").cast("bigint"), "words_read"))
