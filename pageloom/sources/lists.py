"""Text lists: URLs and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def url_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first column of each row is a URL; no header."""
    return spark.read.csv(path, schema="url string").filter("url is not null")


def plain_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blanks and repeats are dropped."""
    return plain_urls(spark.read.text(path))


def plain_urls(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("url")).filter("url <> ''").dropDuplicates()


def affix_word_list(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """``word/FLAGS`` lines."""
    # the csv reader decodes the charset; a separator that never occurs keeps lines whole
    lines = spark.read.csv(path, schema="value string", sep="\u0001", quote="", encoding=encoding)
    return affix_words(lines)


def affix_words(lines: DataFrame) -> DataFrame:
    return lines.select(F.regexp_replace("value", r"/\w+", "").alias("word"))


def coded_word_list(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """``1r2<...>word, word:...`` lines."""
    return coded_words(spark.read.csv(path, schema="value string", sep="\u0001", quote="", encoding=encoding))


def coded_words(lines: DataFrame) -> DataFrame:
    captured = F.regexp_extract("value", r"^\d+r\d+<.+?>([^:]+)", 1)
    return lines.select(F.explode(F.split(captured, r"\s*,\s*")).alias("word")).filter("word <> ''")
