"""Result files and table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: text written for a page that could not be read.
PAGE_ERROR = "Error. Page not exist or page redirect"


def report_rows(results: DataFrame, failed: Column, error: Column | None = None) -> DataFrame:
    """(url, found, lang), or (url, error text) for a failed page, in one frame."""
    text = F.lit(PAGE_ERROR) if error is None else error
    return results.select("url", F.when(failed, text).otherwise(F.col("found")).alias("found"),
                          F.when(~failed, F.col("lang")).alias("lang"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path)


def write_version(df: DataFrame, path: str) -> None:
    """The next version of a table goes to its own path, so readers of the old one are safe."""
    df.write.mode("errorifexists").parquet(path)
