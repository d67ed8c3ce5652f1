"""Landed pages: status, charset, content type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import to_utf8

PAGE_SCHEMA = "page_id bigint, url string, html string"


def scan(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def scan_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Bodies stored as files: (path, raw)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("raw"))


def fetch_outcome(status: Column | str) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return F.when(c == 200, "success").otherwise("fail")


def sniffed_type(content_type: Column | str, body: Column | str) -> Column:
    """An octet stream that starts like an html page is one."""
    kind = F.col(content_type) if isinstance(content_type, str) else content_type
    start = F.col(body) if isinstance(body, str) else body
    return F.when((kind == "application/octet-stream") & start.startswith("<!DOC"), "text/html").otherwise(kind)


def load_pages(fetched: DataFrame) -> DataFrame:
    """(url, status, content_type, charset, raw bytes) to pages with text and outcome."""
    decoded = fetched.withColumn("html", to_utf8("raw", F.coalesce("charset", F.lit("iso-8859-1"))))
    return decoded.withColumns({"outcome": fetch_outcome("status"),
                                "content_type": sniffed_type("content_type", "html")})
