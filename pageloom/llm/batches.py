"""Helpers of the Arrow functions: bounded slices of text, and rows that keep their own columns apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about ``limit`` bytes of ``column``; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()   # the worker lives on, between tasks and for other functions


def packed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` (the columns to keep, as one struct) and ``text``; so no name of the table clashes with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text"))


def mapped(rows: DataFrame, function: Callable, added: str) -> DataFrame:
    """``row`` and the columns ``added``, which ``function`` makes of each Arrow batch of ``row`` and ``text``."""
    own = T.StructType([rows.schema["row"], *T._parse_datatype_string(added).fields])
    return rows.mapInArrow(function, own)


def batch_of(row: pa.Array, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row, *columns.values()], ["row", *columns])


def crc_of_id(column: str = "doc_id") -> Column:
    """The unsigned CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
