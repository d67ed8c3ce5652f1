"""Bytes to text for any charset: one Arrow function, for what Spark doesn't read itself."""

from __future__ import annotations

import codecs
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# The function carries what it needs, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decode_bytes(raw: bytes | None, charset: str | None) -> str | None:
    """By the stated charset, bad bytes dropped; by Latin-1 if there is no such charset of text."""
    if raw is None:
        return None
    try:
        codecs.lookup(charset or "")
        return raw.decode(charset, "ignore")
    except (LookupError, ValueError):
        return raw.decode("iso-8859-1")


def decoded(raw: Column, charset: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def decode(raw: pa.Array, charset: pa.Array) -> pa.Array:
        return pa.array([decode_bytes(r, c) for r, c in zip(raw.to_pylist(), charset.to_pylist())], pa.string())
    return decode(raw, charset)
