"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (what stands between line feeds, the empty one too) is hashed to a wide vector
of lanes, and a text's fingerprint is the sum of the vectors of its paragraphs, lane by lane
modulo 2^32. So the order of paragraphs doesn't matter, and a paragraph is put in or taken
out by one addition or subtraction (``added``, ``removed``), without reading the rest.

A vector has two parts. The first 64 lanes are the output of an extendable hash of the whole
paragraph: equal sums stand for equal multisets of paragraphs. The other 128 lanes are the sum
of one lane of +1 or -1 for every run of three words in the paragraph (with two marks before
its first word): for these lanes the product of two fingerprints estimates how many runs the
texts share, and ``likeness`` makes a figure from 0 to 1 of it.

Defined results: a null text is the empty one, which is one empty paragraph; equal texts have
equal fingerprints and the likeness 1, as have texts with the same paragraphs in another order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

EXACT, SKETCH = 64, 128
LANES = EXACT + SKETCH
ROW = "doc_id long, text string"
DEALT = "part int, ahead boolean, tie long, " + ROW
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of ``LANES`` 32-bit values for each text."""
    n = len(texts)
    exact = np.zeros((n, EXACT), dtype=np.uint32)
    hashes: list[int] = []
    lengths: list[int] = []     # words and marks of each paragraph
    owners: list[int] = []      # its text
    for i, text in enumerate(texts):
        paragraphs = text.encode("utf-8", "replace").split(b"\n")
        wide = b"".join([hashlib.shake_128(p).digest(2 * EXACT) for p in paragraphs])
        exact[i] = np.frombuffer(wide, dtype="<u2").reshape(-1, EXACT).sum(axis=0, dtype=np.uint32)
        for p in paragraphs:
            if words := p.split():
                hashes += (1, 2)
                hashes += map(crc32, words)
                lengths.append(len(words) + 2)
                owners.append(i)
    sketch = np.zeros((n, SKETCH), dtype=np.int64)
    if hashes:
        h = np.array(hashes, dtype=np.uint64)
        run = h[2:] * _MIX[0] + h[1:-1] * _MIX[1] + h[:-2] * _MIX[2]
        run = (run ^ (run >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        ends = np.cumsum(lengths)
        within = np.ones(len(h), dtype=bool)
        within[ends[:-1]] = within[ends[:-1] + 1] = False    # a run never spans two paragraphs
        owner = np.repeat(owners, lengths)[2:][within[2:]]
        run = run[within[2:]]
        lane = (run >> np.uint64(57)).astype(np.int64)
        sign = ((run >> np.uint64(20)) & np.uint64(1)).astype(np.float64) * 2 - 1
        sketch = np.bincount(owner * SKETCH + lane, weights=sign, minlength=n * SKETCH).astype(np.int64).reshape(n, SKETCH)
    return np.concatenate((exact, (sketch & 0xFFFFFFFF).astype(np.uint32)), axis=1)


def added(fingerprint: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """With the paragraphs of another fingerprint put in."""
    return (fingerprint + paragraph).astype(np.uint32)


def removed(fingerprint: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """With the paragraphs of another fingerprint taken out."""
    return (fingerprint - paragraph).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: twice the product of the sketches over the sum of their squares, kept within 0 and 1."""
    x, y = (m[:, EXACT:].astype(np.int32).astype(np.float64) for m in (a, b))
    squares = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    share = np.clip(2 * (x * y).sum(axis=1) / np.where(squares > 0, squares, 1), 0.0, 1.0)
    return np.where((a == b).all(axis=1), 1.0, share)


def written(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k] if k else text


def _dealer(bounds: np.ndarray, first: int | None, parts: int):
    """Each row to its range of ids; the rows that begin a range also go, marked, to the range before it."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.array(ids.is_valid())
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(known, np.searchsorted(bounds, values, side="right"), 0).astype(np.int32)
            begins = known & np.isin(values, bounds)
            very_first = ~known if first is None else known & (values == first)
            for rows, to, ahead in ((np.arange(len(values)), part, False), (np.flatnonzero(begins), part[begins] - 1, True),
                                    (np.flatnonzero(very_first), np.full(very_first.sum(), parts - 1, np.int32), True)):
                if len(rows):
                    some = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to, pa.int32()), pa.array([ahead] * len(rows)), some.column("tie"), some.column("doc_id"),
                         some.column("text")], ["part", "ahead", "tie", "doc_id", "text"])
    return deal


def in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of ids and sorted there; last in a range, marked ``ahead``, what begins the next one.

    The order is by doc_id (null first), then by a hash of the text; after the last range comes
    the first again. Only the bounds, one id for each task, are on the driver.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [k / parts for k in range(1, parts)] or [0.5]
    seen = docs.agg(F.percentile_approx("doc_id", at, 100 * max(100, parts)).alias("bounds"), F.min("doc_id").alias("first"),
                    F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    bounds = np.array(sorted({b for b in seen["bounds"] or () if b > seen["first"] or seen["known"] < seen["n"]}), dtype=np.int64)
    first = seen["first"] if seen["known"] == seen["n"] else None
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.mapInArrow(_dealer(bounds, first, len(bounds) + 1), DEALT)
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", "tie")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []       # the last row whose next one hasn't come: part, id, text, fingerprint
    for batch in slices(batches):
        parts, ahead, ids, texts = (batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text"))
        own = fingerprints(texts)
        pairs: list[tuple] = []
        for i, (part, marked) in enumerate(zip(parts, ahead)):
            if waiting and waiting[0][0] == part:
                pairs.append((*waiting[0][1:], texts[i], own[i]))
            waiting = [] if marked else [(part, ids[i], texts[i], own[i])]
        if not pairs:
            continue
        changed = [edited(text, following) for _, text, _, following, _ in pairs]
        prints, next_prints, new = np.stack([p[2] for p in pairs]), np.stack([p[4] for p in pairs]), fingerprints(changed)
        yield pa.RecordBatch.from_arrays([
            pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed]),
            pa.array([written(p) for p in prints]), pa.array([written(p) for p in new]),
            pa.array(likeness(prints, new)), pa.array(likeness(prints, next_prints)),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, fingerprints of its text and its edited text, and their likeness; that of the next document.

    A single document is its own next one. Texts are shuffled once.
    """
    return in_order(docs).mapInArrow(
        _walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")
