"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet of the search is the word. A pattern is a window of 13 consecutive words of a
benchmark item (an item of fewer words is one shorter window). For each pattern length a table
gives, for the last two words under the window, how far the window may move on without passing
an occurrence; pairs that no pattern holds move it by its whole length less one. Where the shift
is 0, the pair selects the bucket of patterns that end in it, the first pair narrows the bucket,
and the words are compared one by one.

Nothing is shuffled but the benchmark. The benchmark travels to the tasks in slices of about
``SLICE_BYTES`` of text each; for a larger one the documents are searched once for each slice.

Defined results: a null text has no words, so it is neither a pattern nor contaminated; equal
windows of several items count for each of them; several rows with one item_id are one item;
a null item_id counts as the empty string; repeated documents give a row each; no benchmark,
no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .batches import batch_of, mapped, packed, slices

WINDOW = 13
SLICE_BYTES = 16_000_000
FOUND = "found struct<n_words: long, spans: array<struct<start: int, end: int>>, items: array<string>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

# A-Z to lower case, other ASCII but digits and a-z to a blank; bytes of other characters stay.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                    for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []


class Patterns:
    """Shift tables and suffix buckets of all windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[list[bytes], set[str]]]]] = defaultdict(dict)

    def add(self, window: list[bytes], item: str) -> None:
        b, m = self.block, self.length
        for end in range(b, m + 1):
            pair = tuple(window[end - b:end])
            self.shift[pair] = min(m - end, self.shift.get(pair, m))
        tests = self.buckets[tuple(window[m - b:])].setdefault(tuple(window[:b]), [])
        for known, items in tests:
            if known == window:
                items.add(item)
                return
        tests.append((window, {item}))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """The end of every occurrence, ascending, with the items that hold the window."""
        b, m, n = self.block, self.length, len(words)
        shift, far = self.shift.get, self.length - self.block + 1
        end = m
        while end <= n:
            pair = tuple(words[end - b:end])
            step = shift(pair, far)
            if step:
                end += step
                continue
            for window, items in self.buckets[pair].get(tuple(words[end - m:end - m + b]), ()):
                if window == words[end - m:end]:
                    yield end, items
            end += 1


def compile_patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[Patterns]:
    by_length: dict[int, Patterns] = {}
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        m = min(window, len(words))
        patterns = by_length.setdefault(m, Patterns(m))
        for start in range(len(words) - m + 1):
            patterns.add(words[start:start + m], item)
    return list(by_length.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _searcher(items: list[tuple[str, str | None]], window: int, first: bool, last: bool):
    """Adds what one slice of the benchmark hits; only the last step lets the text go."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = compile_patterns(items, window)
        for batch in slices(batches):
            n_words, spans, found = [], [], []
            texts = batch.column("text").to_pylist()
            before = [{"spans": (), "items": ()}] * len(texts) if first else batch.column("found").to_pylist()
            for text, old in zip(texts, before):
                words, names = words_of(text), set(old["items"])
                hits = [(s["start"], s["end"]) for s in old["spans"]]
                for p in patterns:
                    for end, of in p.search(words):
                        names |= of
                        if hits and hits[-1][0] <= end - p.length <= hits[-1][1] <= end:
                            hits[-1] = (hits[-1][0], end)
                        else:
                            hits.append((end - p.length, end))
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in merged(hits)])
                found.append(sorted(names))
            result = pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(found, pa.list_(pa.string()))],
                ["n_words", "spans", "items"])
            yield batch_of(batch.column("row"), **({} if last else {"text": batch.column("text")}), found=result)
    return search


def benchmark_slice(rows: DataFrame, k: int, n: int) -> list[tuple[str, str | None]]:
    """The k-th of n slices of the items (item, text)."""
    part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return [(r["item"], r["text"]) for r in part.toLocalIterator()]


def find_windows(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
                 limit: int = SLICE_BYTES) -> DataFrame:
    """row (the columns ``keep``), found: n_words, spans of words covered by occurrences (merged), items (sorted).

    A benchmark of more than ``limit`` bytes is searched for in slices of about so many, one after the other: what
    is found so far is written to the shared folder, so the driver and each task hold the patterns of one slice.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit) or 1
    out = packed(docs, keep)
    for k in range(n):
        last = k == n - 1
        out = mapped(out, _searcher(benchmark_slice(rows, k, n), window, k == 0, last), ("" if last else "text string, ") + FOUND)
        out = out if last else stored(out, "searched")
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
                 one_in: int = 20) -> DataFrame:
    """row, found, n_hit and contaminated: hit words are at least one in ``one_in`` of the words."""
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    found = find_windows(docs, benchmark, keep, window).withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("found.n_words")))
