"""Line dedup: content-defined chunks of lines; chunks repeated anywhere in the corpus are removed but for the first.

A line ends with a line feed or with the end of a sentence within it, so that a passage inside a long
paragraph has lines too. A rolling hash over the hashes of two lines decides where chunks end (one
place in ``PERIOD``), so boundaries move with the text and not with its place in the document; a
paragraph of several lines always begins and ends a chunk, and its last line never stands alone.
A long line (``LONG`` characters, ``WORDS`` words, or ``UNSPACED`` characters of a script without
blanks) begins and ends a chunk too, and is cut within into content-defined runs of words, each a
chunk, so that a passage within text without sentence ends is found as well. Only chunks of two or
more lines, long lines and their runs, with ``LEAST`` characters at least, are removed; single short
lines are left alone.

1. One pass gives every chunk's place and 64-bit hash; no text is shuffled for it.
2. Hashes that occur twice are found by aggregation; the first occurrence is that of the smallest
   (doc_id, place). Candidates are gathered per document and joined with it: the one shuffle of texts.
3. Every candidate's bytes are compared with those of the first occurrence; one that differs (two
   chunks of one hash) is put back. The cut texts are in the shared folder by then, so nothing is
   read or cut twice.

Defined results: a null text stays null; an empty one stays empty; a text of repeated chunks only
becomes the empty string, and its row stays. Rows equal in doc_id and text are one document and
keep the same text. Rows with a null doc_id come last in the order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .batches import batch_of, mapped, slices

PERIOD, SHORTEST, LEAST, LONG = 2, 40, 32, 300
WORDS, UNSPACED = 50, 100       # a long line: so many words, or so many characters of a script without blanks
WORD_WINDOW, LETTER_WINDOW = 6, 16
# as \n+ or [.!?]+ and blanks or full stops of other scripts; a set of characters comes first, which the engine looks for fast
_STOPS = "\u3002\uff01\uff1f\u0964"
_BREAK = re.compile(rf"([\n.!?{_STOPS}](?:(?<=\n)\n*|(?<=[.!?])[.!?]* +|(?<=[{_STOPS}])[{_STOPS}]* *))")
_WORD = re.compile(r"\S+\s*", re.A)        # blanks as bytes.split() has them
_MIX = np.uint64(0x9E3779B97F4A7C15)
PART = "array<struct<text: string, place: int, hash: long, state: int>>"
PLAIN, FIRST, AGAIN = 0, 1, 2


def line_ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each line ends, and whether a line feed ends it (or the text)."""
    parts = _BREAK.split(text)      # lines and what ends them, in turn
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    feeds = np.array([p[0] == "\n" for p in parts[1::2]] + [True], dtype=bool)
    ends = np.cumsum(sizes)[1::2]
    if sizes[-1]:
        ends = np.append(ends, len(text))
    feeds = feeds[:len(ends)]
    if len(feeds):
        feeds[-1] = True
    return ends, feeds


def unspaced(text: str, start: int, end: int) -> bool:
    """Whether it is a script without blanks."""
    return text.count(" ", start, end) * 20 < end - start and not text[start:end].isascii()


def is_long(text: str, start: int, end: int) -> bool:
    return (end - start >= LONG or end - start >= 2 * WORDS and text.count(" ", start, end) >= WORDS - 1
            or end - start >= UNSPACED and unspaced(text, start, end))


def run_ends(text: str, start: int, end: int) -> list[int]:
    """Where the runs of a long line end: at words (or letters) whose hash is the least of all in a window around them.

    That depends on the words in the window only, so shared words have the same runs wherever they stand. No run has
    under ``LEAST`` characters (without blanks, ``LETTER_WINDOW``).
    """
    shortest = LEAST
    if unspaced(text, start, end):
        shortest = width = LETTER_WINDOW
        stops = np.arange(start + 1, end + 1)
        h = np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    else:
        words = _WORD.findall(text, start, end)         # a word and the blanks after it
        width, stops = WORD_WINDOW, np.cumsum([len(text[start:end]) - sum(map(len, words)), *map(len, words)])[1:] + start
        words = text[start:end].encode("utf-8", "replace").split()
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h)
    if n < 2 * width:
        return [end]
    rolled = h * _MIX
    for back in (1, 2):
        rolled[back:] = rolled[back:] * _MIX + h[:-back]
    rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.ones(n, dtype=bool)
    for d in range(1, width + 1):
        least[d:] &= rolled[d:] < rolled[:-d]
        least[:-d] &= rolled[:-d] <= rolled[d:]
    least[:width - 1] = least[n - width:] = False
    out, at = [], start
    for stop in stops[least].tolist():
        if stop - at >= shortest and end - stop >= shortest:
            out.append(stop)
            at = stop
    return [*out, end]


def chunks_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, hash) of every chunk that may be removed."""
    ends, feeds = line_ends(text)
    n = len(ends)
    if not n:
        return []
    at_start = np.concatenate(([0], ends[:-1]))
    starts, stops = at_start.tolist(), ends.tolist()
    digest, data = xxhash.xxh64_intdigest, text.encode("utf-8", "replace")
    if len(data) == len(text):      # one byte a character: slices of the bytes will do

        def hash_of(start: int, end: int) -> int:
            return digest(data[start:end])
        h = [digest(data[s:e]) for s, e in zip(starts, stops)]
    else:

        def hash_of(start: int, end: int) -> int:
            return digest(text[start:end].encode("utf-8", "replace"))
        h = [hash_of(s, e) for s, e in zip(starts, stops)]
    h = np.array(h, dtype=np.uint64)
    rolled = h.copy()
    rolled[1:] += h[:-1] * _MIX
    soft = (rolled ^ (rolled >> np.uint64(32))) % np.uint64(PERIOD) == 0
    long = ends - at_start >= UNSPACED
    for i in np.flatnonzero(long).tolist():
        long[i] = is_long(text, starts[i], stops[i])
    closes = np.flatnonzero(feeds)                              # the last line of each paragraph
    paragraph = np.diff(np.concatenate(([-1], closes)))         # its number of lines
    hard = np.zeros(n, dtype=bool)
    many = paragraph > 1
    hard[closes[many]] = True
    hard[closes[:-1][many[1:]]] = True                          # the next paragraph has several
    hard[long] = True
    hard[:-1] |= long[1:]
    hard[-1] = True
    lone = np.zeros(n, dtype=bool)
    lone[closes[many] - 1] = True                               # one line of the paragraph would be left
    lone[:-2] |= long[2:]                                       # or one before a long line
    # one short line of a paragraph between borders goes with the long line after it, or else before it
    opens = np.concatenate(([True], feeds[:-1]))
    for j in np.flatnonzero(~long & hard & np.concatenate(([True], hard[:-1]))).tolist() if long.any() else ():
        if not feeds[j] and long[j + 1]:
            hard[j], lone[j] = False, True
        elif not opens[j] and long[j - 1]:
            hard[j - 1], lone[j - 1] = False, True
    out, begin, first = [], 0, 0
    ask = np.flatnonzero(long | hard | soft & ~lone)            # nothing happens at other lines
    for i, is_hard, is_long_ in zip(ask.tolist(), hard[ask].tolist(), long[ask].tolist()):
        end, alone = stops[i], i > first
        if is_long_:
            *inner, _ = run_ends(text, starts[i], end)
            for stop in inner:
                out.append((begin, stop, hash_of(begin, stop)))
                begin = stop
            alone = True
        # a line that is neither hard nor long is soft and may close
        if is_hard or i > first and end - begin >= SHORTEST and not lone[i] and soft[i]:
            if alone and (end - begin >= LEAST or is_long_):
                out.append((begin, end, hash_of(begin, end)))
            begin, first = end, i + 1
    return out


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())])
    for batch in slices(batches):
        found = [chunks_of(t or "") for t in batch.column("text").to_pylist()]
        flat = [c for own in found for c in own]
        offsets = np.cumsum([0, *map(len, found)])
        values = pa.StructArray.from_arrays(
            [pa.array([c[0] for c in flat], pa.int32()), pa.array([c[1] for c in flat], pa.int32()),
             pa.array(np.array([c[2] for c in flat], dtype=np.uint64).view(np.int64))], fields=list(kind))
        yield batch_of(batch.column("row"), chunks=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text to parts: what stays in any case, first occurrences, and what is to go if its bytes are equal."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("place", pa.int32()), ("hash", pa.int64()), ("state", pa.int32())]))
    for batch in slices(batches):
        rows = []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
            if text is None:
                rows.append(None)
                continue
            parts, at = [], 0
            for m in sorted(marks or (), key=lambda m: m["start"]):
                if at < m["start"]:
                    parts.append({"text": text[at:m["start"]], "place": at, "hash": None, "state": PLAIN})
                parts.append({"text": text[m["start"]:m["end"]], "place": m["start"], "hash": m["hash"],
                              "state": FIRST if m["first"] else AGAIN})
                at = m["end"]
            if at < len(text):
                parts.append({"text": text[at:], "place": at, "hash": None, "state": PLAIN})
            rows.append(parts)
        yield batch_of(batch.column("row"), rid=batch.column("rid"), parts=pa.array(rows, kind))


def dedup_lines(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the columns ``keep``), text without repeated chunks, removed (array of start and length, code points)."""
    rid = F.xxhash64("doc_id", "text")
    texts = docs.select(F.struct("doc_id", rid.alias("rid")).alias("row"), F.col("text"))
    chunks = stored(mapped(texts, _chunker, "chunks array<struct<start: int, end: int, hash: long>>").select(
        "row.doc_id", "row.rid", F.explode("chunks").alias("c")).select("doc_id", "rid", "c.*"), "chunks", compression="zstd")
    # most hashes stand once: they are told by themselves, before places are looked at
    twice = chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    repeated = stored(chunks.join(twice, "hash", "left_semi"), "repeated", compression="zstd")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "start")
    again = repeated.groupBy("hash").agg(F.min(order).alias("first")).select(
        "hash", F.col("first.rid").alias("first_rid"), F.col("first.start").alias("first_start"))
    marks = repeated.join(again, "hash").select("rid", F.struct(
        "start", "end", "hash", ((F.col("rid") == F.col("first_rid")) & (F.col("start") == F.col("first_start"))).alias("first")).alias("m"))
    per_row = marks.groupBy("rid").agg(F.collect_set("m").alias("marks"))     # within one document
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text"), rid.alias("rid"))
    cut = rows.join(per_row, "rid", "left").select("row", "rid", "text", "marks")
    parts = stored(mapped(cut, _cutter, f"rid long, parts {PART}"), "parts", compression="zstd")

    pieces = parts.select("rid", F.explode("parts").alias("p")).select("rid", "p.*")
    firsts = pieces.where(F.col("state") == FIRST).groupBy("hash").agg(F.min("text").alias("first_text"))
    differ = pieces.where(F.col("state") == AGAIN).join(firsts, "hash").where("text <> first_text").select("rid", "place")
    differ = stored(differ.groupBy("rid").agg(F.collect_set("place").alias("back")), "put-back")
    # two chunks of one 64-bit hash are so rare that the join is left out when there are none
    parts = parts.withColumn("back", F.lit(None).cast("array<int>")) if differ.isEmpty() else parts.join(differ, "rid", "left")

    def goes(p):
        return (p["state"] == AGAIN) & ~F.coalesce(F.array_contains("back", p["place"]), F.lit(False))

    return parts.select(
        "row", F.array_join(F.transform(F.filter("parts", lambda p: ~goes(p)), lambda p: p["text"]), "").alias("text"),
        F.transform(F.filter("parts", goes), lambda p: F.struct(
            p["place"].alias("start"), F.length(p["text"]).alias("length"))).alias("removed"))
