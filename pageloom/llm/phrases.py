"""Phrase collocations of each language, mined by a sample, its negative border, and a pass for what fails there.

1. A sample of the texts (one in ``RATE``, by a hash) proposes phrases of one to three words; words and
   pairs first, then triples of proposed pairs.
2. A pass over all texts counts every phrase whose first words and last words (all but one) are
   proposed: these are the proposed phrases and those of their negative border that occur at all. Single
   words are counted without condition.
3. A phrase found frequent that wasn't proposed is a border failure: longer phrases around it may be
   uncounted. An expansion pass counts what the enlarged set admits and the first pass hasn't counted. It
   goes on from a phrase that it counts as if that were frequent, so longer phrases around it are counted in
   the same pass. With that the set is closed: the parts of a frequent phrase are frequent, and each of
   them was counted by the first pass and is in the enlarged set, or is counted by this one. So no border
   can fail again, and all counts of frequent phrases are exact.

What is proposed reaches the tasks as a bit table of stated size. A phrase let in by a collision of bits
is counted exactly as well, in all texts, so collisions cost work but change no result; and "counted by
the first pass" is asked of that pass's own rule. Phrases are told apart by their words, not by hashes.

Only counts are shuffled, added up by slice before; no phrase has more rows than there are slices. A slice of
some four megabytes of text is held at a time.

Defined results: a null text is empty, a null language ``und``; empty texts and repeated rows count as
they stand; no document, no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .batches import slices

LEAST, LONGEST, TOP = 30, 4, 2000
#: One text in RATE proposes; a phrase seen LEAST / RATE * EASE times there is proposed.
RATE, EASE = 8, 0.8
BITS = 1 << 26
SLICE_BYTES = 4_000_000
UNKNOWN = "und"
#: A phrase of a language as one string: no word holds a line feed or a blank.
COUNTS = "key string, f long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: 0 within a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9))


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all its words but the last, and the last one's."""
    h = (before * _ODD[0] + word) * _ODD[1]
    h ^= h >> np.uint64(29)
    h *= _ODD[2]
    return h ^ (h >> np.uint64(32))


def hashed(texts: pa.Array) -> np.ndarray:
    """A hash of each string: its bytes times powers of an odd number, summed and mixed."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]].astype(np.uint64)
    sizes = np.diff(ends)
    power = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, _ODD[0]))
    data = (data + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], sizes)]
    out = np.zeros(len(texts), dtype=np.uint64)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(data, (ends[:-1] - ends[0])[some])
    return mixed(out, sizes.astype(np.uint64))


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each hash."""
    return (h % np.uint64(BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)


def holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set in ``table`` (bytes, lowest bit first)."""
    one, two = places(h)
    return ((table[one >> 3] >> (one & 7).astype(np.uint8)) & (table[two >> 3] >> (two & 7).astype(np.uint8)) & np.uint8(1)).astype(bool)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """All words, in order: an index into the distinct ones, those, the text each is in, and whether the next belongs to its piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kind, inside = _KIND[raw], np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = kind == 0
    edge = np.zeros(len(raw) + 1, dtype=bool)     # a text begins here
    edge[ends] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | edge))
    stop = np.flatnonzero(before & (~inside | edge))
    letters = _LOWER[raw[inside[:-1]]]
    offsets = np.concatenate(([0], np.cumsum(stop - start)))
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
    text = np.searchsorted(ends, start, side="right") - 1
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    together = (breaks[start[1:]] == breaks[start[:-1]]) & (text[1:] == text[:-1]) if len(start) else np.zeros(0, bool)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, text, together


def phrases_of(texts: pa.Array, langs: pa.Array, tables: list[np.ndarray], sizes: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Counts within these texts of the phrases of so many words that the last table admits and none before; with no table, of all.

    Of two tables the second is that of the expansion pass.
    """
    words, spelled, text, together = words_of(texts)
    if not len(words):
        return
    tongue = pc.fill_null(langs, UNKNOWN).dictionary_encode()
    of_word = tongue.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
    # single words of a language
    ids, index, n = np.unique(of_word * len(spelled) + words, return_inverse=True, return_counts=True)
    word = spelled.take(pa.array(ids % len(spelled)))
    phrase = pc.binary_join_element_wise(tongue.dictionary.cast(pa.large_string()).take(pa.array(ids // len(spelled))), word, pa.scalar("\n", pa.large_string()))
    word_hash = hashed(spelled)[ids % len(spelled)]
    own = mixed(hashed(tongue.dictionary)[ids // len(spelled)], word_hash)
    if sizes[0] == 1:
        yield counted(phrase, n)
    singles, single_of = word, index          # by place: which word
    at = np.arange(len(words))                  # places where a phrase of this size begins
    # by pass, of the distinct phrases: those that longer ones may be made of
    known = [holds(t, own) for t in tables]
    first = index
    for size in range(2, sizes[1] + 1):
        # a phrase is its first words, and its last word; its last words are the phrase one place on
        run = run[:-1] & together[size - 2:] if size > 2 else together
        place = np.full(len(words) + 1, -1, dtype=np.int64)
        place[at] = first
        begin = np.flatnonzero(run)
        begin = begin[(place[begin] >= 0) & (place[begin + 1] >= 0)]
        head, tail = place[begin], place[begin + 1]
        if tables:
            admitted = [k[head] & k[tail] for k in known]
            near = np.logical_or.reduce(admitted)       # what some pass admits is needed to go on from
            begin, head = begin[near], head[near]
            admitted = [k[near] for k in admitted]
        if not len(begin):
            return
        last = single_of[begin + size - 1]
        ids, index, n = np.unique(head * len(singles) + last, return_inverse=True, return_counts=True)
        head, last = ids // len(singles), ids % len(singles)
        phrase = pc.binary_join_element_wise(phrase.take(pa.array(head)), singles.take(pa.array(last)), pa.scalar(" ", pa.large_string()))
        own = mixed(own[head], word_hash[last])
        wanted = np.ones(len(ids), dtype=bool)
        if tables:
            by_pass = []
            for k in admitted:
                by_pass.append(np.zeros(len(ids), dtype=bool))
                by_pass[-1][index] = k      # the tables look at the phrase alone, so all its places agree
            wanted = by_pass[-1] & ~by_pass[0] if len(tables) > 1 else by_pass[0]
            # the expansion pass goes on from what it counts
            known = [k & (holds(t, own) | (wanted if i else False)) for i, (k, t) in enumerate(zip(by_pass, tables))]
        if size >= sizes[0] and wanted.any():
            keep = pa.array(wanted)
            yield counted(phrase.filter(keep), n[wanted])
        at, first = begin, index


def counted(key: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(n, pa.int64())], ["key", "f"])


def count(docs: DataFrame, tables: list, sizes: tuple[int, int], least: int, all_words: bool = False) -> DataFrame:
    """(lang, size, phrase, f) of the phrases of so many words that the last of the tables admits and that are there ``least`` times.

    ``tables`` are broadcasts of BITS bits each. With ``all_words`` single words have no least number.
    """
    def per_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(t.value, dtype=np.uint8) for t in tables]
        for batch in slices(batches, limit=SLICE_BYTES):
            for found in phrases_of(batch.column("text"), batch.column("lang"), own, sizes):
                for start in range(0, found.num_rows, 50_000):
                    yield found.slice(start, 50_000)
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(per_slice, COUNTS)
    # a slice has added up its own; adding up once more before the shuffle would hold a task's phrases for little
    sums = rows.repartition("key").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", -1)
    often = (F.col("f") >= least) | ~phrase.contains(" ") if all_words else F.col("f") >= least
    return sums.where(often).withColumn("phrase", phrase).select(
        F.expr("left(key, length(key) - length(phrase) - 1)").alias("lang"), F.size(F.split("phrase", " ")).alias("size"), "phrase", "f")


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pc.split_pattern(batch.column("phrase").cast(pa.large_string()), " ")
        starts, of_word = words.offsets.to_numpy()[:-1], hashed(words.flatten())
        sizes, h = pc.list_value_length(words).to_numpy(), hashed(batch.column("lang"))
        for k in range(LONGEST):
            has = sizes > k
            h[has] = mixed(h[has], of_word[starts[has] - words.offsets[0].as_py() + k])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places(h)))], ["bit"])


def bit_table(phrases: DataFrame):
    """A broadcast of BITS bits that holds the phrases; the size is the same for any number of them."""
    found = phrases.select("lang", "phrase").mapInArrow(_bits, "bit long")
    words = found.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(BITS // 64, dtype=np.int64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(table.tobytes())


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``LONGEST`` words with f >= least, as (lang, size, phrase, f), and (lang, n): all words of a language."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(RATE)) == 0)
    often = max(2, int(least / RATE * EASE))
    short = stored(count(part, [], (1, 2), often), "proposed")
    proposed = short.unionByName(stored(count(part, [bit_table(short)], (3, LONGEST - 1), often), "proposed")).drop("f")
    tables = [bit_table(proposed)]
    fresh = stored(count(docs, tables, (1, LONGEST), least, all_words=True), "counted")
    totals = fresh.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    found = fresh.where(F.col("f") >= least)
    failed = stored(found.where(F.col("size") < LONGEST).select("lang", "size", "phrase").join(proposed, ["lang", "size", "phrase"], "left_anti"), "failed")
    if not failed.isEmpty():
        tables.append(bit_table(proposed.unionByName(failed)))
        found = found.unionByName(stored(count(docs, tables, (2, LONGEST), least), "counted"))
    return found, totals


def exact(count: Column | str) -> Column:
    return (F.col(count) if isinstance(count, str) else count).cast("decimal(20,0)")


def scored(found: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest cut, without those that a longer one takes along."""
    candidates = found.where("size > 1")
    parts = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("ends", F.array(F.array_join(F.slice(parts, 1, F.col("k")), " "), F.array_join(F.slice(parts, F.col("k") + 1, F.col("size")), " ")))
    counts = found.select("lang", F.col("phrase").alias("end"), F.col("f").alias("of_end"))
    sides = cuts.select("lang", "phrase", "a", "k", F.posexplode("ends").alias("side", "end")).join(counts, ["lang", "end"])
    both = sides.groupBy("lang", "phrase", "a", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("of_end"))).alias(c) for s, c in enumerate("lr")])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    least = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # phrases of two or three words within a longer candidate
    within = candidates.where("size > 2").select("lang", "f", "size", parts.alias("parts"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    within = within.select("lang", "f", "parts", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("s"))
    longest = within.select("lang", F.array_join(F.slice("parts", F.col("s"), F.col("m")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    taken = F.col("f").isNotNull() & (exact("f") * 100 >= exact("a") * 80)
    return least.join(longest, ["lang", "phrase"], "left").where(~taken).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language; slices of a language are ranked first, so that no task sorts a whole one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slice_ = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = rows.withColumn("slice", slice_).withColumn("at", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("at") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("slice", "at")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    found, totals = frequent(docs, least)
    return ranked(scored(found), top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
