"""SimHash near-duplicates: all pairs of fingerprints within 4 bits, by Gray-order hierarchical indexes.

1. Fingerprints: words of the text with A-Z in lower case, shingles of four words, XXH64 with
   seed 42 of each; a bit is set if it is set in over half of the hashes.
2. Equal fingerprints are one node, so copies cost nothing below.
3. Two fingerprints that differ in at most 4 bits agree in at least ``BLOCKS`` - 4 of ``BLOCKS``
   blocks of bits. Each fingerprint goes to one bucket for every choice of so many blocks; a
   bucket with more than ``LIMIT`` fingerprints is cut into chunks, and every two chunks meet in a
   unit of their own. So no task holds more than it can, and no pair within 4 bits is missed.
4. In a unit fingerprints are sorted by Gray rank, which puts similar ones side by side. Eight
   neighbours form a node, eight nodes an upper node and so on; a node keeps the bits that all
   below it share (mask and pattern). A search starts at the root of the bucket with the
   differences in the root's mask, adds for a child only those in bits that the parent didn't
   fix, and leaves a whole group as soon as the sum is over 4. A group whose free bits can't lift
   the sum over 4 is taken whole; a group that is already joined with the query is passed by. So
   a dense group of near copies costs few visits, and only as many links leave the task as it
   has members.
5. Links are joined into components by star contraction, a few shuffles of links each, written to
   the shared folder between them.

Defined results: null and empty texts have the fingerprint 0, linked like any other; a component's
id is its smallest doc_id (null if all are null); repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .batches import batch_of, mapped, packed, slices

SHINGLE, NEAR, BLOCKS, FAN_OUT = 4, 4, 6, 8
LIMIT = 200_000
CHUNK, VISITS = 32_768, 1_000_000
SLICE_BYTES = 300_000


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, 42)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], 42) for s, e in zip(starts, ends[size - 1:].tolist())]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """One uint64 for each text."""
    hashes, sizes = [], []
    for text in texts:
        own = shingle_hashes(text)
        sizes.append(len(own))
        hashes += own
    out, sizes = np.zeros(len(texts), dtype=np.uint64), np.array(sizes, dtype=np.int64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        bits = np.unpackbits(np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 64)
        starts = np.concatenate(([0], np.cumsum(sizes[filled])[:-1]))
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[filled] = np.packbits(2 * counts > sizes[filled][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SLICE_BYTES):
        yield batch_of(batch.column("row"), fp=pa.array(fingerprints(batch.column("text").to_pylist()).view(np.int64)))


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the columns ``keep``) and fp, the fingerprint as a signed 64-bit number."""
    return mapped(packed(docs, keep), _fingerprint, "fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- the index within a unit -------------------------------------------------------------------------------------

class Components:
    """Groups of numbered members; joined pairs by pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.root, a, b)
            while not np.array_equal(higher := self.root[self.root], self.root):
                self.root = higher


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; level 0 are the fingerprints, the last one has a root per bucket."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        self.fps, self.levels = fps, []
        ones, zeros, first, last = fps, fps, np.arange(len(fps)), np.arange(len(fps))
        while True:
            mask = ~(ones ^ zeros)
            self.levels.append({"mask": mask, "pattern": ones & mask, "bucket": bucket, "first": first, "last": last,
                                "free": np.bitwise_count(~mask).astype(np.int64)})
            opens = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            if opens.all():
                return
            place = np.arange(len(bucket)) - np.maximum.accumulate(np.where(opens, np.arange(len(bucket)), 0))
            starts = np.flatnonzero(place % FAN_OUT == 0)
            self.levels[-1]["up"] = np.cumsum(place % FAN_OUT == 0) - 1
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(zeros, starts)
            last = last[np.append(starts[1:], len(last)) - 1]
            first, bucket = first[starts], bucket[starts]

    def link(self, member: np.ndarray, groups: Components) -> None:
        """Join in ``groups`` the members of all fingerprints of one bucket within ``NEAR`` bits."""
        for level in self.levels[1:]:   # what differs in at most NEAR places at all is near throughout
            for k in np.flatnonzero((level["free"] <= NEAR) & (level["first"] < level["last"])):
                inner = member[level["first"][k]:level["last"][k] + 1]
                groups.join(inner[1:], np.full(len(inner) - 1, inner[0]))
        top = self.levels[-1]
        root_of = np.searchsorted(top["bucket"], self.levels[0]["bucket"])
        start, size = 0, 16
        while start < len(self.fps):
            query = np.arange(start, min(start + size, len(self.fps)))
            start, widest = start + len(query), len(query)
            node, sums = root_of[query], None
            uniform = self._uniform(groups.root[member])
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                news = level["mask"][node] if sums is None else level["mask"][node] & ~fixed
                more = np.bitwise_count((self.fps[query] ^ level["pattern"][node]) & news).astype(np.int64)
                sums = more if sums is None else sums + more
                go = (sums <= NEAR) & (level["last"][node] > query) & (uniform[depth][node] != groups.root[member[query]])
                query, node, sums = query[go], node[go], sums[go]
                whole = (sums + level["free"][node] <= NEAR)    # at level 0 always
                groups.join(member[query[whole]], member[level["first"][node[whole]]])
                if depth:
                    query, node, sums = query[~whole], node[~whole], sums[~whole]
                    fixed, below = level["mask"][node], self.levels[depth - 1]["up"]
                    low, high = np.searchsorted(below, node), np.searchsorted(below, node, side="right")
                    n = high - low
                    query, sums, fixed = np.repeat(query, n), np.repeat(sums, n), np.repeat(fixed, n)
                    node = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    widest = max(widest, len(node))
            # few queries at a time while each visits much; many once groups are joined or searches are short
            size = int(np.clip(size * VISITS / (2 * widest), 1, min(2 * size, CHUNK)))

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For every node the component that all below it belong to, or -1."""
        low = high = label
        out = [label]
        for level in self.levels[:-1]:
            starts = np.flatnonzero(np.concatenate(([True], level["up"][1:] != level["up"][:-1])))
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out


def local_links(fps: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint of its component) for all but the smallest, over the buckets given."""
    order_breaks = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    number = np.cumsum(order_breaks) - 1
    shared = np.bincount(number)[number] > 1
    fps, number = fps[shared], np.unique(number[shared], return_inverse=True)[1]
    if not len(fps):
        return fps, fps
    distinct, member = np.unique(fps, return_inverse=True)
    groups = Components(len(distinct))
    GrayIndex(fps, number).link(member, groups)
    moved = np.flatnonzero(groups.root != np.arange(len(distinct)))
    return distinct[moved], distinct[groups.root[moved]]


def _link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit and Gray rank; whole units are gathered up to about ``LIMIT`` rows."""
    held: list[np.ndarray] = []     # columns key, pair, fp
    rows = 0

    def done(part: np.ndarray) -> pa.RecordBatch:
        changes = (part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1])
        a, b = local_links(part[2].view(np.uint64), np.concatenate(([0], np.cumsum(changes))))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("key", "pair", "fp")]))
        rows += batch.num_rows
        if rows > LIMIT:
            part = np.concatenate(held, axis=1)
            changes = np.flatnonzero((part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1]))
            if len(changes):
                cut = changes[-1] + 1
                yield done(part[:, :cut])
                part = part[:, cut:]
            held, rows = [part], part.shape[1]
    if rows:
        yield done(np.concatenate(held, axis=1))


# ---- over all fingerprints ---------------------------------------------------------------------------------------

def block_keys(fp: Column, near: int = NEAR, blocks: int = BLOCKS) -> Column:
    """An array of bucket keys: for each choice of ``blocks - near`` blocks its number and the bits of those blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - near)):
        mask = sum(masks[k] for k in chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        # other numbers may share the key; that only makes a bucket larger
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def gray_rank(fp: Column) -> Column:
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


def near_links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links a > b (of columns a, b) whose components are those of all pairs within ``NEAR`` bits of the column fp."""
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(
        "key", F.ceil(F.col("n") * 2 / limit).cast("long").alias("chunks"))
    cut = keyed.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks"))
    units = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "key", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("pair"), "fp")
    sorted_units = units.repartition("key", "pair").sortWithinPartitions("key", "pair", gray_rank(F.col("fp")))
    return sorted_units.mapInArrow(_link_units, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every node of a component but the smallest, with the smallest, by large-star and small-star rounds."""
    state = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        summary = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(summary) == mark or not summary[0]:
            return state
        mark = tuple(summary)
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
            least.select("a", F.col("m").alias("b"))).distinct()
        state = stored(small, "links")


def grouped(prints: DataFrame) -> DataFrame:
    """(fp, component_id, keeper): for each fingerprint its component's smallest doc_id and whether that one has it.

    ``prints`` has doc_id and fp and should be stored, as it is read several times.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes.select("fp"))).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    labelled = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("first"))
    return labelled.join(ids, "root").select(
        "fp", F.col("first.least").alias("component_id"), (F.col("first.fp") == F.col("fp")).alias("keeper"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each component one with the smallest doc_id.

    Texts are read for their fingerprints once and shuffled once: a row is told by its doc_id and a
    hash of its text. Of rows that are equal in both, one stays.
    """
    mark = F.xxhash64("text")
    marked = docs.select("doc_id", "text", mark.alias("mark"))
    prints = stored(with_fingerprint(marked, ["doc_id", "mark"]).select("row.doc_id", "row.mark", "fp"), "prints")
    keepers = grouped(prints).where("keeper").select("fp", F.col("component_id").alias("keeper_id"))
    chosen = prints.join(keepers, "fp").where(F.col("doc_id").eqNullSafe(F.col("keeper_id"))).groupBy("fp").agg(
        F.min("keeper_id").alias("keeper_id"), F.min("mark").alias("keeper_mark"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), mark.alias("mark"))
    kept = rows.join(chosen.select("keeper_id", "keeper_mark"),
                     (F.col("mark") == F.col("keeper_mark")) & F.col("doc_id").eqNullSafe(F.col("keeper_id")))
    return kept.dropDuplicates(["keeper_mark", "keeper_id"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    prints = stored(with_fingerprint(docs, ["doc_id"]).select("row.doc_id", "fp"), "prints")
    return prints.join(grouped(prints).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
