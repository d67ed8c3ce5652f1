"""Hard negatives of anchors: rows of another label that score nearly as high as the anchor's own positives.

1. Rows are laid out along a Hilbert curve within their label and cut into blocks of at most ``BLOCK``
   rows; a block is one row of a Parquet table, with the least and largest value of each dimension (its zone).
2. An anchor asks for windows of scores. Interval arithmetic over a zone bounds the scores of a block from
   both sides; only blocks whose bounds meet a window are read for that anchor, and the scores within are
   exact. Positives are the first asked for: their window begins at the score of the best in the anchor's
   own block, its neighbours on the curve. The windows of the negatives follow from the positives.
3. Each block gives at most as many rows for a window as are asked for; the best of all blocks stay.

Anchors come to the blocks, in a stream: a task holds one block and one batch of anchors. Anchors are a
stated share of all rows and meet zones and blocks by key; nothing is broadcast, no pair of rows is a row.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a
shorter vector counts as filled up with zeros; a null id is no anchor and comes last among ties; equal ids
are rows of their own, told apart by their place in storage; no row, no result. Scores must stay below
2^62, else a ValueError says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BLOCK, ZONES = 2048, 4096
PLANES = 4              # bits of each dimension on the curve
POSITIVES, NEGATIVES = 5, 3
SCALE = 256
#: A zone or block (kind 0: its number in ``id``, values in ``body``), or an anchor (kind 1: ``low`` and ``high`` are its windows).
VISIT = "key long, kind int, id long, label int, body binary, low binary, high binary, ids array<long>, places array<long>"
NONE = np.iinfo(np.int64).max       # stands for a null id: comes last
FAR = 1 << 62                       # beyond all scores


def floats(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", dtype=np.float64)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as whole numbers, in 8 bytes each; rows that take no part are left out."""
    for batch in batches:
        lists = batch.column("vector")
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)     # null is not a number here
        row = np.repeat(np.arange(len(sizes)), sizes)
        keep = np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) == 0
        values, row, sizes = values[keep[row]], row[keep[row]], sizes[keep]
        largest = np.zeros(len(keep))
        np.maximum.at(largest, row, np.abs(values))
        offsets = np.concatenate(([0], np.cumsum(sizes * 8)))
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).filter(pa.array(keep)) for c in ("id", "label", "anchor")], body.cast(pa.binary()), pa.array(sizes, pa.int32()),
             pa.array(largest[keep])], ["id", "label", "anchor", "body", "width", "largest"])


def filled(bodies: list[bytes], width: int) -> np.ndarray:
    if all(len(b) == 8 * width for b in bodies):
        return np.frombuffer(b"".join(bodies), dtype=np.float64).reshape(len(bodies), width)
    out = np.zeros((len(bodies), width))
    for row, body in zip(out, bodies):
        v = floats(body)
        row[:len(v)] = v
    return out


def hilbert_keys(values: np.ndarray, largest: float) -> list[bytes]:
    """The place of each row on a Hilbert curve through cells of 2^PLANES steps in each dimension, as bytes that sort alike."""
    n, width = values.shape
    step = 2 * largest + 1
    x = np.minimum(((values + largest) * ((1 << PLANES) / step)).astype(np.int64), (1 << PLANES) - 1).T.copy()
    # to the transposed index: undo turns and mirrors from the top bit down, then take the Gray code back
    for bit in (1 << k for k in range(PLANES - 1, 0, -1)):
        low = bit - 1
        for d in range(width):
            up = (x[d] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, swap)
            x[d] ^= swap
    for d in range(1, width):
        x[d] ^= x[d - 1]
    turn = np.zeros(n, dtype=np.int64)
    for bit in (1 << k for k in range(PLANES - 1, 0, -1)):
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0) if width else 0
    x ^= turn
    planes = [(x >> k) & 1 for k in range(PLANES - 1, -1, -1)]
    bits = np.concatenate(planes).T.astype(np.uint8) if width else np.zeros((n, 8), np.uint8)
    return [r.tobytes() for r in np.packbits(bits, axis=1)]


def _keyed(width: int, largest: float):
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                values = filled(part.column("body").to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("id", "label", "anchor", "place")], pa.array([r.tobytes() for r in values], pa.binary()),
                     pa.array(hilbert_keys(values, largest), pa.binary())], ["id", "label", "anchor", "place", "body", "curve"])
    return key


def _blocks(width: int):
    """Rows come sorted by label and curve; a block ends with its label or when it is full. Its rows are sorted by id, for ties."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held, label = [], None

        def block():
            held.sort(key=lambda r: (NONE if r[0] is None else r[0], r[1]))
            values = np.frombuffer(b"".join(r[3] for r in held), dtype=np.float64).reshape(len(held), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([label], pa.int32()), pa.array([values.tobytes()], pa.binary()),
                 pa.array([values.min(axis=0).tobytes()], pa.binary()), pa.array([values.max(axis=0).tobytes()], pa.binary()),
                 pa.array([[r[0] for r in held]], pa.list_(pa.int64())), pa.array([[r[1] for r in held]], pa.list_(pa.int64())),
                 pa.array([[r[2] for r in held]], pa.list_(pa.bool_()))],
                ["id", "label", "body", "low", "high", "ids", "places", "anchors"])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "place", "anchor", "body", "label")]
            for *row, own in zip(*columns):
                if held and (own != label or len(held) == BLOCK):
                    yield block()
                    number, held = number + 1, []
                label = own
                held.append(row)
        if held:
            yield block()
    return cut


def matrix(body: bytes, width: int, whole: bool) -> np.ndarray:
    """Rows of values; as 64-bit numbers where products don't fit a float's 53 bits."""
    values = floats(body).reshape(-1, width) if width else np.zeros((0, 0))
    return values.astype(np.int64) if whole else values


def _seeds(width: int, whole: bool):
    """Each anchor of a block with one window, for its positives: from the best scores in its own block on."""
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                places, anchors = batch.column("places")[k].as_py(), np.array(batch.column("anchors")[k].as_py(), dtype=bool)
                at = np.flatnonzero(anchors)
                if not len(at):
                    continue
                values = matrix(batch.column("body")[k].as_py(), width, whole) if width else np.zeros((len(places), 0))
                low = np.full(len(at), -FAR)
                for start in range(0, len(at), 256):
                    some = at[start:start + 256]
                    scores = (values[some] @ values.T).astype(np.int64)
                    scores[np.arange(len(some)), some] = -FAR
                    if len(places) > POSITIVES:
                        low[start:start + 256] = np.partition(scores, -POSITIVES, axis=1)[:, -POSITIVES]
                ids = batch.column("ids")[k].as_py()
                label = batch.column("label")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([places[i] for i in at], pa.int64()), pa.array([ids[i] for i in at], pa.int64()), pa.array([label] * len(at), pa.int32()),
                     pa.array([np.asarray(values[i], dtype=np.float64).tobytes() for i in at], pa.binary()),
                     pa.array([low[i:i + 1].tobytes() for i in range(len(at))], pa.binary()), pa.array([np.array([FAR]).tobytes()] * len(at), pa.binary())],
                    ["id", "anchor_id", "label", "body", "low", "high"])
    return seed


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch with one key and kind."""
    key, kind = batch.column("key").to_numpy(), batch.column("kind").to_numpy()
    cuts = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
    for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
        if stop > start:
            yield int(kind[start]), batch.slice(start, stop - start)


def anchors_of(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, and the windows' low and high ends, a row for each anchor."""
    n = part.num_rows
    low, high = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.int64).reshape(n, -1) for c in ("low", "high"))
    return np.frombuffer(b"".join(part.column("body").to_pylist()), dtype=np.float64).reshape(n, width), low, high


def _choose(width: int, same: bool, bounded: bool):
    """For each anchor and block that it must read: the anchor's row under the block's number. Zones of a key come first."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, zones = None, []
        for batch in batches:
            for kind, part in runs(batch):
                own = part.column("key")[0].as_py()
                if own != key:
                    key, zones = own, []
                if kind == 0:
                    zones.append(part)
                    continue
                number = np.concatenate([z.column("id").to_numpy() for z in zones]) if zones else np.zeros(0, np.int64)
                if not len(number):
                    continue
                label = np.concatenate([z.column("label").to_numpy() for z in zones])
                least, most = (np.frombuffer(b"".join(b for z in zones for b in z.column(c).to_pylist()), dtype=np.float64).reshape(len(number), width)
                               for c in ("low", "high"))
                for start in range(0, part.num_rows, 512):
                    some = part.slice(start, 512)
                    values, low, high = anchors_of(some, width)
                    wanted = (some.column("label").to_numpy()[:, None] == label) == same
                    if bounded:
                        up, down = np.maximum(values, 0), np.minimum(values, 0)
                        upper, lower = up @ most.T + down @ least.T, up @ least.T + down @ most.T
                        meets = np.zeros_like(wanted)
                        for w in range(low.shape[1]):
                            meets |= (upper >= low[:, w:w + 1]) & (lower <= high[:, w:w + 1])
                        wanted &= meets
                    block, who = np.nonzero(wanted.T)
                    for at in range(0, len(who), 2048):
                        found = some.take(pa.array(who[at:at + 2048]))
                        yield found.set_column(0, "key", pa.array(number[block[at:at + 2048]]))
    return choose


def _read(width: int, same: bool, whole: bool, most: int):
    """The best ``most`` rows of a block in each window of each anchor. The block comes first."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = ids = places = None
        for batch in batches:
            for kind, part in runs(batch):
                if kind == 0:
                    places = np.array(part.column("places")[0].as_py(), dtype=np.int64)
                    ids = part.column("ids")[0].values
                    values = matrix(part.column("body")[0].as_py(), width, whole) if width else np.zeros((len(places), 0))
                    continue
                for start in range(0, part.num_rows, 256):
                    some = part.slice(start, 256)
                    own, low, high = anchors_of(some, width)
                    scores = (own.astype(np.int64) if whole else own) @ values.T
                    order = np.argsort(-scores, axis=1, kind="stable")      # rows lie by id, so ties do, too
                    falling = -np.take_along_axis(scores, order, axis=1)
                    if same:    # an anchor isn't its own positive
                        self_ = places[order] == some.column("id").to_numpy()[:, None]
                    out = [[] for _ in range(4)]
                    for a in range(some.num_rows):
                        line = falling[a]
                        starts, stops = np.searchsorted(line, -high[a], side="left").tolist(), np.searchsorted(line, -low[a], side="right").tolist()
                        for w, (first, stop) in enumerate(zip(starts, stops)):
                            if first >= stop:
                                continue
                            if same:
                                at = np.flatnonzero(~self_[a, first:min(stop, first + most + 1)])[:most] + first
                            else:
                                at = np.arange(first, min(stop, first + most))
                            out[0] += [a] * len(at)
                            out[1] += [w] * len(at)
                            out[2] += (-line[at]).astype(np.int64).tolist()
                            out[3] += order[a, at].tolist()
                    rows = np.array(out[3], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                         ids.take(pa.array(rows)), pa.array(places[rows], pa.int64())], ["id", "window", "score", "found", "place"])
    return read


def visited(key: Column, kind: int, rows: DataFrame, *null: str) -> DataFrame:
    """Rows in the shape of VISIT; the columns named ``null`` are left out."""
    kinds = {"ids": "array<long>", "places": "array<long>", "body": "binary", "low": "binary", "high": "binary"}
    own = [(F.lit(None).cast(kinds[c]) if c in null else F.col(c)).alias(c) for c in ("id", "label", "body", "low", "high", "ids", "places")]
    return rows.select(key.cast("long").alias("key"), F.lit(kind).alias("kind"), *own)


def met(first: DataFrame, then: DataFrame) -> DataFrame:
    """Both kinds of rows, dealt by key, the first kind ahead."""
    return first.unionByName(then).repartition("key").sortWithinPartitions("key", "kind", "id")


class Layout:
    """The stored blocks, and what their values allow."""

    def __init__(self, rows: DataFrame, anchor: Column):
        """``rows``: vec_id, label, embedding; ``anchor`` says which of them are anchors."""
        given = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"),
                            F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector"))
        clean = stored(given.where("label is not null and vector is not null").mapInArrow(
            _clean, "id long, label int, anchor boolean, body binary, width int, largest double"), "vectors")
        width, largest = clean.agg(F.max("width"), F.max("largest")).first()
        self.width, largest = width or 0, largest or 0.0
        product = largest * largest * max(self.width, 1)
        if product >= FAR:
            raise ValueError("inner products of these vectors may pass 2^62")
        self.whole = product >= 2 ** 52
        # the place in storage names a row: files are fixed once written
        placed = clean.select("id", "label", "anchor", "body", F.monotonically_increasing_id().alias("place"))
        keyed = placed.mapInArrow(_keyed(self.width, largest), "id long, label int, anchor boolean, place long, body binary, curve binary")
        sorted_ = keyed.repartitionByRange("label", "curve", "place").sortWithinPartitions("label", "curve", "place")
        self.blocks = stored(sorted_.mapInArrow(
            _blocks(self.width), "id long, label int, body binary, low binary, high binary, ids array<long>, places array<long>, anchors array<boolean>"), "blocks")
        spark = rows.sparkSession
        self.units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.blocks.count() // ZONES))

    def anchors(self) -> DataFrame:
        return self.blocks.select("id", "label", "body", "ids", "places", "anchors").mapInArrow(
            _seeds(self.width, self.whole), "id long, anchor_id long, label int, body binary, low binary, high binary")

    def best(self, anchors: DataFrame, same: bool, most: int) -> DataFrame:
        """(id, window, score, found, place, rank): the best rows of the same, or of other labels, in each window of each anchor.

        ``anchors``: id (their place), label, body, low, high.
        """
        zones = visited(F.pmod(F.xxhash64("id"), F.lit(self.units)), 0, self.blocks, "body", "ids", "places")
        asked = anchors.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(self.units - 1))))
        chosen = stored(met(zones, visited(F.col("unit"), 1, asked, "ids", "places")).mapInArrow(
            _choose(self.width, same, not self.whole), VISIT), "chosen")
        needed = self.blocks.join(chosen.select(F.col("key").alias("id")).distinct(), "id", "left_semi")
        found = met(visited(F.col("id"), 0, needed, "low", "high"), chosen).mapInArrow(
            _read(self.width, same, self.whole, most), "id long, window int, score long, found long, place long")
        order = Window.partitionBy("id", "window").orderBy(F.desc("score"), F.asc_nulls_last("found"), "place")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From half of each positive score to 95 hundredths of it; ends that cross are a window without scores, as are those added."""
    for batch in batches:
        scores = batch.column("scores").to_pylist()
        low = [np.array([*[-(-50 * s // 100) for s in v], *[FAR] * (POSITIVES - len(v))], dtype=np.int64).tobytes() for v in scores]
        high = [np.array([*[95 * s // 100 for s in v], *[-FAR] * (POSITIVES - len(v))], dtype=np.int64).tobytes() for v in scores]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("body"), pa.array(low, pa.binary()), pa.array(high, pa.binary())],
                                         ["id", "label", "body", "low", "high"])


def mined(rows: DataFrame, anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    layout = Layout(rows, anchor)
    anchors = stored(layout.anchors(), "anchors")
    positives = layout.best(anchors.drop("anchor_id"), True, POSITIVES)
    lists = stored(positives.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "found"))).alias("positives")), "positives")   # five at most
    asked = anchors.select("id", "label", "body").join(lists.select("id", F.col("positives.score").alias("scores")), "id")
    negatives = layout.best(asked.mapInArrow(_windows, "id long, label int, body binary, low binary, high binary"), False, NEGATIVES)
    own = lists.join(anchors.select("id", "anchor_id"), "id").select("id", "anchor_id", F.posexplode("positives").alias("window", "positive"))
    return negatives.select("id", "window", "rank", "found", "score").join(own, ["id", "window"]).select(
        "anchor_id", F.col("positive.found").alias("positive_id"), "rank", F.col("found").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
