"""Sharding by vector bin packing: groups of equal texts go to shards that have room in bytes, tokens and rows.

The law kept is ``bytes``: the sizes of the shards are near equal. Placing is greedy: vectors of
(bytes, tokens, rows), each as a share of the whole, are taken by falling size; each goes to the
shard, among those whose room in bytes holds it (else those with most room), where its dot product
with the residual capacity is highest.

The driver never sees a row for each group. A group of at least 1/``LARGE`` of all bytes or of all rows is
placed by itself (there are at most twice ``LARGE``); all others are gathered by a hash of the text into
``BUNDLES`` bundles, whose sums alone are placed. A fixed sixteenth of the hash space makes half
the bundles; these small ones come last and even out the rest. A group larger than a shard's
capacity, which no shard could hold, is dealt in ``PIECES`` equal pieces; every other group of
equal texts is in one shard.

A slot is the cell's place in its shard plus the row's place in its cell; cells are bounded in
number, and large ones are cut by a hash of the id, so no task numbers the rows of a whole shard.

Defined results: a null text has size 1 and is its own group (with the empty text, as their
bytes are equal); repeated rows are rows of their own; ties in a cell go by doc_id. Two texts
with equal hashes would share a group, which breaks no law. The number of shards is a parameter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

LARGE, BUNDLES, PIECES = 2048, 4096, 64


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens, the group's hash, and a hash that cuts large groups."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.xxhash64(text).alias("grp"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("piece")), F.lit(PIECES)).cast("int").alias("piece"))


def bundle_of(grp):
    """1/16 of the hashes in the second half of the bundles, the others in the first half."""
    half, h = BUNDLES // 2, F.xxhash64(grp, F.lit("bundle"))
    low = F.pmod(F.shiftright(h, 8), F.lit(half))
    return F.when(F.pmod(h, F.lit(16)) == 0, low + half).otherwise(low)


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (rows: bytes, tokens, rows), by the greedy rule above; equal in every run."""
    total = np.maximum(vectors.sum(axis=0), 1)
    share = vectors / total
    residual = np.full((shards, 3), 1 / shards)
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-vectors[:, 0], kind="stable"):
        room = residual[:, 0]
        fits = room >= share[i, 0]
        if not fits.any():
            fits = room >= room.max()
        out[i] = k = np.flatnonzero(fits)[np.argmax(residual[fits] @ share[i])]
        residual[k] -= share[i]
    return out


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    rows = stored(measured(docs), "sharding")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    large = rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(
        (F.col("bytes") * LARGE >= total) | (F.col("n") * LARGE >= n_rows))
    large = {r["grp"]: r["bytes"] for r in large.toLocalIterator()}    # at most 2 * LARGE groups
    names = spark.createDataFrame([(g, k) for k, g in enumerate(sorted(large))], "grp long, large int")
    marked = rows.join(F.broadcast(names), "grp", "left").withColumns({
        "cell": F.when(F.col("large").isNotNull(), F.lit(BUNDLES) + F.col("large")).otherwise(bundle_of(F.col("grp"))),
        "piece": F.when(F.col("large").isNotNull(), F.col("piece")).otherwise(0),
    }).withColumn("cell", F.col("cell").cast("long"))
    cells = marked.groupBy("cell", "piece").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("cell", "piece").toPandas()
    whole = np.array([BUNDLES + k for k, g in enumerate(sorted(large)) if large[g] * shards <= total])
    # a cell that stays whole is one item; the pieces of a group that no shard can hold are items of their own
    item = np.where((cells["cell"] < BUNDLES) | cells["cell"].isin(whole), cells["cell"] * PIECES, cells["cell"] * PIECES + cells["piece"])
    _, item = np.unique(item, return_inverse=True)
    vectors = np.zeros((item.max() + 1 if len(item) else 0, 3))
    for k, column in enumerate(("bytes", "tokens", "n")):
        np.add.at(vectors[:, k], item, cells[column].to_numpy(dtype=np.float64))
    cells["shard"] = place(vectors, shards)[item]
    cells["base"] = cells.groupby("shard")["n"].cumsum() - cells["n"]
    known = spark.createDataFrame(
        [tuple(map(int, x)) for x in cells[["cell", "piece", "shard", "base"]].itertuples(index=False)],
        "cell long, piece int, shard int, base long")
    in_cell = Window.partitionBy("cell", "piece").orderBy("doc_id", "grp", "size")
    placed = marked.select("doc_id", "size", "text_crc32", "grp", "cell", "piece").withColumn("place", F.row_number().over(in_cell))
    # at most BUNDLES + 2 * LARGE * PIECES rows of four numbers, whatever the input
    return placed.join(F.broadcast(known), ["cell", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place") - 1).alias("slot"))
