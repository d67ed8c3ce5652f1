"""A keyed table on shared storage: what each batch changes, in hash buckets of the key, merged when it is read.

    root/rows=<first>-<last>/_bucket=<b>/     the rows that batches first..last added or changed

A batch writes its own rows only, so what it writes doesn't grow with the table. To keep the folders
few, every ``FANOUT`` batches are merged into one folder, every ``FANOUT`` of these into a larger one, and
so on: a row is written again once a level, and a reader opens at most ``FANOUT - 1`` folders a level.

Batch ids are consecutive, and there is one writer. A folder counts once Spark has marked it complete;
a batch that is run again replaces its own folder and starts from what the batches before it left. So
nothing is counted twice, whatever was done when a job stopped, and new objects over the same folder go
on where the old ones ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

FANOUT = 8
BUCKETS = 16


class TableVersions:
    """``empty`` gives the columns; rows fall in buckets by the columns ``by``, by default those of the key.

    ``by`` and ``buckets`` are properties of the folder and must stay the same.
    """

    def __init__(self, spark: SparkSession, root: str, empty: DataFrame, key: tuple[str, ...],
                 by: tuple[str, ...] | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.empty, self.key, self.by, self.buckets = spark, root, empty, list(key), list(by or key), buckets

    # folders

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self) -> list[tuple[int, int]]:
        """(first, last) of the complete folders."""
        path, system = self._path("rows=*/_SUCCESS")
        names = [f.getPath().getParent().getName().partition("=")[2] for f in system.globStatus(path) or ()]
        return sorted(tuple(map(int, n.split("-"))) for n in names)

    def read_at(self, batch_id: int) -> list[tuple[int, int]]:
        """The folders that together hold the table as batch ``batch_id`` left it: those that lie in no larger one."""
        there = [f for f in self.folders() if f[1] <= batch_id]
        return [f for f in there if not any(g != f and g[0] <= f[0] and f[1] <= g[1] for g in there)]

    def _scan(self, folders: list[tuple[int, int]], wanted: DataFrame | None = None) -> DataFrame:
        """All rows of these folders with ``_batch``; with ``wanted`` (the columns ``by``) of the buckets these fall in."""
        names = [f"{self.root}/rows={a}-{b}" for a, b in folders]
        shape = T.StructType([*self.empty.schema.fields, T.StructField("rows", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        if not names:
            return self.empty.withColumn("_batch", F.lit(0))
        out = self.spark.read.schema(shape).option("basePath", self.root).parquet(*names)
        if wanted is not None:      # at most ``buckets`` numbers
            out = out.filter(F.col("_bucket").isin([r[0] for r in wanted.select(self._bucket()).distinct().collect()]))
        return out.withColumn("_batch", F.split("rows", "-")[1].cast("int")).drop("rows", "_bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _last(self, rows: DataFrame) -> DataFrame:
        columns = self.empty.columns
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*columns), "_batch").alias("_row")).select("_row.*")

    # reading

    def version(self, batch_id: int) -> DataFrame:
        """The table as batch ``batch_id`` left it."""
        return self._last(self._scan(self.read_at(batch_id)))

    def before(self, batch_id: int) -> DataFrame:
        return self.version(batch_id - 1)

    def latest(self) -> DataFrame:
        return self.version(max([b for _, b in self.folders()], default=-1))

    def keys_before(self, batch_id: int, wanted: DataFrame) -> DataFrame:
        """The keys among ``wanted`` that were there before the batch: a scan of the key columns in the buckets of ``wanted``."""
        known = self._scan(self.read_at(batch_id - 1), wanted).select(*self.key)
        return wanted.select(*self.key).join(known, self.key, "left_semi")

    def rows_before(self, batch_id: int, wanted: DataFrame, on: list[str] | None = None) -> DataFrame:
        """The rows with a key (or other columns ``on``) among ``wanted``, as they were before the batch."""
        near = self._scan(self.read_at(batch_id - 1), wanted)
        return self._last(near.join(wanted.select(*(on or self.key)), on or self.key, "left_semi"))

    # writing

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        (rows.select(*self.empty.columns).withColumn("_bucket", self._bucket()).repartition("_bucket")
         .write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/rows={first}-{last}"))

    def put(self, batch_id: int, rows: DataFrame) -> None:
        """Keep the rows that the batch adds or changes; those that the table already has as they are, are left out."""
        self.merge(batch_id)
        content = F.xxhash64(*[F.col(c) for c in self.empty.columns])
        old = self.rows_before(batch_id, rows).select(*self.key, content.alias("_old"))
        new = rows.withColumn("_new", content).join(old, self.key, "left").filter("_old IS NULL OR _old <> _new")
        self._write(new, batch_id, batch_id)

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """As ``put``, for rows whose keys the caller knows to be new, or to be changed."""
        self.merge(batch_id)
        self._write(rows, batch_id, batch_id)

    def merge(self, batch_id: int) -> None:
        """Merge what lies before the batch, where a level is full; run ahead of each batch.

        The largest level whose size divides the number of the batch is merged at once. Folders are dropped
        a full round after they were merged, so that a frame read in between still finds them.
        """
        there = self.folders()
        merged = [g for g in there if g[1] > g[0]]
        for f in there:
            if any(g != f and g[0] <= f[0] and f[1] <= g[1] and g[1] < batch_id - FANOUT for g in merged):
                path, system = self._path(f"rows={f[0]}-{f[1]}")
                system.delete(path, True)
        size = 1
        while batch_id and batch_id % (size * FANOUT) == 0:
            size *= FANOUT
        first, last = batch_id - size, batch_id - 1
        if size > 1 and (first, last) not in there:
            parts = [f for f in self.read_at(last) if f[0] >= first]
            if len(parts) > 1:
                self._write(self._last(self._scan(parts)), first, last)
