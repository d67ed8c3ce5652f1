"""Session settings and the shared working folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "pageloom", cpus: int | str = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # fewer calls per expression
        .getOrCreate()
    )


_OWN: dict[str, str] = {}       # by application


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, which has one machine, may do without: it gets a temporary folder. On a
    cluster a folder on one machine would be lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="pageloom-")
    return _OWN[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/pageloom/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *cluster_by: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several consumers would otherwise each recompute an expensive plan. The
    files outlive executors, so a lost executor costs no recomputation. ``zstd`` makes smaller files of texts.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    out = df.repartition(*cluster_by) if cluster_by else df
    out.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, key: str, parts: int, compression: str = "zstd", lies_so: bool = False) -> DataFrame:
    """As ``stored``, in ``parts`` buckets of ``key``: joins of such frames by the key, and groups by it, read them where they lie.

    Rows that are dealt or read so, but whose plan doesn't say it any more, needn't be exchanged: ``lies_so``.
    Only a table's files keep buckets, so the frame is read as a table, whose name is given up at once; the files stay.
    """
    spark = df.sparkSession
    name = f"pageloom_{uuid.uuid4().hex}"
    out = df if lies_so else df.repartition(parts, key)
    (out.write.bucketBy(parts, key).option("path", fresh_path(spark, label)).option("compression", compression)
     .saveAsTable(name, format="parquet"))
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that ``stored`` or ``stored_by`` wrote, and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == "pageloom":
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end inside go with them, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """One exchange by key ahead of a step that costs far more per row than moving the row.

    For inputs that lie in few files: a file of one row group is one task otherwise. The caller knows; no
    operator does this by itself.
    """
    # a stated number, as adaptive execution would join small parts into one task again
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# Fixed value: rows of one task where many narrow rows are joined or made distinct by key; a sort or hash table holds them all.
ROWS_PER_TASK = 400_000


def in_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """Exchanged by key into tasks of about ``ROWS_PER_TASK`` rows, which are counted; a stream, which can't be, stays as it is.

    A fixed number of tasks would grow with the table, and adaptive execution joins parts by their compressed size, far
    below that of their rows. Counting should be cheap: a given table, or one that was written.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_TASK))
    return df.repartition(tasks, *keys)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
