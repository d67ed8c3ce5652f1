"""Structured Streaming forms of the seen sets, upserts and counts.

All jobs take a streaming frame and return either a streaming frame or a started query, so
trigger and checkpoint are the caller's choice. ``run_available`` drains what is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..operators import crawl
from ..operators.index import failed_keys, index_batch
from ..operators.keyed_table import TableVersions
from ..session import fresh_path


def file_stream(spark: SparkSession, folder: str, name: str, schema, per_batch: int | None = None) -> DataFrame:
    """A table of a folder as a stream: a parquet file of that name, or a folder of parquet files."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    # a pattern, as the source takes what is named without one for the base of partition folders, which a file can't be
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}")


# The state store that keeps keys on disk, and what bounds its memory.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def state_on_disk(spark: SparkSession) -> None:
    """Queries started from now on keep their state on disk, with bounded memory on each machine.

    Without it state lies in the executors' memory, which a set of all hosts ever seen outgrows.
    """
    for name, value in ON_DISK.items():
        spark.conf.set(name, value)


def run_available(stream: DataFrame, label: str, mode: str = "append", state: str | None = None, out: str | None = None) -> DataFrame:
    """Run over all data there is, then return what was written, by this run and by those before it with the same folders.

    ``state`` and ``out`` are the folders that a later run goes on from; by default new ones.
    """
    spark = stream.sparkSession
    out, state = out or fresh_path(spark, label), state or fresh_path(spark, f"{label}-state")
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state)
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, label: str, each: Callable[[DataFrame, int], None],
                mode: str = "append", interval: str | None = None, state: str | None = None) -> StreamingQuery:
    """``foreachBatch``; with ``interval`` it repeats for ever.

    ``state`` is the folder that a later run with the same one goes on from; by default a new one.
    """
    writer = (stream.writeStream.foreachBatch(each).outputMode(mode)
              .option("checkpointLocation", state or fresh_path(stream.sparkSession, f"{label}-state")))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def seen_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Each host once, the first time it is met. Hosts are kept for ever: see ``state_on_disk``."""
    return pages.select(urls.host_url(url).alias("host")).filter("host is not null").dropDuplicates(["host"])


def seen_urls(visits: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once; a repeat within the delay is dropped, state older than it is freed."""
    return visits.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def newest_comment(comments: DataFrame, page: str, ts: str) -> DataFrame:
    """Newest date per page as running state (update mode)."""
    return comments.groupBy(page).agg(F.max(ts).alias("newest"))


def stage_windows(log: DataFrame, stage: str, ts: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows per stage and tumbling window; a window is given out once it is closed."""
    return (log.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), stage)
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), stage, "n"))


def page_upserts(sources: TableVersions, index: TableVersions, blacklist: TableVersions,
                 profiles: DataFrame, as_of) -> Callable[[DataFrame, int], None]:
    """Batch step: sources, pages and blacklist of one micro-batch of documents. The tables merge their own folders."""
    def each(batch: DataFrame, batch_id: int) -> None:
        index_batch({"sources": sources, "pages": index}, batch_id, batch.filter("outcome = 'success'"), profiles, as_of)
        failed = failed_keys(batch.filter("outcome <> 'success'"))
        blacklist.add(batch_id, failed.join(blacklist.keys_before(batch_id, failed), blacklist.key, "left_anti"))
    return each


def extraction_step(extract: Callable[[DataFrame], DataFrame], sink: str) -> Callable[[DataFrame, int], None]:
    """Batch step: run a batch extractor and keep its rows under the batch number."""
    def each(batch: DataFrame, batch_id: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return each


def crawl_rounds(scrapes: TableVersions, work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Batch step for a stream of ticks: do the scrapes that are due, then move each on by its own interval.

    ``scrapes`` (scrape_id, every_days, due_at) begins as batch 0; round n is its batch n + 1. A round that is run
    again finds the same scrapes due.
    """
    def each(ticks: DataFrame, round_: int) -> None:
        tick = ticks.agg(F.max("tick")).first()[0]
        if tick is None:
            return
        now = F.lit(str(tick)).cast("timestamp_ntz")
        due = crawl.due(scrapes.before(round_ + 1), now)
        work(due, round_)
        scrapes.add(round_ + 1, crawl.advanced(due, now))
    return each
