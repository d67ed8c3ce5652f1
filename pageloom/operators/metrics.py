"""Counts per stage."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import stored, stored_by


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass, with no extra job; read ``observation.get`` after an action."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), F.min(F.current_timestamp()).alias("started")), watch


def stage_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("profile_id", "referring_source_id", "keyword").agg(F.count("*").alias("results"))


class StageLog:
    """How long each stage of a run took, and its rows by profile."""

    def __init__(self):
        self.stages: list[tuple[str, float, DataFrame]] = []

    def written(self, df: DataFrame, stage: str, by: str | None = None, parts: int = 0) -> DataFrame:
        """Write a stage once to the shared folder, in buckets of a key or as it comes; the time is that of writing it."""
        start = time.monotonic()
        out = stored_by(df, stage, by, parts) if by else stored(df, stage, compression="zstd")
        self.stages.append((stage, time.monotonic() - start, out))
        return out

    def settle(self) -> None:
        """Count the rows of the stages so far, whose files are not read again by ``table``."""
        self.stages = [(stage, seconds, stored(self._counted(frame), "counted")) for stage, seconds, frame in self.stages]

    def _counted(self, frame: DataFrame) -> DataFrame:
        return frame if frame.columns == ["profile_id", "rows"] else frame.groupBy("profile_id").agg(F.count("*").alias("rows"))

    def table(self) -> DataFrame:
        """(stage, profile_id, rows, seconds): a row for each stage and profile, seconds those of the whole stage."""
        rows = None
        for stage, seconds, frame in self.stages:
            one = self._counted(frame).select(
                F.lit(stage).alias("stage"), "profile_id", "rows", F.lit(seconds).alias("seconds"))
            rows = one if rows is None else rows.unionByName(one)
        return rows
