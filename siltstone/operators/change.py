"""Comparing a listing of files with what a store has recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.incremental import newest_observation


def statuses(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, status``: new, changed, unchanged, unfinished (recorded without durable vectors) or unlisted.

    A full outer join on the path of the newest observation and the record.
    """
    seen = newest_observation(listing)
    own = files.select(F.col("path").alias("_path"), F.lower(F.coalesce("hash", F.lit(""))).alias("hash"))
    both = seen.join(own, F.col("path") == F.col("_path"), "full")
    status = (
        F.when(F.col("path").isNull(), "unlisted").when(F.col("_path").isNull(), "new").when(F.col("hash") == "", "unfinished").when(F.col("hash") == F.col("seen_hash"), "unchanged").otherwise("changed")
    )
    return both.select(F.coalesce("path", "_path").alias("path"), status.alias("status"))


def vanished(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Recorded files that no listing shows: what a sweep removes."""
    return files.join(newest_observation(listing).select("path"), "path", "left_anti")


def admissible(batch: DataFrame, listing: DataFrame, recorded: DataFrame) -> DataFrame:
    """Paths of an event batch that a walk would yield, and those that are recorded but gone."""
    on_disk = batch.join(listing.select("path").distinct(), "path", "left_semi")
    gone = batch.join(listing.select("path").distinct(), "path", "left_anti").join(recorded.select("path"), "path", "left_semi")
    return on_disk.unionByName(gone).distinct()


def store_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, chunks of durable files, bytes."""
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    c = chunks.agg(F.count("*").alias("chunks"))
    durable = chunks.join(files.where("hash <> ''").select("file_id"), "file_id", "left_semi").agg(F.count("*").alias("durable_chunks"))
    return f.crossJoin(c).crossJoin(durable)  # single rows
