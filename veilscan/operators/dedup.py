"""Exact duplicates by content hash.

A group of copies may hold a large part of all files. So groups are only ever reduced by
aggregations that combine before the shuffle, and the one join from copies to their original spreads
each group over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Copies of one group are spread over this many join keys.
SALTS = 32
# Rows of the duplicate block of the profile.
TOP_GROUPS = 15
PATHS_PER_GROUP = 5


def content_hash(content: Column) -> Column:
    """SHA-256 of text or bytes, so that equal hashes mean equal content."""
    return F.sha2(content.cast("binary"), 256)


def first_paths(files: DataFrame) -> DataFrame:
    """Lowest path and number of files per hash; files without a hash take no part."""
    return (
        files.filter(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("copies"))
    )


def keep_first(files: DataFrame) -> DataFrame:
    """One file per content, that with the lowest path; files without a hash all stay."""
    firsts = first_paths(files).select(F.col("first_path").alias("path"))
    unhashed = files.filter(F.col("content_hash").isNull())
    # the join key is the path, which is unique, so no group of copies meets in one task
    return files.filter(F.col("content_hash").isNotNull()).join(firsts, "path", "left_semi").unionByName(unhashed)


def duplicate_map(files: DataFrame) -> DataFrame:
    """Each copy with the file it repeats."""
    groups = first_paths(files).filter(F.col("copies") > 1).select("content_hash", "first_path")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = files.filter(F.col("content_hash").isNotNull()).select(
        "path", "content_hash", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt")
    )
    return (
        salted.join(spread, ["content_hash", "salt"])
        .filter(F.col("path") != F.col("first_path"))
        .select("path", F.col("first_path").alias("duplicate_of"))
    )


def duplicate_totals(files: DataFrame) -> DataFrame:
    """One row: distinct contents and the copies beyond the first."""
    return first_paths(files).agg(
        F.count(F.lit(1)).alias("total_unique"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("total_duplicates"),
    )


def _within(max_bytes: int | None) -> Column:
    """All sizes, unless the caller wants a limit."""
    return F.lit(True) if max_bytes is None else F.col("size") <= max_bytes


def _sized_groups(files: DataFrame, max_bytes: int | None) -> DataFrame:
    return (
        files.filter(_within(max_bytes) & F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))
    )


def duplicate_summary(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row: scanned, skipped, unique, groups, copies and the megabytes they take."""
    large = ~_within(max_bytes)
    groups = files.groupBy(F.when(~large, F.col("content_hash")).alias("content_hash"), large.alias("large")).agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("copies")
    )
    hashed = ~F.col("large") & F.col("content_hash").isNotNull()
    extra = F.when(hashed, F.col("copies") - 1)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return groups.agg(
        total(F.when(~F.col("large"), F.col("copies"))).alias("scanned"),
        total(F.when(F.col("large"), F.col("copies"))).alias("skipped_too_large"),
        F.count_if(hashed).alias("unique_files"),
        F.count_if(extra > 0).alias("duplicate_groups"),
        total(extra).alias("total_duplicates"),
        F.round(F.coalesce(F.sum(F.col("size") * extra), F.lit(0)) / 1024**2, 2).alias("bytes_saved_mb"),
    )


def largest_groups(
    files: DataFrame, groups: int = TOP_GROUPS, paths: int = PATHS_PER_GROUP, max_bytes: int | None = None
) -> DataFrame:
    """The groups with most copies and the first paths of each, one row per path."""
    ranked = (
        _sized_groups(files, max_bytes)
        .filter(F.col("copies") > 1)
        .orderBy(F.desc("copies"), "first_path")
        .limit(groups)
        .select("content_hash", "copies", F.round(F.col("size") / 1024, 2).alias("size_kb"))
    )
    rank = F.row_number().over(W.partitionBy("content_hash").orderBy("path"))
    # at most ``groups`` rows are broadcast; the rank limit is applied before the shuffle as well
    return (
        files.filter(_within(max_bytes))
        .join(F.broadcast(ranked), "content_hash")
        .withColumn("path_no", rank)
        .filter(F.col("path_no") <= paths)
        .select("content_hash", "size_kb", "copies", "path_no", "path")
    )
