"""Plain text and web pages as chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.html import html_text
from veilscan.sources.files import WHOLE_FILE_BYTES, file_path

#: Bytes of text that a task reads at least, where splits are smaller.
TASK_BYTES = 4 << 20
_HIGH_BYTES = bytes(range(128, 256))
_AS_LATIN = _HIGH_BYTES.decode("latin-1")
_AS_CYRILLIC = _HIGH_BYTES.decode("cp1251", errors="replace")


def decode_as(content: Column, utf8: Column) -> Column:
    """Bytes as UTF-8 where ``utf8`` holds, else as the Cyrillic Windows code page."""
    cyrillic = F.translate(F.decode(content, "ISO-8859-1"), _AS_LATIN, _AS_CYRILLIC)
    return F.when(utf8, content.cast("string")).otherwise(cyrillic)


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 where that is valid, else as the Cyrillic Windows code page."""
    return decode_as(content, F.is_valid_utf8(content.cast("string")))


def whole_file_chunks(files: DataFrame, text: Column, locator: str) -> DataFrame:
    """One chunk per file; files without text give none."""
    chunks = files.select(
        "path", F.lit(0).cast("bigint").alias("chunk_no"), text.alias("text"), F.lit(locator).alias("locator")
    )
    return chunks.filter(F.col("text") != "")


def line_number() -> Column:
    """Order of a line within its file, from the start of its split and its place in the task.

    A split of full size fills its task, so the numbers of one split end below the start of the next.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + in_task


def lines(spark: SparkSession, root: str, glob: str, above: int = -1, line_end: str | None = None) -> DataFrame:
    """Lines of all files that match a glob and are larger than ``above``, in splits.

    The size is tested before lines are numbered, so Spark leaves smaller files out of the scan. With a ``line_end`` lines
    end there alone, so that they give back every byte of the file; else at CR, LF or both.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if line_end is not None:
        reader = reader.option("lineSep", line_end)
    return (
        reader.text(root)
        .filter(F.col("_metadata.file_size") > above)
        .select(
            file_path().alias("path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")).alias("block_end"),
            line_number().alias("line_no"),
            F.col("_metadata.file_size").alias("size"),
            "value",
        )
    )


def _bytes(setting: str) -> int:
    """A size as Spark's settings write it."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def packed(rows: DataFrame) -> DataFrame:
    """Small splits gathered without a shuffle, so that a task has ``TASK_BYTES`` of them and not one; each stays whole and as it is.

    For readers that tell the splits of a task apart. Splits of that size and above keep a task each.
    """
    spark = rows.sparkSession
    per_task = TASK_BYTES // _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if per_task < 2:
        return rows
    splits = rows.rdd.getNumPartitions()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-splits // per_task))
    return rows.coalesce(tasks) if tasks < splits else rows


def text_chunks(files: DataFrame, max_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """Plain text files, each as one chunk; ``files`` holds path, size, kind and content."""
    wanted = files.filter((F.col("kind") == "text") & (F.col("size") <= max_bytes))
    return whole_file_chunks(wanted, decode_text(F.col("content")), "full")


def html_chunks(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Visible text of web pages; ``max_chars`` reads only their beginning."""
    page = decode_text(F.col("content"))
    if max_chars is not None:
        page = F.substring(page, 1, max_chars)
    return whole_file_chunks(files.filter(F.col("kind") == "html"), html_text(page), "html")

