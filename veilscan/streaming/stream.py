"""The scan as a stream: new files or rows are searched once, and a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilscan.functions.text import rows_from_locator
from veilscan.operators.dedup import content_hash
from veilscan.operators.detect import MIN_CONFIDENCE, explode_spans, with_spans
from veilscan.operators.findings import combine_spans
from veilscan.sources.files import describe, file_name_glob, file_path

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, root: str, extensions: tuple[str, ...], watermark: str | None = None) -> DataFrame:
    """New files below ``root``, each content once, however much later a copy arrives.

    The hashes of all contents are kept in the state store (RocksDB suits very many files). A ``watermark`` bounds that state: then
    copies that are found within it of each other come once, and a later one is searched again. It runs on the time a
    file is found, not on the file's own time, so that an old file is searched like any other.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY)
        .option("recursiveFileLookup", "true")
        # the source itself would leave out files that are a week older than the newest one
        .option("maxFileAge", "36500d")
        .option("pathGlobFilter", file_name_glob(extensions))
        .load(root)
        .select(
            file_path().alias("path"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("mtime"),
            "content",
            content_hash(F.col("content")).alias("content_hash"),
            F.current_timestamp().alias("found"),
        )
    )
    if watermark is None:
        unique = files.dropDuplicates(["content_hash"])
    else:
        unique = files.withWatermark("found", watermark).dropDuplicatesWithinWatermark(["content_hash"])
    return describe(unique.drop("found"), root)


def stream_spans(chunks: DataFrame) -> DataFrame:
    """Exploded spans of a stream of chunks. The stage is narrow and keeps no state."""
    measured = chunks.select(
        "path",
        "chunk_no",
        "text",
        F.lit(None).cast("string").alias("error"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("text_length"),
        rows_from_locator(F.col("locator")).alias("rows_processed"),
    )
    return explode_spans(with_spans(measured), ["path", "chunk_no", "error", "text_length", "rows_processed"])


def start_scan(chunks: DataFrame, out: str, checkpoint: str, once: bool = True, masking: str = "partial", min_confidence: float = MIN_CONFIDENCE) -> StreamingQuery:
    """Search new chunks and write the combined findings of each batch to a folder of its own below ``out``.

    Only hashes, masks and counts are written, never the values. A batch that is tried again overwrites its own folder, so a
    restart counts nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        combine_spans(batch, min_confidence, masking).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream_spans(chunks).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def scanned_so_far(spark: SparkSession, out: str, store_value_hash: bool = True) -> DataFrame:
    """The combined spans of all batches, as a batch scan gives them; one row per file, value and batch is read."""
    combined = (
        spark.read.parquet(out)
        .groupBy("path", "category", "value_hash", "value_masked", "error")
        .agg(
            F.min_by("confidence", "seen").alias("confidence"),
            F.min("seen").alias("seen"),
            F.sum("occurrences").alias("occurrences"),
            F.sum("text_length").alias("text_length"),
            F.sum("rows_processed").alias("rows_processed"),
        )
    )
    if store_value_hash:
        return combined
    return combined.withColumn("value_hash", F.when(F.col("category").isNotNull(), F.lit("")))
