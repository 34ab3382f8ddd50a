"""The scan of a file tree, from listing to reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.files import SNIFFED_KINDS, extensions_of
from veilscan.operators.dedup import content_hash, duplicate_map, keep_first
from veilscan.operators.findings import findings, scan_chunks
from veilscan.operators.reports import file_reports
from veilscan.session import shared_dir
from veilscan.sources.delimited import large_csv_chunks
from veilscan.sources.documents import html_chunks, text_chunks
from veilscan.sources.files import (
    WHOLE_FILE_BYTES,
    Decoder,
    binary_files,
    decoded_chunks,
    describe,
    file_name_glob,
    not_ignored,
    relative_path,
    with_actual_kind,
)
from veilscan.sources.hashes import large_hashes
from veilscan.sources.json import LINE_EXTENSIONS, json_chunks
from veilscan.sources.json_lines import json_line_chunks
from veilscan.sources.parquet import mixed_parquet_chunks, parquet_footers
from veilscan.sources.tables import csv_chunks
from veilscan.sources.windows import text_windows

# Copies whose paths are broadcast, about 100 bytes each.
BROADCAST_COPIES = 100_000
# Kinds that this package reads itself; others need a decoder of the caller.
READ_KINDS = ("text", "csv", "html", "json", "parquet")
NO_READER, TOO_LARGE, COMPRESSED, NOT_LISTED = "no_reader_for_format", "too_large_to_read_whole", "compressed_file", "hidden_file"
_COMPRESSED = (".gz", ".bz2", ".xz", ".z", ".br", ".zst")


@dataclass(frozen=True)
class ScanOptions:
    """Settings of a scan."""

    min_confidence: float = 0.6
    context_window: int = 60
    masking: str = "partial"
    store_value_hash: bool = True
    drop_duplicates: bool = True
    whole_file_bytes: int = WHOLE_FILE_BYTES
    decoders: dict[str, Decoder] = field(default_factory=dict)
    #: Path, size and mtime of all files, from a caller whose store can list what Spark's readers leave out.
    listing: DataFrame | None = None
    thresholds: dict[str, float] = field(default_factory=dict)


def _unread(options: ScanOptions) -> Column:
    """Why a file is not read, null if it is: no file that was not read may look clean."""
    whole = F.col("kind").isin("html", *options.decoders) | (
        (F.col("kind") == "json") & ~F.col("ext").isin(list(LINE_EXTENSIONS))
    )
    return F.coalesce(
        F.col("error"),
        F.when(F.col("ext").isin(list(_COMPRESSED)), F.lit(COMPRESSED)),
        F.when(~F.col("kind").isin(*READ_KINDS, *options.decoders), F.lit(NO_READER)),
        F.when((F.col("size") > options.whole_file_bytes) & whole, F.lit(TOO_LARGE)),
    )


def manifest(spark: SparkSession, root: str, out: str, options: ScanOptions) -> DataFrame:
    """All files with their facts, actual kind, content hash and the reason why one is not read, written to ``out``.

    The content of every file up to ``whole_file_bytes`` is read once, for its hash and its kind. Of the larger ones those that
    share their size with another are read in splits for a hash; the others can have no copies.
    """
    limit = options.whole_file_bytes
    small = with_actual_kind(describe(binary_files(spark, root).filter(F.col("size") <= limit), root))
    hashed = small.withColumn("content_hash", content_hash(F.col("content"))).drop("content")
    large = describe(binary_files(spark, root).drop("content").filter(F.col("size") > limit), root)
    hashes = large_hashes(spark, root, large, limit) if options.drop_duplicates else None
    large = large.join(hashes, "path", "left") if hashes is not None else large.withColumn("content_hash", F.lit(None).cast("string"))
    files = hashed.unionByName(large)
    if options.listing is not None:
        # names that begin with a dot or an underscore, and empty files: they are in the reports, though not searched
        listed = describe(options.listing.select("path", "size", "mtime"), root)
        unseen = listed.join(files.select("path"), "path", "left_anti").withColumn("content_hash", F.lit(None).cast("string"))
        hidden = F.when(F.col("size") > 0, F.lit(NOT_LISTED))
        files = files.unionByName(unseen.withColumn("error", F.coalesce("error", hidden)))
    files.withColumn("error", _unread(options)).write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def tree_chunks(spark: SparkSession, root: str, options: ScanOptions, out: str | None = None, left_out: DataFrame | None = None) -> DataFrame:
    """Chunks of all supported files below a folder. Each format goes through its own reader; small tables go to ``out``.

    Large texts whose ``path`` is in the small table ``left_out`` are not cut into windows; chunks of other kinds are left to the caller.
    """
    limit, out = options.whole_file_bytes, out or shared_dir(spark)

    def files_of(*kinds: str) -> DataFrame:
        # only the extensions of a reader are listed for it, so the content of other files is not read
        found = binary_files(spark, root, extensions_of(*kinds)).filter(F.col("size") <= limit)
        return with_actual_kind(describe(found, root))

    text_glob = file_name_glob(extensions_of("text"))
    csv_glob = file_name_glob(extensions_of("csv"))
    parts = [
        text_chunks(files_of("text"), limit),
        text_windows(spark, root, text_glob, limit, left_out=left_out),
        # documents of other kinds may be web pages in truth
        html_chunks(files_of("html", *SNIFFED_KINDS)),
        csv_chunks(files_of("csv"), limit),
        large_csv_chunks(spark, root, csv_glob, limit),
        json_chunks(files_of("json"), limit),
        json_line_chunks(spark, root, file_name_glob(LINE_EXTENSIONS)),
    ]
    # read once: the plan holds one scan for each schema
    footers = parquet_footers(spark, root, limit)
    footers.write.mode("overwrite").parquet(f"{out}/footers")
    parquet = mixed_parquet_chunks(spark, spark.read.parquet(f"{out}/footers"))
    chunks = parts[0]
    for part in parts[1:]:
        chunks = chunks.unionByName(part, allowMissingColumns=True)
    chunks = chunks.withColumn("error", F.lit(None).cast("string")).unionByName(parquet, allowMissingColumns=True)
    if options.decoders:
        chunks = chunks.unionByName(decoded_chunks(files_of(*options.decoders), options.decoders), allowMissingColumns=True)
    return chunks


def scan_tree(spark: SparkSession, root: str, out: str | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """Scan a folder; returns findings and reports.

    The list of files, with hashes, and then the combined spans are written once to ``out`` (default: a folder
    below the shared checkpoint folder). Findings, reports and every table over them read those copies, so detection runs only once and a lost
    executor costs no more than its own tasks.
    """
    options = ScanOptions(**settings)
    out = out or shared_dir(spark)
    listed = manifest(spark, root, out, options)
    files = keep_first(listed) if options.drop_duplicates else listed
    copies = duplicate_map(listed).select("path") if options.drop_duplicates else None
    few = copies is not None and copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    chunks = tree_chunks(spark, root, options, out, copies if few else None).filter(not_ignored(relative_path(F.col("path"), root)))
    if few:
        chunks = chunks.join(F.broadcast(copies), "path", "left_anti")
    spans = scan_chunks(
        chunks,
        min_confidence=options.min_confidence,
        context_window=options.context_window,
        masking=options.masking,
        store_value_hash=options.store_value_hash,
    )
    if copies is not None and not few:
        # texts never meet by path: beyond that many copies they are searched, and their few spans are left out
        spans = spans.join(copies, "path", "left_anti")
    spans.write.mode("overwrite").parquet(f"{out}/scanned")
    files.select("path", "size", "mtime", "ext", "mime", "kind", "error").write.mode("overwrite").parquet(f"{out}/files")
    scanned = spark.read.parquet(f"{out}/scanned")
    listed = spark.read.parquet(f"{out}/files")
    return findings(scanned), file_reports(scanned, listed, **options.thresholds)
