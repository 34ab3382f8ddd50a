"""Content hashes of files too large to hold in one value.

Only files that share their size with another one can be copies, so only those are read. Each split gives the digest of its lines, and
the digests of a file in their order give its hash. Equal files are split alike within one scan, so equal content gives
equal hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.sources.documents import lines, packed

#: Sizes that are told to the reader one by one; beyond that all large files are read.
MOST_SIZES = 10_000


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, hashlib.sha256()
    names = ["path", "block_start", "digest"]
    for batch in batches:
        path, start = (batch.column(c).to_pylist() for c in ("path", "block_start"))
        values = batch.column("value").to_pylist()
        a = 0
        for b in range(1, len(values) + 1):
            if b == len(values) or start[b] != start[a] or path[b] != path[a]:
                if now is not None and now != (path[a], start[a]):
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], names)
                    digest = hashlib.sha256()
                now = (path[a], start[a])
                digest.update(b"\n".join(values[a:b]) + b"\n")
                a = b
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], names)


def large_hashes(spark: SparkSession, root: str, files: DataFrame, min_bytes: int) -> DataFrame:
    """``path`` and ``content_hash`` of the files above ``min_bytes`` that may be copies; ``files`` has path and size."""
    shared = files.where(F.col("size") > min_bytes).groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = [r.size for r in shared.select("size").limit(MOST_SIZES + 1).collect()]
    read = lines(spark, root, "*", min_bytes, "\n")
    if len(sizes) <= MOST_SIZES:
        # the reader leaves out files by their size before it opens them
        read = read.where(F.col("size").isin(sizes))
    parts = packed(read).select("path", "block_start", F.col("value").cast("binary").alias("value")).mapInArrow(_digests, "path string, block_start long, digest string")
    ordered = F.array_sort(F.collect_list(F.struct("block_start", "digest")))
    whole = parts.groupBy("path").agg(F.array_join(F.transform(ordered, lambda p: p["digest"]), "").alias("all"))
    # the last line end is no part of what the reader tells, so a file and the same one without it differ by size only
    return whole.select("path", F.sha2(F.col("all"), 256).alias("content_hash"))
