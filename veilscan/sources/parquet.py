"""Parquet files of a tree, each with its own schema.

Footers are read in tasks. Files of equal schema are read by one scan, so types that conflict between files, or columns that some lack, do
no harm; a file whose footer cannot be read, or whose schema Spark cannot read, becomes a row with an error.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.sources.files import WHOLE_FILE_BYTES, binary_files
from veilscan.sources.tables import parquet_chunks

_FOOTER = "path string, fingerprint string, columns array<string>, error string"


def _told(path: str, source) -> tuple:
    try:
        with pq.ParquetFile(source) as file:
            names, text = file.schema_arrow.names, str(file.schema)
    except Exception as exc:  # noqa: BLE001 - a broken file must not end the job
        return path, None, None, f"unhandled: {type(exc).__name__}: {exc}"[:500]
    # the text of a schema begins with the address of the object
    return path, hashlib.sha256("\n".join([*names, *text.split("\n")[1:]]).encode()).hexdigest(), names, None


def _opened(path: str):
    """A file by ranges, where this store is one that Arrow knows."""
    if "://" not in path.replace("file://", "") and path.startswith(("file:", "/")):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, place = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(place)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["path", "fingerprint", "columns", "error"])


def _from_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield _batch([_told(batch.column(0)[k].as_py(), pa.BufferReader(batch.column(1)[k].as_buffer()))])


def _from_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                source = _opened(path)
            except Exception as exc:  # noqa: BLE001
                yield _batch([(path, None, None, f"unhandled: {type(exc).__name__}: {exc}"[:500])])
                continue
            with source:
                yield _batch([_told(path, source)])


def parquet_footers(spark: SparkSession, root: str, max_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """``path``, ``fingerprint`` of the schema, ``columns`` and ``error`` of every Parquet file below a folder.

    Files up to ``max_bytes`` come through Spark's reader, whatever the store; of larger ones only the footer is read, by
    ranges, which Arrow must know the store for.
    """
    files = binary_files(spark, root, (".parquet",))
    small = files.where(F.col("size") <= max_bytes).select("path", "content").mapInArrow(_from_content, _FOOTER)
    large = files.where(F.col("size") > max_bytes).select("path").mapInArrow(_from_ranges, _FOOTER)
    return small.unionByName(large)


def _plain_glob(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def mixed_parquet_chunks(spark: SparkSession, footers: DataFrame, full: bool = True) -> DataFrame:
    """Rows of all files as chunks, one scan for each schema, and an error row for each file that cannot be read.

    ``footers`` is what ``parquet_footers`` gives. The paths of the files go to the driver, which lists them for the scans anyway.
    """
    groups: dict[str, list[str]] = defaultdict(list)
    for row in footers.where("error is null").select("path", "fingerprint").toLocalIterator():
        groups[row.fingerprint].append(row.path)
    parts = [footers.where("error is not null").select("path", "error")]
    chunks = []
    for _, paths in sorted(groups.items()):
        try:
            read = parquet_chunks(spark, [_plain_glob(p) for p in sorted(paths)], full=full)
            chunks.append(read.withColumn("error", F.lit(None).cast("string")))
        except PySparkException as exc:
            reason = f"unhandled: {exc.getCondition() or type(exc).__name__}"
            parts.append(spark.createDataFrame([(p, reason) for p in paths], "path string, error string"))
    failed = reduce(DataFrame.unionByName, parts).select(
        "path", F.lit(0).cast("bigint").alias("chunk_no"), F.lit(None).cast("string").alias("text"), F.lit("").alias("locator"), "error"
    )
    return reduce(DataFrame.unionByName, [failed, *chunks])


def parquet_schemas(footers: DataFrame, n: int) -> DataFrame:
    """Columns of the first Parquet files by path, one row a column."""
    picked = footers.where("error is null").orderBy("path").limit(n)
    return picked.select("path", F.posexplode("columns").alias("column_no", "column"))
