"""Listing of a file tree and the binary form of its files.

``path`` is the plain path of a file as Spark names it, without percent escapes. Spark leaves out names
that begin with a dot or an underscore, and lists symbolic links as what they point to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.files import (
    IGNORED_EXTENSIONS,
    IGNORED_NAMES,
    guess_kind,
    sniffed_kind,
    suffix,
    with_mime,
)
from veilscan.schema import CHUNKS

# Files up to this size are read whole; larger ones go through splittable readers, line by line.
WHOLE_FILE_BYTES = 64 * 1024 * 1024

UNSUPPORTED = "unsupported_format"
# Chunks of a decoder that a task holds at a time.
CHUNKS_HELD = 64


def file_path() -> Column:
    """Path of the file a row comes from. Most names have no escapes, and readers of lines ask for every line."""
    path = F.col("_metadata.file_path")
    return F.when(path.contains("%"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


def file_name_glob(extensions: Iterable[str]) -> str:
    """Glob for extensions in any case."""
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*{" + ",".join(any_case) + "}"


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, whatever scheme or authority Spark puts before it."""
    folder = root.rstrip("/").split("://", 1)[-1].removeprefix("file:") + "/"
    at = F.instr(path, folder)
    return F.when(at > 0, F.substring(path, at + len(folder), F.length(path))).otherwise(path)


def binary_files(spark: SparkSession, root: str, extensions: Iterable[str] | None = None) -> DataFrame:
    """Path, size, mtime and content; what is not selected later is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions is not None:
        reader = reader.option("pathGlobFilter", file_name_glob(extensions))
    return reader.load(root).select(
        file_path().alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        "content",
    )


def not_ignored(rel: Column) -> Column:
    """False for ignored names anywhere in the path and for ignored extensions."""
    names = F.array(*[F.lit(n) for n in IGNORED_NAMES])
    return ~F.arrays_overlap(F.split(rel, "/"), names) & ~suffix(rel).isin(list(IGNORED_EXTENSIONS))


def describe(files: DataFrame, root: str) -> DataFrame:
    """Add rel, ext, mime, kind and the error of unsupported files; drop ignored ones."""
    named = files.withColumn("rel", relative_path(F.col("path"), root)).filter(not_ignored(F.col("rel")))
    typed = with_mime(named.withColumn("ext", suffix(F.col("path"))))
    return typed.withColumn("kind", guess_kind(F.col("ext"), F.col("mime"))).withColumn(
        "error", F.when(F.col("kind").isNull(), F.lit(UNSUPPORTED))
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` with what their names tell; no content is read."""
    return describe(binary_files(spark, root).drop("content"), root)


def with_actual_kind(files: DataFrame) -> DataFrame:
    """Correct the kind of documents that are web pages in truth; needs ``content``."""
    return files.withColumn("kind", sniffed_kind(F.col("kind"), F.col("content")))


Decoder = Callable[[bytes], Iterable[tuple[str, str]]]


def decoded_chunks(files: DataFrame, decoders: dict[str, Decoder]) -> DataFrame:
    """Chunks of binary formats through decoders of the caller, one per kind.

    A decoder turns the bytes of a file into pairs of text and locator. When it fails, the chunks before
    the failure stay and the last row carries ``error``. ``files`` holds path, kind and content.
    """

    def chunks(path: str, kind: str, content: bytes) -> Iterator[tuple]:
        n = 0
        try:
            for text, locator in decoders[kind](content):
                yield path, n, text, locator, None
                n += 1
        except ValueError as exc:
            yield path, n, None, "", f"extract_error: {exc}"
        except Exception as exc:  # noqa: BLE001 - a broken file must not end the job
            yield path, n, None, "", f"unhandled: {type(exc).__name__}: {exc}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
                rows = chunks(path, kind, bytes(content))
                # some chunks at a time: a file may have any number of them
                while part := list(islice(rows, CHUNKS_HELD)):
                    yield pd.DataFrame(part, columns=["path", "chunk_no", "text", "locator", "error"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNKS.fields)
    wanted = files.filter(F.col("kind").isin(list(decoders))).select("path", "kind", "content")
    return wanted.mapInPandas(run, f"{fields}, error string")

