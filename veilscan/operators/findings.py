"""Spans to findings and per-file counts, with one shuffle over the spans."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.functions.masking import mask_value, sha256_hex
from veilscan.functions.regex import strip
from veilscan.functions.text import rows_from_locator
from veilscan.operators.detect import (
    CONTEXT_WINDOW,
    FILE_MARKED,
    FILE_RESIDUES,
    MIN_CONFIDENCE,
    OWN_FROM,
    OWN_TO,
    explode_spans,
    with_spans,
)

def first_seen(chunk_no: Column, span_no: Column) -> Column:
    """Order of appearance as one number.

    A decimal leaves room for both ranks and, unlike a struct, keeps the aggregation in a hash table.
    """
    chunks = chunk_no.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)")
    return (chunks + span_no.cast("decimal(11,0)")).cast("decimal(38,0)")


def first_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """The first chunks of each file, for a quick look; the rank limit works before the shuffle as well."""
    rank = F.row_number().over(W.partitionBy("path").orderBy("chunk_no"))
    return chunks.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def scan_chunks(
    chunks: DataFrame,
    *,
    min_confidence: float = MIN_CONFIDENCE,
    context_window: int = CONTEXT_WINDOW,
    masking: str = "partial",
    store_value_hash: bool = True,
    extra_spans: DataFrame | None = None,
) -> DataFrame:
    """One row per file, category and distinct value, plus rows without a category.

    ``chunks`` holds path, chunk_no, text, locator and, if a source reports them, error; a row with an error
    has no text of its own. Windows of larger texts count for the part they own. The sizes of
    all chunks ride along, so a single pass and a single shuffle serve findings and reports. Equal
    values are combined before the shuffle, so a file with very many findings does not make one task hot.
    ``extra_spans`` adds spans of the same chunks that another detector found (see ``entities``).
    """
    error = F.col("error") if "error" in chunks.columns else F.lit(None).cast("string")
    own = [c for c in (OWN_FROM, OWN_TO, FILE_MARKED, FILE_RESIDUES) if c in chunks.columns]
    length = F.length("text")
    if own:
        length = F.coalesce(F.col(OWN_TO) - F.col(OWN_FROM), length)
    measured = chunks.select(
        "path",
        "chunk_no",
        "text",
        error.alias("error"),
        F.coalesce(length, F.lit(0)).cast("bigint").alias("text_length"),
        rows_from_locator(F.col("locator")).alias("rows_processed"),
        *own,
    )
    found = with_spans(measured, context_window=context_window)
    kept = ["path", "chunk_no", "error", "text_length", "rows_processed"]
    rows = explode_spans(found, kept)
    if extra_spans is not None:
        rows = rows.unionByName(
            extra_spans.select(
                "path", "chunk_no", "span_no", "category", "value", "start", "end", "confidence"
            ),
            allowMissingColumns=True,
        )
    return combine_spans(rows, min_confidence, masking, store_value_hash)


@lru_cache(maxsize=8)
def _masked(mode: str) -> Column:
    """The mask of the value column, built once per mode."""
    return mask_value(F.col("value"), F.col("category"), mode)


def combine_spans(
    rows: DataFrame, min_confidence: float = MIN_CONFIDENCE, masking: str = "partial", store_value_hash: bool = True
) -> DataFrame:
    """Combine exploded spans by file, category and value."""
    value = strip(F.col("value"))
    # the sizes of a chunk are counted on its first row, whatever span that row carries
    opening = F.coalesce(F.col("span_no"), F.lit(0)) == 0
    passed = (F.col("confidence") >= min_confidence) & (value != "")
    marked = rows.select(
        "path",
        F.when(passed, F.col("category")).alias("category"),
        F.when(passed, value).alias("value"),
        "confidence",
        first_seen(F.col("chunk_no"), F.coalesce(F.col("span_no"), F.lit(0))).alias("seen"),
        F.when(~F.coalesce(passed, F.lit(False)), F.col("error")).alias("error"),
        F.when(opening, F.col("text_length")).alias("text_length"),
        F.when(opening, F.col("rows_processed")).alias("rows_processed"),
    )
    # The value itself is the key: it is shorter than its hash, and hash and mask are then made once per value.
    # Errors are a key too, as a maximum of strings would turn the hash aggregation into a sort.
    combined = marked.groupBy("path", "category", "value", "error").agg(
        F.min_by("confidence", "seen").alias("confidence"),
        F.min("seen").alias("seen"),
        F.count("category").alias("occurrences"),
        F.sum("text_length").alias("text_length"),
        F.sum("rows_processed").alias("rows_processed"),
    )
    combined = combined.select(
        "path",
        "category",
        sha256_hex(F.col("value")).alias("value_hash"),
        _masked(masking).alias("value_masked"),
        *combined.columns[4:],
        "error",
    )
    if store_value_hash:
        return combined
    return combined.withColumn("value_hash", F.when(F.col("category").isNotNull(), F.lit("")))


def findings(scanned: DataFrame) -> DataFrame:
    """Distinct findings per file; the confidence is that of the first occurrence."""
    return scanned.filter(F.col("category").isNotNull()).select(
        "path",
        "category",
        "value_masked",
        "value_hash",
        F.round("confidence", 3).alias("confidence"),
        "occurrences",
    )


def category_counts(scanned: DataFrame) -> DataFrame:
    """Occurrences, repeats included, per file and category."""
    return (
        scanned.filter(F.col("category").isNotNull())
        .groupBy("path", "category")
        .agg(F.sum("occurrences").alias("occurrences"))
    )
