"""Spans of a language model: which texts to send, how to cut them, which spans to keep.

The model itself is not part of the engine; any job that writes a table of spans will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.regex import java
from veilscan.operators.detect import MARKER

# Limits of the gate, the slice length and the confidence of a kept span.
MIN_LENGTH = 50
MIN_CYRILLIC_SHARE = 0.05
SLICE_LENGTH = 20_000
CONFIDENCE = 0.85
CATEGORY_OF_TYPE = {"PER": "fio", "LOC": "address"}
# model spans come after all spans of the detectors
_AFTER_DETECTORS = 1 << 25


def wants_entities(text: Column) -> Column:
    """Texts long enough and, taken whole, Cyrillic enough for the model; marked table rows never are."""
    cyrillic = F.regexp_count(text, F.lit(r"[\x{0400}-\x{04FF}]"))
    return (
        (F.length(text) >= MIN_LENGTH)
        & (cyrillic >= F.length(text) * F.lit(MIN_CYRILLIC_SHARE))
        & ~text.contains(MARKER)
    )


def slices(chunks: DataFrame, length: int = SLICE_LENGTH) -> DataFrame:
    """Cut texts into pieces of fixed length, each with its offset."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(length))
    return (
        chunks.filter(F.length("text") > 0)
        .withColumn("offset", F.explode(starts))
        .withColumn("text", F.substring(F.col("text"), F.col("offset") + 1, F.lit(length)))
    )


def entity_spans(spans: DataFrame) -> DataFrame:
    """Keep persons and places that look Russian; the rest is noise of the model.

    ``spans`` holds path, chunk_no, type, value, start, end. Values with Latin letters, without a Russian
    vowel or with less than three word characters are dropped.
    """
    category = F.lit(None).cast("string")
    for kind, name in CATEGORY_OF_TYPE.items():
        category = F.when(F.col("type") == kind, F.lit(name)).otherwise(category)
    value = F.col("value")
    word_chars = F.length(F.regexp_replace(value, java(r"\W"), ""))
    return (
        spans.withColumn("category", category)
        .filter(
            F.col("category").isNotNull()
            & ~value.rlike("[a-zA-Z]")
            & value.rlike("[аеёиоуыэюяАЕЁИОУЫЭЮЯ]")
            & (word_chars >= 3)
        )
        .withColumn("confidence", F.lit(CONFIDENCE))
        .drop("type")
    )


def new_entities(entities: DataFrame, found: DataFrame) -> DataFrame:
    """Model spans that no detector found at the same place with the same category.

    ``found`` is the exploded detector output before the confidence cut, as a dropped span still hides an
    equal one. The chunk and both ends are in the join key, so no file becomes a hot key. Each span is
    kept once; its rank puts it behind the detectors' spans of its chunk.
    """
    key = ["path", "chunk_no", "category", "start", "end"]
    seen = found.filter(F.col("category").isin(list(CATEGORY_OF_TYPE.values()))).select(*key)
    return (
        entities.dropDuplicates(key)
        .join(seen, key, "left_anti")
        .withColumn("span_no", F.lit(_AFTER_DETECTORS) + F.col("start"))
    )
