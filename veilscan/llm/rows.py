"""Whole rows through Arrow tasks, whatever their further columns are named."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def filtered(docs: DataFrame, text_col: str, keep: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """Rows whose text is kept; ``keep`` is called once per task and gives a function from texts to booleans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = keep()
        place = docs_columns.index(text_col)
        for batch in batches:
            yield batch.filter(kept(batch.column(place)))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)


def rewritten(docs: DataFrame, text_col: str, extra: list[str], rewrite: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``docs`` without its ``extra`` columns and with a new text, made of the columns (text, *extra) of each batch."""
    names = docs.columns
    kept = [i for i, n in enumerate(names) if n not in extra]
    fields = [docs.schema.fields[i] for i in kept]
    schema = StructType([StructField(f.name, StringType(), True) if f.name == text_col else f for f in fields])
    places = [names.index(text_col), *(names.index(n) for n in extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = pa.RecordBatch.from_arrays([batch.column(i) for i in places], ["text", *extra])
            text = rewrite(given)
            columns = [text if i == places[0] else batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays(columns, [names[i] for i in kept])

    return docs.mapInArrow(run, schema)


def count_chars(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
