"""Text clean-up and chunk locators."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.regex import strip


# Texts that are held as Python strings at a time; a batch has thousands.
_SLICE = 64


def _normalized(form: str, texts: pa.Array) -> pa.Array:
    """A batch in a normal form, made in slices so that only Arrow's own bytes of it are held whole."""
    parts = [
        pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.slice(i, _SLICE).to_pylist()], pa.string())
        for i in range(0, len(texts), _SLICE)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _normalized("NFKC", texts)


@F.arrow_udf(T.StringType())
def _nfkd(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _normalized("NFKD", texts)


def _changed_by(text: Column, normal_form: Column) -> Column:
    """ASCII text is its own normal form, so only the rest goes through Python."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), normal_form).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Compatibility form, with every kind of line end as ``\\n``."""
    return F.regexp_replace(_changed_by(text, _nfkc(text)), r"\r\n?|\x{2028}|\x{2029}", "\n")


def strip_diacritics(text: Column) -> Column:
    """Decomposed form without combining marks."""
    return F.regexp_replace(_changed_by(text, _nfkd(text)), r"\p{Mn}+", "")


def collapse_whitespace(text: Column) -> Column:
    """Runs of blanks (also no-break, zero-width and thin ones) as one, none at the ends."""
    return strip(F.regexp_replace(text, r"[ \t\x{a0}\x{200b}\x{2009}]+", " "))


def lower_yo_to_ye(text: Column) -> Column:
    return F.translate(text, "ёЁ", "еЕ")


def rows_from_locator(locator: Column) -> Column:
    """The row count a locator carries, else 0."""
    return F.coalesce(F.regexp_extract(locator, r"rows=(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
