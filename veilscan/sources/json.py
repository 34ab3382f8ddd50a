"""JSON documents as chunks of ``path=value`` leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.files import suffix
from veilscan.sources.files import WHOLE_FILE_BYTES

# Fixed values.
LINE_EXTENSIONS = (".jsonl", ".ndjson")


def leaves(node: object) -> Iterator[str]:
    """Scalars of a parsed document with their paths, in document order; null and '' are left out."""
    todo = [("", node)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            inner = [(f"{path}.{k}" if path else str(k), v) for k, v in value.items()]
            todo.extend(reversed(inner))
        elif isinstance(value, list):
            inner = [(f"{path}[{i}]", v) for i, v in enumerate(value)]
            todo.extend(reversed(inner))
        elif value is not None and value != "":
            yield f"{path}={value}"


def _parsed(text: str | None) -> tuple[bool, object]:
    try:
        return True, json.loads(text or "")
    except (ValueError, RecursionError):
        return False, None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _leaves(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        valid, node = _parsed(text)
        out.append(list(leaves(node)) if valid else None)
    return pd.Series(out)


# An object of plain strings, whole numbers, truth values and nulls: what most lines of logs and tables are.
_STRING = r'"([^"\\\x00-\x1f]*+)"'
_SCALAR = r'("[^"\\\x00-\x1f]*+"|true|false|null|0|-?[1-9][0-9]{0,999}+)'
_BLANK = r"[ \t\n\r]*+"
_MEMBER = f"{_STRING}{_BLANK}:{_BLANK}{_SCALAR}"
_FLAT = rf"\A{_BLANK}\{{{_BLANK}(?:{_MEMBER}{_BLANK}(?:,{_BLANK}{_MEMBER}{_BLANK})*+)?+\}}{_BLANK}\z"
# The JVM's regular expressions recurse over repeated groups, so longer texts take the general way.
_FLAT_CHARS = 20_000


def _flat_leaves(text: Column) -> Column:
    """Leaves of a flat object, by built-in functions alone; null for everything else."""
    keys = F.regexp_extract_all(text, F.lit(_MEMBER), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(_MEMBER), F.lit(2))

    def leaf(key: Column, value: Column) -> Column:
        shown = (
            F.when(value == "true", F.lit("True"))
            .when(value == "false", F.lit("False"))
            .when(value.startswith('"'), F.substring(value, F.lit(2), F.length(value) - 2))
            .otherwise(value)
        )
        return F.when(~value.isin("null", '""'), F.concat(key, F.lit("="), shown))

    simple = (F.length(text) <= _FLAT_CHARS) & text.rlike(_FLAT)
    # of equal keys the last value counts, which the general way takes care of
    single = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(simple, F.when(single, F.array_compact(F.zip_with(keys, values, leaf))))


def flatten_json(text: Column) -> Column:
    """Leaves of a document of unknown shape; null when it does not parse.

    Flat objects never leave the JVM. Documents of any depth, in the order in which they are written, need a parser that
    keeps that order, and go through one in batches.
    """
    flat = _flat_leaves(text)
    return F.coalesce(flat, _leaves(F.when(flat.isNull(), text)))


def flatten_struct(schema: T.DataType, value: Column, path: str = "") -> list[Column]:
    """The same for a known schema without arrays, as plain column expressions.

    Each column holds one leaf, or null where the leaf is left out.
    """
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            out += flatten_struct(f.dataType, value.getField(f.name), f"{path}.{f.name}" if path else f.name)
        return out
    shown = value.cast("string")
    if isinstance(schema, T.BooleanType):
        shown = F.when(value, F.lit("True")).when(~value, F.lit("False"))
    return [F.when(shown != "", F.concat(F.lit(f"{path}="), shown))]


def json_chunks(files: DataFrame, max_bytes: int = WHOLE_FILE_BYTES, cut_bytes: int | None = None) -> DataFrame:
    """JSON documents, one chunk each: the leaves, or the raw text where it does not parse."""
    single = (F.col("kind") == "json") & ~suffix(F.col("path")).isin(list(LINE_EXTENSIONS))
    content = F.col("content") if cut_bytes is None else F.substring("content", F.lit(1), F.lit(cut_bytes))
    text = F.make_valid_utf8(content.cast("string"))
    read = (
        files.filter(single & (F.col("size") <= max_bytes))
        .select("path", text.alias("raw"))
        .filter(F.col("raw").rlike(r"(?U)[^\s\x1c-\x1f]"))
        .select("path", "raw", flatten_json(F.col("raw")).alias("leaves"))
    )
    return read.select(
        "path",
        F.lit(0).cast("bigint").alias("chunk_no"),
        F.coalesce(F.array_join("leaves", "\n"), F.col("raw")).alias("text"),
        F.when(F.col("leaves").isNull(), F.lit("raw_json")).otherwise(F.lit("json_root")).alias("locator"),
    )
