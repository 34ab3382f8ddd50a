"""Delimited files, Parquet files and tables as chunks of rendered rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions import patterns
from veilscan.functions.files import suffix
from veilscan.functions.regex import first_rule
from veilscan.functions.spans import let
from veilscan.sources.files import WHOLE_FILE_BYTES, file_path

# Rows per chunk, size of the separator sample, rows of a Parquet sample.
ROWS_PER_CHUNK = 25_000
SAMPLE_BYTES = 8192
PARQUET_SAMPLE_ROWS = 1000
SEPARATORS = (";", "\t", ",")


def column_category(name: Column) -> Column:
    """Category a column name stands for, null when no rule hits."""
    return first_rule(name, patterns.COLUMN_CATEGORY)


def name_category(name: str) -> str | None:
    """The same for a name known when the plan is built."""
    hits = (label for label, pattern in patterns.COLUMN_CATEGORY.items() if re.search(pattern, name, re.IGNORECASE))
    return next(hits, None)


def rendered_cell(name: Column, category: Column, value: Column) -> Column:
    """``name=value``, or a marker where the name tells the category; null for an empty cell."""
    marker = F.concat(F.lit("[[PII_DIRECT:"), category, F.lit(":"), value, F.lit("]]"))
    plain = F.concat(name, F.lit("="), value)
    return F.when(value != "", F.when(category.isNotNull(), marker).otherwise(plain))


def shown(df: DataFrame, name: str) -> Column:
    """A cell as text; truth values are written the way Python does."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(column, F.lit("True")).when(~column, F.lit("False"))
    return column.cast("string")


def rendered_row(df: DataFrame, columns: Sequence[str], markers: bool = True) -> Column:
    """A table row as text. The rules run over the column names once, when the plan is built."""
    category = {c: name_category(c) for c in columns} if markers else {}
    cells = [rendered_cell(F.lit(c), F.lit(category.get(c)).cast("string"), shown(df, c)) for c in columns]
    return F.concat_ws("; ", *cells)


def table_chunks(df: DataFrame, path: Column, row_no: Column, columns: Sequence[str], markers: bool = True) -> DataFrame:
    """Rows of a table as chunks, one per row, in a narrow stage.

    A chunk per row keeps a table of any size splittable. Context then ends at the row.
    """
    rows = df.select(
        path.alias("path"),
        (row_no + 1).cast("bigint").alias("chunk_no"),
        rendered_row(df, columns, markers).alias("text"),
        F.concat(F.lit("row="), row_no.cast("string"), F.lit(":rows=1")).alias("locator"),
    )
    return rows.filter(F.col("text") != "")


def header_chunks(paths: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The line of column names, which is searched like any other text: one chunk per file."""
    return paths.select(
        "path",
        F.lit(0).cast("bigint").alias("chunk_no"),
        F.lit(" ".join(columns)).alias("text"),
        F.lit("header").alias("locator"),
    )


def parquet_chunks(spark: SparkSession, source: str | list[str], full: bool = True, **options: str) -> DataFrame:
    """Parquet rows as chunks without markers; ``full=False`` takes the first 1000 rows of each file."""
    df = spark.read.options(**options).parquet(*([source] if isinstance(source, str) else source))
    columns = df.columns
    rows = df.select("*", file_path().alias("_path"), F.col("_metadata.row_index").alias("_row"))
    if not full:
        rows = rows.filter(F.col("_row") < PARQUET_SAMPLE_ROWS)
    body = table_chunks(rows, F.col("_path"), F.col("_row"), columns, markers=False)
    heads = header_chunks(rows.filter(F.col("_row") == 0).select(F.col("_path").alias("path")), columns)
    return heads.unionByName(body)


def _record_pattern(sep: str) -> str:
    field = _field_pattern(sep)
    return rf"{field}(?:{sep}{field})*+(?:\n|\z)"


def _field_pattern(sep: str) -> str:
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    return rf"(?:{quoted}[^{sep}\n]*+|[^{sep}\n]*+)"


def separator(sample: Column, ext: Column) -> Column:
    """Tab for tab files, else whichever of semicolon and comma is more frequent."""
    n = {s: F.length(sample) - F.length(F.replace(sample, F.lit(s), F.lit(""))) for s in (";", ",")}
    return F.when(ext == ".tsv", F.lit("\t")).when(n[";"] > n[","], F.lit(";")).otherwise(F.lit(","))


def _by_separator(sep: Column, make) -> Column:
    out = make(SEPARATORS[-1])
    for s in SEPARATORS[:-1]:
        out = F.when(sep == s, make(s)).otherwise(out)
    return out


def records(text: Column, sep: Column) -> Column:
    """Records of a delimited text; quoted fields may hold line ends. Blank lines are left out."""
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    found = _by_separator(sep, lambda s: F.regexp_extract_all(plain, F.lit(_record_pattern(s)), F.lit(0)))
    return F.filter(F.transform(found, lambda r: F.regexp_replace(r, r"\n\z", "")), lambda r: r != "")


def fields(record: Column, sep: Column) -> Column:
    """Fields of a record, without their quotes."""
    raw = _by_separator(
        sep,
        lambda s: F.regexp_extract_all(F.concat(F.lit(s), record), F.lit(f"{s}({_field_pattern(s)})"), F.lit(1)),
    )

    def unquoted(field: Column) -> Column:
        def bare(quoted: Column) -> Column:
            inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
            rest = F.substring(field, F.length(quoted) + 1, F.length(field))
            return F.when(quoted == "", field).otherwise(F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest))

        # most fields have no quote, which a look at their first character tells
        quoted = F.regexp_extract(field, r'\A"[^"]*+(?:""[^"]*+)*+"', 0)
        return F.when(field.startswith('"'), let(quoted, bare)).otherwise(field)

    return F.transform(raw, unquoted)


def rendered_record(names: Column, categories: Column, cells: Column) -> Column:
    """One delimited row as text; null when it has more cells than the header."""

    def rendered(cells: Column) -> Column:
        named = F.zip_with(
            F.arrays_zip(names.alias("name"), categories.alias("category")),
            cells,
            lambda h, c: rendered_cell(h["name"], h["category"], F.coalesce(c, F.lit(""))),
        )
        return F.when(F.size(cells) <= F.size(names), F.array_join(F.array_compact(named), "; "))

    # the fields are searched once, however often they are used
    return let(cells, rendered)


def csv_chunks(files: DataFrame, max_bytes: int = WHOLE_FILE_BYTES, max_chunks: int | None = None) -> DataFrame:
    """Delimited files read whole: chunks of 25 000 rows below their header line.

    Every file brings its own header and separator. Rows with too many cells are skipped, empty cells are
    left out. It all happens within the row of the file, without a shuffle.
    """
    wanted = files.filter((F.col("kind") == "csv") & (F.col("size") <= max_bytes))
    # spreadsheets begin their exports with a byte order mark
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\A\x{FEFF}", "")
    sample = F.make_valid_utf8(F.substring("content", 1, SAMPLE_BYTES).cast("string"))
    parsed = (
        wanted.select("path", text.alias("text"), separator(sample, suffix(F.col("path"))).alias("sep"))
        .select("path", "sep", records(F.col("text"), F.col("sep")).alias("records"))
        .filter(F.size("records") > 0)
        .select("path", "sep", "records", fields(F.get("records", F.lit(0)), F.col("sep")).alias("names"))
        .select("path", "sep", "records", "names", F.transform("names", column_category).alias("categories"))
    )
    body = F.slice("records", F.lit(2), F.size("records") - 1)
    rows = F.array_compact(
        F.transform(body, lambda r: rendered_record(F.col("names"), F.col("categories"), fields(r, F.col("sep"))))
    )
    # a file of a header alone is searched as well: its only line may be data
    rendered = parsed.select("path", F.array_join("names", " ").alias("header"), rows.alias("rows"))
    return _row_batches(rendered, max_chunks)


def _row_batches(rendered: DataFrame, max_chunks: int | None) -> DataFrame:
    last = F.greatest(F.floor((F.size("rows") - 1) / ROWS_PER_CHUNK).cast("int"), F.lit(0))
    if max_chunks is not None:
        last = F.least(last, F.lit(max_chunks - 1))
    # cut first, so that each chunk carries its own rows alone
    batches = F.transform(
        F.sequence(F.lit(0), last), lambda n: F.slice("rows", n * ROWS_PER_CHUNK + 1, F.lit(ROWS_PER_CHUNK))
    )
    return rendered.select("path", "header", F.posexplode(batches).alias("chunk_no", "batch")).select(
        "path",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.concat_ws("\n", F.col("header"), F.when(F.size("batch") > 0, F.array_join("batch", "\n"))).alias("text"),
        F.concat(
            F.lit("chunk="), F.col("chunk_no").cast("string"), F.lit(":rows="), F.size("batch").cast("string")
        ).alias("locator"),
    )


# How many files of a format the profile looks into.
CSV_FILES, JSON_FILES, PARQUET_FILES = 25, 15, 10
JSON_KEYS = 30


def _largest(files: DataFrame, extensions: tuple[str, ...], n: int) -> DataFrame:
    """The largest files of a format, with their whole content as text; no other content is read.

    The paths and sizes of ``n`` files come to the driver; readers of whole files leave out other sizes before they open them.
    """
    wanted = suffix(F.col("path")).isin(list(extensions))
    picked = files.select("path", "size").filter(wanted).orderBy(F.desc("size"), "path").limit(n).collect()
    same_size = F.lit(False)
    for size in sorted({r.size for r in picked}):
        same_size = same_size | (F.col("size") == size)
    found = files.filter(same_size & F.col("path").isin([r.path for r in picked]))
    return found.select("path", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("body"))


def csv_schemas(files: DataFrame, n: int = CSV_FILES) -> DataFrame:
    """Header columns of the largest delimited files, one row per column; the separator is that of the header."""
    first = F.regexp_extract("body", r"\A([^\r\n]*)", 1)
    count = {s: F.length(first) - F.length(F.replace(first, F.lit(s), F.lit(""))) for s in SEPARATORS}
    sep = F.when((count[";"] > count[","]) & (count[";"] >= count["\t"]), F.lit(";")).when(
        count["\t"] > count[","], F.lit("\t")
    )
    heads = _largest(files, (".csv", ".tsv"), n).select(
        "path", "size", first.alias("first"), F.coalesce(sep, F.lit(",")).alias("delimiter")
    )
    return heads.select(
        "path", "size", "delimiter", F.posexplode(fields(F.col("first"), F.col("delimiter"))).alias("column_no", "column")
    )


def json_schemas(files: DataFrame, n: int = JSON_FILES) -> DataFrame:
    """Top keys of the largest JSON files: of the object, the first object of a list, or the first line."""
    lined = suffix(F.col("path")) != ".json"
    text = F.when(lined, F.substring_index("body", "\n", 1)).otherwise(F.col("body"))
    heads = _largest(files, (".json", ".jsonl", ".ndjson"), n).select("path", "size", lined.alias("lined"), text.alias("text"))
    whole = F.json_object_keys("text")
    first = F.when(~F.col("lined"), F.json_object_keys(F.get_json_object("text", "$[0]")))
    keys = F.when(F.try_parse_json("text").isNotNull(), F.coalesce(whole, first))
    return heads.select(
        "path", "size", F.posexplode_outer(F.slice(keys, 1, JSON_KEYS)).alias("key_no", "key")
    )
