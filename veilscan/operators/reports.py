"""Per-file reports and the summary tables over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.files import NO_EXTENSION, base_name
from veilscan.operators.classify import is_confident, protection_level, recommendation, total
from veilscan.schema import NO_LEVEL, REPORTS, level_rank

# Header of the detailed report.
REPORT_CSV_COLUMNS = ("путь", "категории_ПДн", "количество_находок", "УЗ", "формат_файла", "рекомендации")


def file_reports(scanned: DataFrame, files: DataFrame | None = None, **thresholds: float) -> DataFrame:
    """One row per file with its counts and level.

    ``files`` (path, size, mtime, ext, mime, kind and, where known, error) keeps files that gave no chunk.
    A file has at most one row per category here, so the map is small whatever the file holds.
    """
    per_category = scanned.groupBy("path", "category").agg(
        F.sum("occurrences").alias("n"),
        F.sum("text_length").alias("text_length"),
        F.sum("rows_processed").alias("rows_processed"),
        F.max("error").alias("error"),
    )
    per_file = per_category.groupBy("path").agg(
        F.map_from_entries(
            F.sort_array(
                F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", F.col("n"))))
            )
        ).alias("category_counts"),
        F.sum("text_length").alias("text_length"),
        F.sum("rows_processed").alias("rows_processed"),
        F.max("error").alias("error"),
    )
    if files is None:
        joined = per_file.select(
            "*",
            *[
                F.lit(None).cast(REPORTS[c].dataType).alias(c)
                for c in ("size", "mtime", "extension", "mime", "kind")
            ],
        )
    else:
        listed_error = F.col("listed_error") if "error" in files.columns else F.lit(None).cast("string")
        renamed = files.withColumnRenamed("error", "listed_error").withColumnRenamed("ext", "extension")
        joined = renamed.join(per_file, "path", "left").withColumn("error", F.coalesce("error", listed_error))
    empty = F.create_map().cast("map<string,bigint>")
    counted = joined.withColumn("category_counts", F.coalesce("category_counts", empty)).select(
        "*", F.coalesce("rows_processed", F.lit(0).cast("bigint")).alias("_rows")
    )
    return counted.select(
        "path",
        "size",
        "mtime",
        "extension",
        "mime",
        F.when(F.coalesce(F.col("error") != "unsupported_format", F.lit(True)), F.col("kind")).alias("kind"),
        "category_counts",
        protection_level(F.col("category_counts"), F.col("_rows"), **thresholds).alias("protection_level"),
        "error",
        F.coalesce("text_length", F.lit(0).cast("bigint")).alias("text_length"),
        F.col("_rows").alias("rows_processed"),
    )


def format_name(extension: Column) -> Column:
    """Extension without its dot, or the label for none."""
    bare = F.regexp_replace(F.coalesce(extension, F.lit("")), r"^\.+", "")
    return F.when(bare == "", F.lit(NO_EXTENSION)).otherwise(bare)


def totals(reports: DataFrame) -> DataFrame:
    """One row: files, files with any finding, files with an error."""
    return reports.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.size("category_counts") > 0).alias("files_with_pii"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
    )


def by_format(reports: DataFrame) -> DataFrame:
    return reports.groupBy(format_name(F.col("extension")).alias("format")).agg(F.count(F.lit(1)).alias("files"))


def by_level(reports: DataFrame) -> DataFrame:
    """Files per level, strictest first, only levels that occur."""
    level = F.coalesce(F.col("protection_level"), F.lit(NO_LEVEL))
    return (
        reports.groupBy(level.alias("protection_level"))
        .agg(F.count(F.lit(1)).alias("files"))
        .orderBy(level_rank(F.col("protection_level")))
    )


def by_category(reports: DataFrame) -> DataFrame:
    """Findings per category, most first."""
    return (
        reports.select(F.explode("category_counts").alias("category", "n"))
        .groupBy("category")
        .agg(F.sum("n").alias("findings"))
        .orderBy(F.desc("findings"), "category")
    )


def top_categories(reports: DataFrame, n: int = 10) -> DataFrame:
    return by_category(reports).limit(n)


def top_files(reports: DataFrame, n: int = 20) -> DataFrame:
    """Files with most findings; of equal ones the lower path comes first."""
    counted = reports.select(
        "path",
        "protection_level",
        total(F.col("category_counts")).alias("findings"),
        F.array_join(F.array_sort(F.map_keys("category_counts")), ", ").alias("categories"),
    )
    return counted.orderBy(F.desc("findings"), "path").limit(n).filter(F.col("findings") > 0)


def category_line(counts: Column) -> Column:
    """``name (count)`` parts, highest count first, equal counts by name."""
    ordered = F.array_sort(
        F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("name")))
    )
    return F.array_join(
        F.transform(ordered, lambda e: F.concat(e["name"], F.lit(" ("), (-e["n"]).cast("string"), F.lit(")"))), ", "
    )


def report_rows(reports: DataFrame) -> DataFrame:
    """Rows of the detailed report."""
    counts = F.col("category_counts")
    bare = F.regexp_replace(F.coalesce(F.col("extension"), F.lit("")), r"^\.+", "")
    columns = (
        F.col("path"),
        F.array_join(F.array_sort(F.map_keys(counts)), "|"),
        total(counts),
        F.col("protection_level"),
        bare,
        recommendation(F.col("protection_level")),
    )
    return reports.select(*[c.alias(name) for c, name in zip(columns, REPORT_CSV_COLUMNS)])


def result_rows(reports: DataFrame) -> DataFrame:
    """Size, time and base name of the files that hold personal data for sure."""
    return reports.filter(is_confident(F.col("category_counts"))).select(
        F.coalesce("size", F.lit(0).cast("bigint")).alias("size"),
        short_time(F.col("mtime")).alias("time"),
        base_name(F.col("path")).alias("name"),
    )


def short_time(mtime: Column) -> Column:
    """A time as ``sep 26 18:31``; empty when unknown."""
    return F.coalesce(F.lower(F.date_format(mtime, "MMM d HH:mm")), F.lit(""))
