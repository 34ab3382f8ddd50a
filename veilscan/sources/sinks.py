"""Report sinks. Rows are written by the tasks; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.operators import reports as rpt
from veilscan.schema import NO_LEVEL, REPORTS


def write_report_csv(reports: DataFrame, path: str) -> None:
    rpt.report_rows(reports).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_result_csv(reports: DataFrame, path: str) -> None:
    rpt.result_rows(reports).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_report_json(reports: DataFrame, findings: DataFrame, path: str) -> None:
    """Reports, findings and summary as JSON lines in three folders.

    Findings stay a table of their own: a single file may have more of them than one row can hold.
    """
    reports.write.mode("overwrite").json(f"{path}/files")
    findings.write.mode("overwrite").json(f"{path}/findings")
    # from the saved reports, so that nothing behind them is made twice
    summary(read_reports(reports.sparkSession, path)).write.mode("overwrite").json(f"{path}/summary")


def summary(reports: DataFrame) -> DataFrame:
    """Long form of the summary: metric, key and value. All tables come from one scan and one exchange of partial sums."""

    def entry(metric: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.cast("bigint").alias("value"))

    none, one = F.lit(""), F.lit(1)
    entries = F.array(
        entry("total_files", none, one),
        entry("files_with_pii", none, (F.size("category_counts") > 0).cast("int")),
        entry("errors", none, (F.coalesce(F.col("error"), none) != "").cast("int")),
        entry("protection_level_counts", F.coalesce("protection_level", F.lit(NO_LEVEL)), one),
        entry("format_counts", rpt.format_name(F.col("extension")), one),
    )
    found = F.transform(F.map_entries("category_counts"), lambda e: entry("category_counts", e["key"], e["value"]))
    # a table without files still has its totals
    zero = reports.sparkSession.createDataFrame([(m, "", 0) for m in ("total_files", "files_with_pii", "errors")], "metric string, key string, value bigint")
    rows = reports.select(F.explode(F.concat(entries, found)).alias("e")).select("e.*").unionByName(zero)
    return rows.groupBy("metric", "key").agg(F.sum("value").alias("value"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved reports, ready for the same sinks, without a new scan."""
    return spark.read.schema(REPORTS).json(f"{path}/files")
