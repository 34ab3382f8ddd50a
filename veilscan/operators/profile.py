"""Profile of a file tree: sizes, formats, names and schemas.

All operators take the table of file facts (see :func:`file_facts`) and reduce it by aggregations that
combine before the shuffle. None of them sorts all files or ranks them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.functions import patterns
from veilscan.functions.files import OTHER_GROUP, extension_label, format_group
from veilscan.functions.regex import first_rule, java
from veilscan.session import shared_dir

MB = 1024**2

# Seconds of work per megabyte and group.
RATES = {
    "Документы": 0.40,
    "Таблицы": 0.30,
    "Структурированные": 0.15,
    "Веб": 0.05,
    "Изображения": 1.50,
    "Видео": 4.00,
    "Текстовые": 0.02,
    "Код": 0.02,
    "Прочее": 0.10,
}
OCR_GROUPS = ("Изображения", "Видео")

# Size classes and the largest size of each.
SIZE_BUCKETS = (
    ("0", 0),
    ("≤1 KB", 1024),
    ("≤10 KB", 10 * 1024),
    ("≤100 KB", 100 * 1024),
    ("≤1 MB", 1024**2),
    ("≤10 MB", 10 * 1024**2),
    ("≤100 MB", 100 * 1024**2),
    ("≤1 GB", 1024**3),
)
LAST_BUCKET = ">1 GB"


def file_facts(files: DataFrame, root: str = "") -> DataFrame:
    """Add rel, ext, format_group and depth to path, size and mtime."""
    rel = F.regexp_replace(F.substring(F.col("path"), len(root) + 1, 1 << 30), "^/+", "")
    return (
        files.withColumn("rel", rel)
        .withColumn("ext", extension_label(F.col("path")))
        .withColumn("format_group", format_group(F.col("ext")))
        .withColumn("depth", F.size(F.split("rel", "/")) - 1)
    )


def _mb(size: Column) -> Column:
    return F.round(size / MB, 2)


def order_statistics(counts: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """Values at exact ranks without sorting the rows.

    ``counts`` holds the keys, ``value`` and ``n`` (rows with that value), so no value is hot any more.
    Values are first counted in about 1000 classes per power of two, at most 65536 in all; only the
    classes that hold a wanted rank are then looked at value by value. ``ranks`` maps a name to a
    0-based rank, as an expression over ``total``. The result has one row per key and rank name.
    """
    power = F.floor(F.log2(F.greatest(F.col("value"), F.lit(1)).cast("double"))).cast("int")
    step = F.col("value") / F.pow(F.lit(2.0), power)
    bucket = F.when(F.col("value") <= 0, F.lit(-1)).otherwise(power * 1024 + F.floor((step - 1) * 1024)).cast("int")
    classed = counts.withColumn("bucket", bucket)
    per_bucket = classed.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    along = W.partitionBy(*keys).orderBy("bucket")
    summed = per_bucket.select(
        *keys,
        "bucket",
        "n",
        F.sum("n").over(along).alias("upto"),
        F.sum("n").over(W.partitionBy(*keys)).alias("total"),
    )
    wanted = (
        summed.select(
            *keys,
            "bucket",
            "n",
            "upto",
            F.explode(
                F.array(*[F.struct(F.lit(name).alias("stat"), r.cast("bigint").alias("rank")) for name, r in ranks.items()])
            ).alias("w"),
        )
        .filter((F.col("w.rank") < F.col("upto")) & (F.col("w.rank") >= F.col("upto") - F.col("n")))
        .select(*keys, "bucket", "w.stat", (F.col("w.rank") - (F.col("upto") - F.col("n"))).alias("rank"))
    )
    within = W.partitionBy(*keys, "stat").orderBy("value")
    return (
        classed.join(wanted, [*keys, "bucket"])
        .withColumn("upto", F.sum("n").over(within))
        .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .select(*keys, "stat", "value")
    )


def _at_share(q: float) -> Column:
    """Rank of the q-share: ``min(n - 1, int(n * q))``."""
    return F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(q)))


_MEDIAN = {"low": F.floor, "high": F.ceil}


def _median_ranks() -> dict[str, Column]:
    middle = (F.col("total") - 1) / 2
    return {name: rounding(middle) for name, rounding in _MEDIAN.items()}


def _median(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the two middle values."""
    return rows.filter(F.col("stat").isin(list(_MEDIAN))).groupBy(*keys).agg(F.avg("value").alias("median"))


def size_table(files: DataFrame) -> DataFrame:
    """How often each size occurs per extension, written once: the files are read a single time for all that follows from it."""
    counts = files.groupBy("ext", "format_group", F.col("size").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    path = f"{shared_dir(files.sparkSession)}/sizes"
    counts.write.parquet(path)
    return files.sparkSession.read.schema(counts.schema).parquet(path)


def overview(files: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row of totals, mean, median, shares and maximum of the sizes; ``sizes`` is the ``size_table`` of the files, if it is there."""
    counts = (size_table(files) if sizes is None else sizes).groupBy("value").agg(F.sum("n").alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.coalesce(F.sum(known), F.lit(0)).alias("sized"),
        F.coalesce(F.sum(F.col("value") * F.col("n")), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("value"), F.lit(0)).alias("max"),
        F.coalesce(F.sum(F.when(F.col("value") == 0, F.col("n"))), F.lit(0)).alias("empty"),
    )
    names = ("files", "sized", "bytes", "max", "empty")
    as_rows = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("bigint").alias("value")) for n in names])).alias("z"))
    ranks = {**_median_ranks(), "p95": _at_share(0.95), "p99": _at_share(0.99)}
    stats = order_statistics(counts, [], ranks).select("stat", F.col("value").cast("bigint").alias("value"))

    def stat(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("stat") == name, F.col("value"))), F.lit(0))

    mean = F.when(stat("sized") > 0, stat("bytes") / stat("sized")).otherwise(F.lit(0.0))
    median = F.coalesce(F.avg(F.when(F.col("stat").isin(list(_MEDIAN)), F.col("value"))), F.lit(0))
    return as_rows.select("z.*").unionByName(stats).agg(
        stat("files").alias("total_files"),
        _mb(stat("bytes")).alias("total_size_mb"),
        F.round(mean / 1024, 2).alias("mean_size_kb"),
        F.round(median / 1024, 2).alias("median_size_kb"),
        F.round(stat("p95") / 1024, 2).alias("p95_size_kb"),
        _mb(stat("p99")).alias("p99_size_mb"),
        _mb(stat("max")).alias("max_size_mb"),
        stat("empty").alias("empty_files"),
    )


def by_extension(files: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Count, megabytes, median and maximum per extension, most files first."""
    sizes = size_table(files) if sizes is None else sizes
    sums = sizes.groupBy("ext", "format_group").agg(
        F.sum("n").alias("files"),
        _mb(F.sum(F.col("value") * F.col("n"))).alias("size_mb"),
        _mb(F.max("value")).alias("max_mb"),
    )
    medians = _median(order_statistics(sizes.select("ext", "value", "n"), ["ext"], _median_ranks()), ["ext"])
    return (
        sums.join(medians, "ext")
        .select(
            "ext", "format_group", "files", "size_mb", F.round(F.col("median") / 1024, 2).alias("median_kb"), "max_mb"
        )
        .orderBy(F.desc("files"), "ext")
    )


def extension_samples(files: DataFrame, n: int = 3) -> DataFrame:
    """The first paths of each extension."""
    rank = F.row_number().over(W.partitionBy("ext").orderBy("rel"))
    return files.select("ext", "rel", rank.alias("sample_no")).filter(F.col("sample_no") <= n)


def by_group(files: DataFrame) -> DataFrame:
    """Count, megabytes and share of the files per format group."""
    sums = files.groupBy("format_group").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
    # a handful of groups at most, so the window over all of them is small
    share = 100 * F.col("files") / F.sum("files").over(W.partitionBy(F.lit(1)))
    return sums.select(
        "format_group", "files", _mb(F.col("size")).alias("size_mb"), F.round(share, 1).alias("share_pct")
    ).orderBy(F.desc("files"), "format_group")


def size_bucket(size: Column) -> Column:
    out = F.lit(LAST_BUCKET)
    for label, upper in reversed(SIZE_BUCKETS):
        out = F.when(size <= upper, F.lit(label)).otherwise(out)
    return out


def size_histogram(files: DataFrame) -> DataFrame:
    """Files and megabytes per size class, empty classes included."""
    labels = [label for label, _ in SIZE_BUCKETS] + [LAST_BUCKET]
    classes = files.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("bucket_no", "bucket")
    )
    sums = files.groupBy(size_bucket(F.col("size")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")
    )
    return (
        classes.join(sums, "bucket", "left")
        .select(
            "bucket_no",
            "bucket",
            F.coalesce("files", F.lit(0).cast("bigint")).alias("files"),
            _mb(F.coalesce("size", F.lit(0))).alias("total_mb"),
        )
        .orderBy("bucket_no")
    )


def by_year(files: DataFrame) -> DataFrame:
    return files.groupBy(F.year("mtime").alias("year")).agg(F.count(F.lit(1)).alias("files")).orderBy("year")


def by_top_directory(files: DataFrame) -> DataFrame:
    """Files and megabytes per first path part, most files first."""
    top = F.substring_index("rel", "/", 1)
    return (
        files.groupBy(top.alias("top"))
        .agg(F.count(F.lit(1)).alias("files"), _mb(F.sum("size")).alias("size_mb"))
        .orderBy(F.desc("files"), "top")
    )


def by_depth(files: DataFrame) -> DataFrame:
    """Files per depth; the last row holds the greatest depth."""
    return files.groupBy("depth").agg(F.count(F.lit(1)).alias("files")).orderBy("depth")


def suspicious_labels(path: Column) -> Column:
    """Labels of all name rules that hit a path."""
    hits = [
        F.when(path.rlike(java(pattern, True)), F.lit(label)) for label, pattern in patterns.SUSPICIOUS_NAME.items()
    ]
    return F.array_compact(F.array(*hits))


def flagged(files: DataFrame) -> DataFrame:
    """Files with their name labels, one row per label."""
    return files.select("rel", "size", F.explode(suspicious_labels(F.col("rel"))).alias("label"))


def flagged_total(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.size(suspicious_labels(F.col("rel"))) > 0).alias("flagged_files"))


def by_label(files: DataFrame) -> DataFrame:
    """Files and megabytes per name label, most files first."""
    return (
        flagged(files)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("files"), _mb(F.sum("size")).alias("total_mb"))
        .orderBy(F.desc("files"), "label")
    )


def label_samples(files: DataFrame, n: int = 3) -> DataFrame:
    """The largest files of each label."""
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("size"), "rel"))
    return flagged(files).withColumn("sample_no", rank).filter(F.col("sample_no") <= n)


def column_rule(name: Column) -> Column:
    """Kind of personal data a column name suggests."""
    return first_rule(name, patterns.PROFILE_COLUMN)


def column_hits(columns: DataFrame) -> DataFrame:
    """Columns whose name suggests personal data; ``columns`` holds path and column."""
    return columns.withColumn("category", column_rule(F.col("column"))).filter(F.col("category").isNotNull())


def _rate(group: Column) -> Column:
    out = F.lit(RATES[OTHER_GROUP])
    for name, rate in RATES.items():
        out = F.when(group == name, F.lit(rate)).otherwise(out)
    return out


def _group_seconds(files: DataFrame) -> DataFrame:
    # bytes are summed as integers, so the result does not depend on the order of the rows
    return files.groupBy("format_group").agg(
        (F.sum("size") / MB * _rate(F.col("format_group"))).alias("seconds"), F.count(F.lit(1)).alias("files")
    )


def workload_by_group(files: DataFrame) -> DataFrame:
    return (
        _group_seconds(files)
        .select("format_group", F.round("seconds", 1).alias("seconds"))
        .orderBy(F.desc("seconds"), "format_group")
    )


def workload(files: DataFrame, workers: int = 8) -> DataFrame:
    """One row: estimated minutes for one and for all workers, and the files that need OCR."""
    seconds = F.coalesce(F.sum("seconds"), F.lit(0.0))
    return _group_seconds(files).agg(
        F.lit(workers).alias("workers_assumed"),
        F.round(seconds / 60, 1).alias("estimate_serial_minutes"),
        F.round(seconds / max(1, workers) / 60, 1).alias("estimate_parallel_minutes"),
        F.coalesce(F.sum(F.when(F.col("format_group").isin(list(OCR_GROUPS)), F.col("files"))), F.lit(0))
        .cast("bigint")
        .alias("ocr_intensive_files"),
    )


def _first(files: DataFrame, order: list[Column], n: int, *columns: Column) -> DataFrame:
    return files.orderBy(*order).limit(n).select(*columns)


def biggest(files: DataFrame, n: int = 25) -> DataFrame:
    return _first(files, [F.desc("size"), F.col("rel")], n, _mb(F.col("size")).alias("size_mb"), F.col("rel"))


def _minute() -> Column:
    return F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("date")


def oldest(files: DataFrame, n: int = 5) -> DataFrame:
    return _first(files, [F.col("mtime"), F.col("rel")], n, _minute(), F.col("rel"))


def newest(files: DataFrame, n: int = 5) -> DataFrame:
    return _first(files, [F.desc("mtime"), F.col("rel")], n, _minute(), F.col("rel"))


def quick_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("total_files"), F.round(F.coalesce(F.sum("size"), F.lit(0)) / MB, 1).alias("total_mb")
    )


def quick_extensions(files: DataFrame) -> DataFrame:
    return (
        files.groupBy("ext")
        .agg(F.count(F.lit(1)).alias("files"), _mb(F.sum("size")).alias("size_mb"))
        .orderBy(F.desc("files"), "ext")
    )


def quick_biggest(files: DataFrame, n: int = 20) -> DataFrame:
    """Largest files; of equal ones the greater path comes first."""
    return _first(files, [F.desc("size"), F.desc("path")], n, _mb(F.col("size")).alias("size_mb"), F.col("path"))
