"""File trees written from the given tables and read back: splits, mixed schemas, errors, the whole scan."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.catalog import corpus, query
from veilscan.catalog.reports import _findings_select, _reports_sql
from veilscan.operators import classify as cls
from veilscan.operators import findings as fnd
from veilscan.plans.scan import scan_tree
from veilscan.session import shared_dir
from veilscan.sources.delimited import large_csv_chunks
from veilscan.sources.parquet import mixed_parquet_chunks, parquet_footers
from veilscan.sources.windows import text_windows


@contextmanager
def _splits(spark: SparkSession, n: int):
    """Splits of ``n`` bytes for what is read inside, so that even a small table fills several."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, str(n))
    try:
        yield
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def _folder(path: str = "path"):
    """The part of a path that the writer was given; file names are the writer's own."""
    return F.regexp_extract(path, r"/no=([^/]+)/[^/]+$", 1)


def _write(rows: DataFrame, out: str, form: str, **options: str) -> None:
    """One file for each ``no``; rows in the order of ``pos``."""
    one = rows.repartition("no").sortWithinPartitions("no", "pos").drop("pos")
    one.write.partitionBy("no").options(**options).format(form).save(out)


def _rename_all(spark: SparkSession, folder: str, extension: str) -> None:
    """Give the few files of a folder another extension, on any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(path):
        old = status.getPath()
        if old.getName().startswith("part-"):
            store.rename(old, spark._jvm.org.apache.hadoop.fs.Path(old.getParent(), old.getName().split(".")[0] + extension))


# Line items as delimited files of about 60 000 rows, with quoted line ends and rows that have a cell too many.
_ITEMS = """SELECT CAST(floor(l_orderkey / 15000) AS BIGINT) AS no, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS pos, l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem"""
_ITEM_LINE = """'id=' || l_orderkey || '; [[PII_DIRECT:fio:client "' || l_partkey || '"' || chr(10) || 'of ' || l_linenumber || ']]' || CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '; note=x;y' || l_returnflag END"""


@query(
    "src_csv_splits",
    f"""SELECT CAST(no AS STRING) AS folder, chunk_no, 'chunk=' || chunk_no || ':rows=' || count(*) AS locator,
      md5('id full_name note' || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS digest
    FROM (SELECT *, CAST(floor(n / 25000) AS BIGINT) AS chunk_no FROM (
      SELECT no, {_ITEM_LINE} AS line, row_number() OVER (PARTITION BY no ORDER BY pos, l_returnflag) - 1 AS n FROM ({_ITEMS}) WHERE l_partkey % 50 <> 7))
    GROUP BY no, chunk_no""",
)
def src_csv_splits(spark, sf_dir):
    """Files of several chunks each, read in splits of 256 KB that cut records and quoted fields."""
    items = corpus._run(spark, sf_dir, _ITEMS, "lineitem")
    quoted = F.concat(F.lit('"client ""'), F.col("l_partkey").cast("string"), F.lit('""\n'), F.lit("of "), F.col("l_linenumber").cast("string"), F.lit('"'))
    note = F.when(F.col("l_partkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"x;y'), "l_returnflag", F.lit('"')))
    line = F.concat_ws(";", F.col("l_orderkey").cast("string"), quoted, note)
    line = F.when(F.col("l_partkey") % 50 == 7, F.concat(line, F.lit(";too;many"))).otherwise(line)
    body = items.select("no", "pos", F.col("l_returnflag").alias("flag"), line.alias("value"))
    head = body.groupBy("no").agg(F.lit(-1).cast("long").alias("pos"), F.lit("").alias("flag"), F.lit("id;full_name;note").alias("value"))
    out = f"{shared_dir(spark)}/csv"
    rows = body.unionByName(head).repartition("no").sortWithinPartitions("no", "pos", "flag")
    rows.select("no", "value").write.partitionBy("no").text(out)
    with _splits(spark, 256 * 1024):
        chunks = large_csv_chunks(spark, out, "*.txt", -1)
    return chunks.select(_folder().alias("folder"), "chunk_no", "locator", F.md5("text").alias("digest"))


# Letters as 17 text files, marked ones in a file of their own.
_LETTER_FILES = f"""SELECT CASE WHEN contains(text, '[[PII_DIRECT:') THEN 'm' ELSE CAST(doc_id % 16 AS STRING) END AS no, doc_id AS pos, text AS value FROM ({corpus.letters_sql()})"""
_LETTER_TEXTS = f"SELECT no AS path, CAST(0 AS BIGINT) AS chunk_no, string_agg(value, chr(10) ORDER BY pos) || chr(10) AS text FROM ({_LETTER_FILES}) GROUP BY no"


def _letter_files(spark, sf_dir, out: str) -> None:
    letters = corpus.letters(spark, sf_dir)
    no = F.when(F.col("text").contains("[[PII_DIRECT:"), F.lit("m")).otherwise((F.col("doc_id") % 16).cast("string"))
    _write(letters.select(no.alias("no"), F.col("doc_id").alias("pos"), F.col("text").alias("value")), out, "text")


@query("src_text_splits", _findings_select(_LETTER_TEXTS))
def src_text_splits(spark, sf_dir):
    """Findings of long texts that are read in splits of 16 KB, equal to those of the whole texts."""
    out = f"{shared_dir(spark)}/letters"
    _letter_files(spark, sf_dir, out)
    with _splits(spark, 16 * 1024):
        chunks = text_windows(spark, out, "*.txt", -1, halo=1024, core=8192)
        scanned = fnd.scan_chunks(chunks.withColumn("path", _folder()))
        found = f"{shared_dir(spark)}/found"
        fnd.findings(scanned).write.parquet(found)
    return spark.read.parquet(found)


_ROWS = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name",
}


def _rendered(table: str, columns: str) -> str:
    cells = " || '; ' || ".join(f"'{c}=' || {c}" for c in columns.split())
    return f"SELECT '{table}' AS folder, {cells} AS text, CAST(NULL AS STRING) AS error FROM {table} UNION ALL SELECT '{table}', '{columns}', NULL"


@query(
    "src_parquet_mixed",
    " UNION ALL ".join(_rendered(t, c) for t, c in _ROWS.items())
    + " UNION ALL SELECT 'texts', 's_suppkey=' || s_suppkey, NULL FROM supplier UNION ALL SELECT 'texts', 's_suppkey', NULL UNION ALL SELECT 'broken', NULL, 'unhandled'",
)
def src_parquet_mixed(spark, sf_dir):
    """Files of four schemas, two of which conflict, and files that are no Parquet at all."""
    out = shared_dir(spark)
    for name, columns in _ROWS.items():
        corpus.table(spark, sf_dir, name).select(*columns.split()).write.parquet(f"{out}/no={name}")
    suppliers = corpus.table(spark, sf_dir, "supplier")
    suppliers.select(F.col("s_suppkey").cast("string").alias("s_suppkey")).write.parquet(f"{out}/no=texts")
    corpus.table(spark, sf_dir, "region").select("r_name").write.text(f"{out}/no=broken")
    _rename_all(spark, f"{out}/no=broken", ".parquet")
    chunks = mixed_parquet_chunks(spark, parquet_footers(spark, out))
    # each file has its own line of column names, however many files a table was written to
    return chunks.select(_folder().alias("folder"), "text", F.substring_index("error", ":", 1).alias("error")).distinct()


@query(
    "scan_tree_files",
    _reports_sql(_LETTER_TEXTS).replace("CAST(sum(length(text)) AS BIGINT) AS row_count", "CAST(0 AS BIGINT) AS row_count")
    + """SELECT path AS folder, 'text' AS kind, CAST(NULL AS STRING) AS error, protection_level, total AS findings, text_length FROM leveled
    UNION ALL SELECT 'copy', 'text', NULL, protection_level, total, text_length FROM leveled WHERE false
    UNION ALL SELECT 'unknown', NULL, 'unsupported_format', 'Без ПДн', 0, 0
    UNION ALL SELECT 'packed', NULL, 'unsupported_format', 'Без ПДн', 0, 0
    UNION ALL SELECT 'broken', 'parquet', 'unhandled', 'Без ПДн', 0, 0
    UNION ALL SELECT 'scan', 'pdf', 'no_reader_for_format', 'Без ПДн', 0, 0""",
)
def scan_tree_files(spark, sf_dir):
    """The whole scan over a tree of letters, copies of them and files that cannot be read, in splits of 64 KB, nothing read whole."""
    out = shared_dir(spark)
    root = f"{out}/tree"
    _letter_files(spark, sf_dir, f"{root}/a")
    # copies come later in the order of paths, so none of them is left
    _letter_files(spark, sf_dir, f"{root}/b")
    names = corpus.table(spark, sf_dir, "region").select("r_name").coalesce(1)
    for name, extension in (("unknown", ".orc"), ("packed", ".zst1"), ("broken", ".parquet"), ("scan", ".pdf")):
        names.select(F.concat(F.lit(f"{name} "), "r_name")).write.text(f"{root}/no={name}")
        _rename_all(spark, f"{root}/no={name}", extension)
    with _splits(spark, 64 * 1024):
        _, reports = scan_tree(spark, root, f"{out}/scan", whole_file_bytes=16 * 1024)
    return reports.select(
        _folder().alias("folder"), "kind", F.substring_index("error", ":", 1).alias("error"), "protection_level", cls.total(F.col("category_counts")).alias("findings"), "text_length"
    )
