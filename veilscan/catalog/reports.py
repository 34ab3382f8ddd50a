"""Findings, classification, reports and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.catalog import corpus, oracle, query
from veilscan.catalog.detection import letters_source
from veilscan.functions.files import guess_kind, suffix, with_mime
from veilscan.operators import classify as cls
from veilscan.operators import dedup
from veilscan.operators import findings as fnd
from veilscan.operators import reports as rpt
from veilscan.session import shared_dir
from veilscan.streaming.stream import scanned_so_far, start_scan


def _letters(spark, sf_dir) -> DataFrame:
    letters = corpus.letters(spark, sf_dir)
    return letters.select("path", "chunk_no", "text", F.concat(F.lit("rows="), F.length("text")).alias("locator"))


def _documents(spark, sf_dir) -> DataFrame:
    docs = corpus.texts(spark, sf_dir)
    return docs.select(
        F.concat(F.lit("/docs/"), F.col("source"), F.lit(".txt")).alias("path"),
        F.col("doc_id").alias("chunk_no"),
        "text",
        F.lit("full").alias("locator"),
    )


_DOCS_SQL = "SELECT '/docs/' || source || '.txt' AS path, doc_id AS chunk_no, text FROM documents"


def _letter_files(spark, sf_dir) -> DataFrame:
    """The files of the letters, with the facts that their orders give."""
    letters = corpus.letters(spark, sf_dir)
    facts = letters.groupBy("path").agg(
        F.sum(F.octet_length("text")).alias("size"), F.max("doc_id").alias("last")
    )
    start = F.unix_timestamp(F.lit("2019-01-01 06:00:00").cast("timestamp"))
    timed = facts.withColumn("mtime", F.timestamp_seconds(start + F.col("last") * 3700)).drop("last")
    typed = with_mime(timed.withColumn("ext", suffix(F.col("path"))))
    kind = guess_kind(F.col("ext"), F.col("mime"))
    return typed.withColumn("kind", kind).withColumn("error", F.when(kind.isNull(), F.lit("unsupported_format")))


def _scan(spark, sf_dir, **settings) -> DataFrame:
    return fnd.scan_chunks(_letters(spark, sf_dir), **settings)


def _reports(spark, sf_dir) -> DataFrame:
    return rpt.file_reports(_scan(spark, sf_dir), _letter_files(spark, sf_dir))


def _findings_sql(source: str) -> str:
    return (
        oracle.spans(source)
        + f""", per_value AS (SELECT path, category, value, sha256(value) AS value_hash,
        arg_min(confidence, CAST(chunk_no AS HUGEINT) * 1000000000 + det * 10000000 + s) AS confidence, count(*) AS occurrences
      FROM (SELECT path, chunk_no, det, category, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value, s, confidence FROM spans) WHERE value <> ''
      GROUP BY path, category, value)
    """
    )


def _findings_select(source: str) -> str:
    return _findings_sql(source) + (
        f"SELECT path, category, {oracle.masked()} AS value_masked, value_hash, round(confidence, 3) AS confidence, occurrences FROM per_value"
    )


@query("findings_letters", _findings_select(letters_source()))
def findings_letters(spark, sf_dir):
    return fnd.findings(_scan(spark, sf_dir))


@query("findings_documents", _findings_select(_DOCS_SQL))
def findings_documents(spark, sf_dir):
    return fnd.findings(fnd.scan_chunks(_documents(spark, sf_dir)))


@query(
    "findings_without_hash",
    _findings_sql(letters_source())
    + "SELECT path, category, '' AS value_hash, sum(occurrences)::BIGINT AS occurrences, count(*) AS findings FROM per_value GROUP BY path, category",
)
def findings_without_hash(spark, sf_dir):
    found = fnd.findings(_scan(spark, sf_dir, store_value_hash=False))
    return found.groupBy("path", "category", "value_hash").agg(
        F.sum("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("findings")
    )


@query(
    "category_counts",
    _findings_sql(letters_source())
    + "SELECT path, category, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM per_value GROUP BY path, category",
)
def category_counts(spark, sf_dir):
    return fnd.category_counts(_scan(spark, sf_dir))


def _reports_sql(source: str) -> str:
    """per_file: sums per group, rows and text length; counted: occurrences per category."""
    g = oracle.group_sum
    return (
        _findings_sql(source)
        + f""", counted AS (SELECT path, category, CAST(sum(occurrences) AS BIGINT) AS n FROM per_value GROUP BY path, category),
    sums AS (SELECT path, {g('regular')} AS regular, {g('state_id')} AS state_id, {g('payment')} AS payment, {g('special')} AS special,
        CAST(sum(n) AS BIGINT) AS total, count(*) AS categories, string_agg(category, '|' ORDER BY category) AS names,
        string_agg(category || ' (' || n || ')', ', ' ORDER BY n DESC, category) AS line,
        max(CASE WHEN category NOT IN ('fio', 'phone', 'email', 'birth_date', 'birth_place', 'address', 'inn_legal', 'ogrn') THEN 1 ELSE 0 END) AS strong,
        max(CASE WHEN category IN ('email', 'phone', 'birth_date') THEN 1 ELSE 0 END) AS linking
      FROM counted GROUP BY path),
    sizes AS (SELECT path, CAST(sum(length(text)) AS BIGINT) AS text_length, CAST(sum(length(text)) AS BIGINT) AS row_count,
        CAST(sum(strlen(text)) AS BIGINT) AS size, max(chunk_no) AS last FROM t GROUP BY path),
    per_file AS (SELECT z.path, z.text_length, z.row_count, z.size, z.last, coalesce(regular, 0) AS regular, coalesce(state_id, 0) AS state_id,
        coalesce(payment, 0) AS payment, coalesce(special, 0) AS special, coalesce(total, 0) AS total, coalesce(categories, 0) AS categories,
        coalesce(names, '') AS names, coalesce(line, '') AS line, coalesce(strong, 0) AS strong, coalesce(linking, 0) AS linking
      FROM sizes z LEFT JOIN sums s ON s.path = z.path),
    leveled AS (SELECT *, {oracle.level({k: k for k in ('special', 'payment', 'state_id', 'regular')}, 'row_count')} AS protection_level,
        CASE WHEN path LIKE '%.txt' THEN 'txt' WHEN path LIKE '%.html' THEN 'html' ELSE '' END AS ext,
        (strong = 1 OR (linking = 1 AND (categories >= 2 OR total >= 3))) AS confident FROM per_file)
    """
    )


_LETTER_REPORTS = _reports_sql(letters_source())


@query(
    "group_sums",
    _LETTER_REPORTS + "SELECT path, regular, state_id, payment, special FROM leveled WHERE total > 0",
)
def group_sums(spark, sf_dir):
    counts = F.col("category_counts")
    sums = {g: cls.group_sum(counts, g) for g in ("regular", "state_id", "payment", "sensitive", "biometric")}
    reports = rpt.file_reports(_scan(spark, sf_dir)).filter(F.size(counts) > 0)
    return reports.select(
        "path",
        sums["regular"].alias("regular"),
        sums["state_id"].alias("state_id"),
        sums["payment"].alias("payment"),
        (sums["sensitive"] + sums["biometric"]).alias("special"),
    )


@query(
    "protection_level",
    _LETTER_REPORTS + "SELECT path, protection_level, text_length, row_count AS rows_processed FROM leveled",
)
def protection_level(spark, sf_dir):
    return rpt.file_reports(_scan(spark, sf_dir)).select("path", "protection_level", "text_length", "rows_processed")


@query(
    "protection_level_thresholds",
    _LETTER_REPORTS
    + """SELECT path, CASE WHEN special > 0 THEN 'УЗ-1' WHEN payment > 0 OR state_id >= 2 OR state_id / row_count >= 0.5 THEN 'УЗ-2'
      WHEN state_id > 0 OR regular >= 3 OR regular / row_count >= 0.004 THEN 'УЗ-3' WHEN regular > 0 THEN 'УЗ-4' ELSE 'Без ПДн' END AS protection_level
    FROM leveled""",
)
def protection_level_thresholds(spark, sf_dir):
    limits = {
        "state_id_large_count": 2, "state_id_large_ratio": 0.5, "regular_large_count": 3, "regular_large_ratio": 0.004,
    }
    return rpt.file_reports(_scan(spark, sf_dir), **limits).select("path", "protection_level")


@query(
    "recommendation",
    _LETTER_REPORTS
    + "SELECT protection_level, CASE protection_level "
    + " ".join(f"WHEN '{level}' THEN '{text}'" for level, text in cls.RECOMMENDATIONS.items())
    + " END AS recommendation, count(*) AS files FROM leveled GROUP BY ALL",
)
def recommendation(spark, sf_dir):
    reports = rpt.file_reports(_scan(spark, sf_dir))
    level = F.col("protection_level")
    return reports.groupBy(level, cls.recommendation(level).alias("recommendation")).agg(F.count(F.lit(1)).alias("files"))


@query("confident_files", _LETTER_REPORTS + "SELECT path, confident FROM leveled")
def confident_files(spark, sf_dir):
    return rpt.file_reports(_scan(spark, sf_dir)).select("path", cls.is_confident(F.col("category_counts")).alias("confident"))


@query("report_categories_line", _LETTER_REPORTS + "SELECT path, line FROM leveled")
def report_categories_line(spark, sf_dir):
    return rpt.file_reports(_scan(spark, sf_dir)).select("path", rpt.category_line(F.col("category_counts")).alias("line"))


@query(
    "report_csv",
    _LETTER_REPORTS
    + """SELECT path AS "путь", names AS "категории_ПДн", total AS "количество_находок", protection_level AS "УЗ", ext AS "формат_файла",
      CASE protection_level """
    + " ".join(f"WHEN '{level}' THEN '{text}'" for level, text in cls.RECOMMENDATIONS.items())
    + ' END AS "рекомендации" FROM leveled',
)
def report_csv(spark, sf_dir):
    return rpt.report_rows(_reports(spark, sf_dir))


@query(
    "result_csv",
    _LETTER_REPORTS
    + """SELECT size, lower(strftime(ts, '%b')) || ' ' || day(ts) || ' ' || strftime(ts, '%H:%M') AS time, string_split(path, '/')[-1] AS name
    FROM (SELECT *, TIMESTAMP '2019-01-01 06:00:00' + to_seconds(last * 3700) AS ts FROM leveled WHERE confident)""",
)
def result_csv(spark, sf_dir):
    return rpt.result_rows(_reports(spark, sf_dir))


@query(
    "report_totals",
    _LETTER_REPORTS
    + """SELECT count(*) AS total_files, CAST(sum(CASE WHEN total > 0 THEN 1 ELSE 0 END) AS BIGINT) AS files_with_pii,
      CAST(sum(CASE WHEN ext = '' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM leveled""",
)
def report_totals(spark, sf_dir):
    return rpt.totals(_reports(spark, sf_dir))


@query(
    "report_by_format",
    _LETTER_REPORTS + "SELECT CASE WHEN ext = '' THEN '(без расш.)' ELSE ext END AS format, count(*) AS files FROM leveled GROUP BY ALL",
)
def report_by_format(spark, sf_dir):
    return rpt.by_format(_reports(spark, sf_dir))


@query(
    "report_by_level", _LETTER_REPORTS + "SELECT protection_level, count(*) AS files FROM leveled GROUP BY ALL"
)
def report_by_level(spark, sf_dir):
    return rpt.by_level(_reports(spark, sf_dir))


_BY_CATEGORY = "SELECT category, CAST(sum(n) AS BIGINT) AS findings FROM counted GROUP BY category"


@query("report_by_category", _LETTER_REPORTS + _BY_CATEGORY)
def report_by_category(spark, sf_dir):
    return rpt.by_category(_reports(spark, sf_dir))


@query("report_top_categories", _LETTER_REPORTS + _BY_CATEGORY + " ORDER BY findings DESC, category LIMIT 10")
def report_top_categories(spark, sf_dir):
    return rpt.top_categories(_reports(spark, sf_dir), 10)


@query(
    "report_top_files",
    _LETTER_REPORTS
    + "SELECT path, protection_level, total AS findings, replace(names, '|', ', ') AS categories FROM leveled ORDER BY total DESC, path LIMIT 20",
)
def report_top_files(spark, sf_dir):
    return rpt.top_files(_reports(spark, sf_dir), 20)


@query(
    "report_errors",
    _LETTER_REPORTS
    + """SELECT path, CASE WHEN ext = 'txt' THEN 'text' WHEN ext = 'html' THEN 'html' END AS kind,
      CASE WHEN ext = '' THEN 'unsupported_format' END AS error FROM leveled""",
)
def report_errors(spark, sf_dir):
    return _reports(spark, sf_dir).select("path", "kind", "error")


@query(
    "report_summary",
    _LETTER_REPORTS
    + f"""SELECT 'total_files' AS metric, '' AS key, count(*) AS value FROM leveled
    UNION ALL SELECT 'files_with_pii', '', CAST(sum(CASE WHEN total > 0 THEN 1 ELSE 0 END) AS BIGINT) FROM leveled
    UNION ALL SELECT 'errors', '', CAST(sum(CASE WHEN ext = '' THEN 1 ELSE 0 END) AS BIGINT) FROM leveled
    UNION ALL SELECT 'protection_level_counts', protection_level, count(*) FROM leveled GROUP BY ALL
    UNION ALL SELECT 'category_counts', category, CAST(sum(n) AS BIGINT) FROM counted GROUP BY ALL
    UNION ALL SELECT 'format_counts', CASE WHEN ext = '' THEN '(без расш.)' ELSE ext END, count(*) FROM leveled GROUP BY ALL""",
)
def report_summary(spark, sf_dir):
    from veilscan.sources.sinks import summary

    return summary(_reports(spark, sf_dir))


@query(
    "report_json_roundtrip",
    _LETTER_REPORTS
    + "SELECT path, size, protection_level, total AS findings, text_length FROM leveled",
)
def report_json_roundtrip(spark, sf_dir):
    """Reports written as JSON lines and read back; the letters are searched once."""
    from veilscan.sources.sinks import read_reports, write_report_json

    out = shared_dir(spark)
    _scan(spark, sf_dir).write.parquet(f"{out}/scanned")
    scanned = spark.read.parquet(f"{out}/scanned")
    write_report_json(rpt.file_reports(scanned, _letter_files(spark, sf_dir)), fnd.findings(scanned), out)
    return read_reports(spark, out).select(
        "path", "size", "protection_level", cls.total(F.col("category_counts")).alias("findings"), "text_length"
    )


@query(
    "scan_documents",
    _reports_sql(_DOCS_SQL).replace(
        "CAST(sum(length(text)) AS BIGINT) AS row_count", "CAST(0 AS BIGINT) AS row_count"
    )
    + "SELECT path, protection_level, total AS findings, line, text_length FROM leveled",
)
def scan_documents(spark, sf_dir):
    """The flagship: all documents searched, combined and classified per source."""
    reports = rpt.file_reports(fnd.scan_chunks(_documents(spark, sf_dir)))
    counts = F.col("category_counts")
    return reports.select(
        "path", "protection_level", cls.total(counts).alias("findings"), rpt.category_line(counts).alias("line"), "text_length"
    )


@query("stream_scan", _findings_select(_DOCS_SQL))
def stream_scan(spark, sf_dir):
    """The findings of the documents once more, from a stream that runs until all input is read."""
    out = shared_dir(spark)
    schema = corpus.documents(spark, sf_dir).schema
    # a glob, as the table may be one file or a folder of many, and a stream takes no single file by its name
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/documents.parque[t]")
    chunks = stream.select(
        F.concat(F.lit("/docs/"), F.col("source"), F.lit(".txt")).alias("path"),
        F.col("doc_id").alias("chunk_no"),
        "text",
        F.lit("full").alias("locator"),
    )
    start_scan(chunks, f"{out}/spans", f"{out}/checkpoint").awaitTermination()
    return fnd.findings(scanned_so_far(spark, f"{out}/spans"))


# -- duplicates -----------------------------------------------------------------------------------

def _hashed_documents(spark, sf_dir) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    return docs.select(
        F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"),
        F.col("n_chars").alias("size"),
        dedup.content_hash(F.col("text")).alias("content_hash"),
    )


_HASHED = (
    "WITH f AS (SELECT 'doc' || lpad(CAST(doc_id AS STRING), 9, '0') AS path, n_chars AS size, sha256(text) AS content_hash FROM documents)"
)


@query("content_hash", _HASHED + " SELECT path, content_hash FROM f")
def content_hash(spark, sf_dir):
    return _hashed_documents(spark, sf_dir).select("path", "content_hash")


@query("dedup_first", _HASHED + " SELECT min(path) AS path, content_hash FROM f GROUP BY content_hash")
def dedup_first(spark, sf_dir):
    return dedup.keep_first(_hashed_documents(spark, sf_dir)).select("path", "content_hash")


@query(
    "dedup_map",
    _HASHED + " SELECT path, first AS duplicate_of FROM (SELECT path, min(path) OVER (PARTITION BY content_hash) AS first FROM f) WHERE path <> first",
)
def dedup_map(spark, sf_dir):
    return dedup.duplicate_map(_hashed_documents(spark, sf_dir))


@query(
    "dedup_totals",
    _HASHED + " SELECT count(DISTINCT content_hash) AS total_unique, count(*) - count(DISTINCT content_hash) AS total_duplicates FROM f",
)
def dedup_totals(spark, sf_dir):
    return dedup.duplicate_totals(_hashed_documents(spark, sf_dir))


@query(
    "dedup_summary",
    _HASHED
    + """, g AS (SELECT content_hash, max(size) AS size, count(*) - 1 AS extra FROM f GROUP BY content_hash)
    SELECT (SELECT count(*) FROM f) AS scanned, CAST(0 AS BIGINT) AS skipped_too_large,
      count(*) AS unique_files, CAST(sum(CASE WHEN extra > 0 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_groups,
      CAST(sum(extra) AS BIGINT) AS total_duplicates, round(sum(size * extra) / 1048576, 2) AS bytes_saved_mb FROM g""",
)
def dedup_summary(spark, sf_dir):
    return dedup.duplicate_summary(_hashed_documents(spark, sf_dir))


@query(
    "dedup_groups",
    _HASHED
    + """, g AS (SELECT content_hash, max(size) AS size, count(*) AS copies, min(path) AS first FROM f GROUP BY content_hash HAVING count(*) > 1
      ORDER BY copies DESC, first LIMIT 15)
    SELECT f.content_hash, round(g.size / 1024, 2) AS size_kb, copies, row_number() OVER (PARTITION BY f.content_hash ORDER BY f.path) AS path_no, f.path
    FROM f JOIN g ON f.content_hash = g.content_hash QUALIFY path_no <= 5""",
)
def dedup_groups(spark, sf_dir):
    return dedup.largest_groups(_hashed_documents(spark, sf_dir))


@query(
    "scan_unique_documents",
    _findings_select(
        "SELECT '/docs/' || source || '.txt' AS path, doc_id AS chunk_no, text FROM documents"
        " QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1"
    ),
)
def scan_unique_documents(spark, sf_dir):
    """Each distinct text is searched once."""
    docs = corpus.documents(spark, sf_dir)
    firsts = docs.groupBy(dedup.content_hash(F.col("text"))).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    chunks = _documents(spark, sf_dir).join(firsts.withColumnRenamed("doc_id", "chunk_no"), "chunk_no", "left_semi")
    return fnd.findings(fnd.scan_chunks(chunks.select("path", "chunk_no", "text", "locator")))
