"""The dataset profile over the file facts of documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilscan.catalog import corpus, query
from veilscan.functions import patterns
from veilscan.functions.files import FORMAT_GROUPS
from veilscan.operators import profile as prf

_GROUP_CASES = " ".join(
    f"WHEN ext IN ({', '.join(repr(e) for e in extensions)}) THEN '{name}'" for name, extensions in FORMAT_GROUPS.items()
)
_FACTS = f"""WITH raw AS ({corpus.files_sql()}),
named AS (SELECT *, substr(path, 8) AS rel, lower(regexp_extract(string_split(path, '/')[-1], '(?s)^.+(\\.[^.]+)$', 1)) AS ext0 FROM raw),
f AS (SELECT path, size, mtime, rel, ext, CASE {_GROUP_CASES} ELSE 'Прочее' END AS format_group, len(string_split(rel, '/')) - 1 AS depth
  FROM (SELECT *, CASE WHEN ext0 = '' THEN '(без расш.)' ELSE ext0 END AS ext FROM named))
"""


def _facts(spark, sf_dir):
    return prf.file_facts(corpus.files(spark, sf_dir).drop("content"), "/share")


def _register(name: str, run, sql: str) -> None:
    query(f"prf_{name}", _FACTS + sql)(lambda spark, sf_dir: run(_facts(spark, sf_dir)))


_MB = "1048576"
_register(
    "file_facts",
    lambda f: f.select("path", "rel", "ext", "format_group", F.col("depth").cast("bigint").alias("depth"), "size"),
    "SELECT path, rel, ext, format_group, depth, size FROM f",
)
_register(
    "overview",
    prf.overview,
    f"""SELECT count(*) AS total_files, round(sum(size) / {_MB}, 2) AS total_size_mb, round(median(size) / 1024, 2) AS median_size_kb,
      round(avg(size) / 1024, 2) AS mean_size_kb, round(max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN size END) / 1024, 2) AS p95_size_kb,
      round(max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.99) AS BIGINT)) THEN size END) / {_MB}, 2) AS p99_size_mb,
      round(max(size) / {_MB}, 2) AS max_size_mb, CAST(sum(CASE WHEN size = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_files
    FROM (SELECT size, row_number() OVER (ORDER BY size) - 1 AS r, count(*) OVER () AS n FROM f)""",
)
_register(
    "percentiles",
    lambda f: prf.order_statistics(
        f.groupBy("format_group", F.col("size").alias("value")).agg(F.count(F.lit(1)).alias("n")),
        ["format_group"],
        {"p10": prf._at_share(0.1), "p50": prf._at_share(0.5), "p95": prf._at_share(0.95)},
    ),
    """SELECT format_group, stat, size AS value FROM (SELECT format_group, size, row_number() OVER (PARTITION BY format_group ORDER BY size) - 1 AS r,
      count(*) OVER (PARTITION BY format_group) AS n FROM f) JOIN (VALUES ('p10', 0.1), ('p50', 0.5), ('p95', 0.95)) AS q(stat, share)
      ON r = least(n - 1, CAST(floor(n * CAST(share AS DOUBLE)) AS BIGINT))""",
)
_register(
    "by_extension",
    prf.by_extension,
    f"""SELECT ext, format_group, count(*) AS files, round(sum(size) / {_MB}, 2) AS size_mb, round(median(size) / 1024, 2) AS median_kb,
      round(max(size) / {_MB}, 2) AS max_mb FROM f GROUP BY ext, format_group""",
)
_register(
    "extension_samples",
    prf.extension_samples,
    "SELECT ext, rel, row_number() OVER (PARTITION BY ext ORDER BY rel) AS sample_no FROM f QUALIFY sample_no <= 3",
)
_register(
    "by_group",
    prf.by_group,
    f"""SELECT format_group, count(*) AS files, round(sum(size) / {_MB}, 2) AS size_mb,
      round(100 * count(*) / (SELECT count(*) FROM f), 1) AS share_pct FROM f GROUP BY format_group""",
)
_BUCKETS = " ".join(f"WHEN size <= {upper} THEN {i}" for i, (_, upper) in enumerate(prf.SIZE_BUCKETS))
_LABELS = ", ".join(f"({i}, '{label}')" for i, (label, _) in enumerate((*prf.SIZE_BUCKETS, (prf.LAST_BUCKET, 0))))
_register(
    "size_histogram",
    prf.size_histogram,
    f"""SELECT bucket_no, bucket, count(size) AS files, round(coalesce(sum(size), 0) / {_MB}, 2) AS total_mb
    FROM (VALUES {_LABELS}) AS b(bucket_no, bucket) LEFT JOIN (SELECT size, CASE {_BUCKETS} ELSE 8 END AS no FROM f) ON no = bucket_no GROUP BY ALL""",
)
_register("by_year", prf.by_year, "SELECT year(mtime) AS year, count(*) AS files FROM f GROUP BY ALL")
_register(
    "by_top_directory",
    prf.by_top_directory,
    f"SELECT string_split(rel, '/')[1] AS top, count(*) AS files, round(sum(size) / {_MB}, 2) AS size_mb FROM f GROUP BY ALL",
)
_register("by_depth", prf.by_depth, "SELECT depth, count(*) AS files FROM f GROUP BY ALL")
_register(
    "max_depth",
    lambda f: f.agg(F.max("depth").alias("max_depth")),
    "SELECT max(depth) AS max_depth FROM f",
)

# The rules with a word boundary, written for an engine whose boundaries are ASCII.
_EDGE = r"(?:^|$|[^\p{L}\p{N}_])"
_NAME_RULES = dict(patterns.SUSPICIOUS_NAME) | {
    "inn": rf"{_EDGE}inn{_EDGE}|инн[_-]?\d?",
    "driver_license": rf"водит|driver[_-]?lic|вод[_-]?удост|prava|права{_EDGE}",
    "resume": rf"резюме|resume|{_EDGE}cv[_ -]",
    "scan_archive": rf"{_EDGE}ca\d+_\d+",
}
_FLAGGED = ", flagged AS (" + " UNION ALL ".join(
    f"SELECT rel, size, '{label}' AS label FROM f WHERE regexp_matches(rel, '(?i){pattern}')"
    for label, pattern in _NAME_RULES.items()
) + ") "
_register("flagged_names", lambda f: prf.flagged(f), _FLAGGED + "SELECT rel, size, label FROM flagged")
_register(
    "flagged_total", prf.flagged_total, _FLAGGED + "SELECT count(DISTINCT rel) AS flagged_files FROM flagged"
)
_register(
    "by_label",
    prf.by_label,
    _FLAGGED + f"SELECT label, count(*) AS files, round(sum(size) / {_MB}, 2) AS total_mb FROM flagged GROUP BY label",
)
_register(
    "label_samples",
    prf.label_samples,
    _FLAGGED
    + "SELECT rel, size, label, row_number() OVER (PARTITION BY label ORDER BY size DESC, rel) AS sample_no FROM flagged QUALIFY sample_no <= 3",
)

_RATE = " ".join(f"WHEN '{g}' THEN {r}" for g, r in prf.RATES.items())
_SECONDS = f"(SELECT format_group, sum(size) / {_MB} * CAST(CASE format_group {_RATE} ELSE 0.1 END AS DOUBLE) AS seconds, count(*) AS files FROM f GROUP BY format_group)"
_register(
    "workload",
    prf.workload,
    f"""SELECT 8 AS workers_assumed, round(sum(seconds) / 60, 1) AS estimate_serial_minutes, round(sum(seconds) / 8 / 60, 1) AS estimate_parallel_minutes,
      CAST(sum(CASE WHEN format_group IN ('Изображения', 'Видео') THEN files ELSE 0 END) AS BIGINT) AS ocr_intensive_files FROM {_SECONDS}""",
)
_register(
    "workload_by_group",
    prf.workload_by_group,
    f"SELECT format_group, round(seconds, 1) AS seconds FROM {_SECONDS}",
)
_register(
    "biggest", prf.biggest, f"SELECT round(size / {_MB}, 2) AS size_mb, rel FROM f ORDER BY size DESC, rel LIMIT 25"
)
_register(
    "oldest", prf.oldest, "SELECT strftime(mtime, '%Y-%m-%d %H:%M') AS date, rel FROM f ORDER BY mtime, rel LIMIT 5"
)
_register(
    "newest", prf.newest, "SELECT strftime(mtime, '%Y-%m-%d %H:%M') AS date, rel FROM f ORDER BY mtime DESC, rel LIMIT 5"
)
_register(
    "quick_totals", prf.quick_totals, f"SELECT count(*) AS total_files, round(sum(size) / {_MB}, 1) AS total_mb FROM f"
)
_register(
    "quick_extensions",
    prf.quick_extensions,
    f"SELECT ext, count(*) AS files, round(sum(size) / {_MB}, 2) AS size_mb FROM f GROUP BY ext",
)
_register(
    "quick_biggest",
    prf.quick_biggest,
    f"SELECT round(size / {_MB}, 2) AS size_mb, path FROM f ORDER BY size DESC, path DESC LIMIT 20",
)

# Column names: every word of the letters and documents is taken for one.
_NAMES = f"""SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё_/]+')) AS name
  FROM (SELECT text FROM ({corpus.letters_sql()}) UNION ALL SELECT text FROM documents)"""


def _names(spark, sf_dir):
    texts = corpus.letters(spark, sf_dir).select("text").unionByName(corpus.documents(spark, sf_dir).select("text"))
    words = F.regexp_extract_all("text", F.lit("[A-Za-zА-Яа-яЁё_/]+"), F.lit(0))
    return texts.select(F.explode(words).alias("name")).distinct()


def _rules_sql(rules: dict[str, str]) -> str:
    cases = " ".join(f"WHEN regexp_matches(name, '(?i){pattern}') THEN '{label}'" for label, pattern in rules.items())
    return f"SELECT name, CASE {cases} END AS category FROM ({_NAMES})"


@query("column_category", _rules_sql(patterns.COLUMN_CATEGORY))
def column_category(spark, sf_dir):
    from veilscan.sources.tables import column_category as category

    return _names(spark, sf_dir).select("name", category(F.col("name")).alias("category"))


@query(
    "prf_column_hits",
    f"""SELECT 'corpus' AS path, name AS "column", category FROM ({_rules_sql(patterns.PROFILE_COLUMN)}) WHERE category IS NOT NULL""",
)
def column_hits(spark, sf_dir):
    named = _names(spark, sf_dir).select(F.lit("corpus").alias("path"), F.col("name").alias("column"))
    return prf.column_hits(named)
