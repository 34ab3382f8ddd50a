"""Facts about files that follow from their names."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: label of files without an extension.
NO_EXTENSION = "(без расш.)"
# Fixed value: media type of unknown files.
OCTET_STREAM = "application/octet-stream"

# Which reader family an extension belongs to.
KIND_OF_EXTENSION = {
    "text": (".txt", ".md", ".log"),
    "html": (".html", ".htm", ".xhtml"),
    "pdf": (".pdf",),
    "docx": (".docx",),
    "doc": (".doc",),
    "rtf": (".rtf",),
    "xlsx": (".xlsx",),
    "xls": (".xls",),
    "csv": (".csv", ".tsv"),
    "json": (".json", ".jsonl", ".ndjson"),
    "parquet": (".parquet",),
    "image": (".tif", ".tiff", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp"),
    "video": (".mp4", ".mov", ".avi", ".mkv"),
}

# Names and extensions the listing leaves out.
IGNORED_NAMES = (".DS_Store", "Thumbs.db", ".git", ".venv", "__pycache__", "lost+found")
IGNORED_EXTENSIONS = (
    ".pyc", ".pyo", ".class", ".o", ".a", ".so", ".dll", ".dylib",
    ".exe", ".bin", ".lock", ".tmp", ".swp", ".bak",
)
# Names the dataset profile leaves out.
PROFILE_IGNORED_NAMES = (".DS_Store", "Thumbs.db", "__pycache__", ".idea", ".vscode")

# Format groups of the profile.
FORMAT_GROUPS = {
    "Документы": (".pdf", ".doc", ".docx", ".rtf", ".odt"),
    "Таблицы": (".xls", ".xlsx", ".ods", ".csv", ".tsv"),
    "Структурированные": (".json", ".jsonl", ".ndjson", ".parquet", ".xml", ".yaml", ".yml"),
    "Веб": (".html", ".htm", ".mhtml"),
    "Изображения": (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".gif", ".bmp", ".webp"),
    "Видео": (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".webm"),
    "Аудио": (".mp3", ".wav", ".flac", ".ogg", ".m4a"),
    "Архивы": (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2"),
    "Текстовые": (".txt", ".md", ".log"),
    "Код": (".py", ".js", ".ts", ".sql", ".sh"),
}
OTHER_GROUP = "Прочее"

# What the first bytes of a web page look like, and which kinds are checked for it.
HTML_STARTS = ("<!doc", "<html", "<?xml", "<!--", "<head")
SNIFFED_KINDS = ("pdf", "doc", "docx", "rtf")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot, in lower case; empty when the name has none."""
    return F.lower(_last_extension(base_name(path)))


def extension_label(path: Column) -> Column:
    ext = suffix(path)
    return F.when(ext == "", F.lit(NO_EXTENSION)).otherwise(ext)


def _label_of(ext: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for label, extensions in table.items():
        out = F.when(ext.isin(list(extensions)), F.lit(label)).otherwise(out)
    return out


def format_group(ext: Column) -> Column:
    return F.coalesce(_label_of(ext, FORMAT_GROUPS), F.lit(OTHER_GROUP))


def guess_kind(ext: Column, mime: Column) -> Column:
    """Reader family by extension, else by media type; null when the file is not supported."""
    by_mime = (
        F.when(mime.startswith("text/html"), F.lit("html"))
        .when(mime.startswith("text/csv"), F.lit("csv"))
        .when(mime.startswith("text/"), F.lit("text"))
        .when(mime == "application/pdf", F.lit("pdf"))
        .when(mime == "application/json", F.lit("json"))
        .when(mime.startswith("image/"), F.lit("image"))
        .when(mime.startswith("video/"), F.lit("video"))
    )
    return F.coalesce(_label_of(ext, KIND_OF_EXTENSION), by_mime)


def extensions_of(*kinds: str) -> list[str]:
    """All extensions of some reader families: the fixed ones, and those whose media type belongs to one."""
    fixed = {e: kind for kind, extensions in KIND_OF_EXTENSION.items() for e in extensions}
    by_type = {"text/html": "html", "text/csv": "csv", "application/pdf": "pdf", "application/json": "json"}
    by_family = {"text": "text", "image": "image", "video": "video"}
    for ext, mime in mimetypes.MimeTypes().types_map[True].items():
        fixed.setdefault(ext, by_type.get(mime) or by_family.get(mime.split("/")[0], ""))
    return sorted(e for e, kind in fixed.items() if kind in kinds)


def sniffed_kind(kind: Column, content: Column) -> Column:
    """Files declared as documents that begin like a web page are web pages."""
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), r"^[ \t\n\r\f\x0b]+", ""))
    looks_html = F.lit(False)
    for start in HTML_STARTS:
        looks_html = looks_html | head.startswith(start)
    return F.when(kind.isin(list(SNIFFED_KINDS)) & looks_html, F.lit("html")).otherwise(kind)


def _last_extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)


def mime_table(spark: SparkSession) -> DataFrame:
    """Media type per extension, from Python's own defaults: a table of fixed, small size."""
    known = mimetypes.MimeTypes()
    return spark.createDataFrame(sorted(known.types_map[True].items()), "mime_ext string, mime_type string")


def with_mime(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``mime``; an encoding suffix like ``.gz`` is looked through."""
    known = mimetypes.MimeTypes()
    name = F.lower(base_name(F.col(path)))
    last = _last_extension(name)
    # short forms such as .tgz stand for two extensions
    long_form = F.lit(None).cast("string")
    for short, long in known.suffix_map.items():
        long_form = F.when(F.col("last_ext") == short, F.lit(long)).otherwise(long_form)
    encodings = [e.lower() for e in known.encodings_map]
    stem = F.regexp_replace("opened_name", r"(?s)\.[^.]+\z", "")
    opened = files.withColumn("last_ext", last).withColumn(
        "opened_name",
        F.concat(F.regexp_replace(name, r"(?s)\.[^.]+\z", ""), F.coalesce(long_form, F.col("last_ext"))),
    )
    key = F.when(_last_extension(F.col("opened_name")).isin(encodings), _last_extension(stem)).otherwise(
        _last_extension(F.col("opened_name"))
    )
    keyed = opened.withColumn("mime_ext", key).drop("last_ext", "opened_name")
    return (
        keyed.join(F.broadcast(mime_table(files.sparkSession)), "mime_ext", "left")
        .withColumn("mime", F.coalesce("mime_type", F.lit(OCTET_STREAM)))
        .drop("mime_ext", "mime_type")
    )
