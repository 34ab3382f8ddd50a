"""Sources over the given tables and over file contents derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilscan.catalog import corpus, query
from veilscan.functions.files import guess_kind, sniffed_kind, suffix, with_mime
from veilscan.functions.html import html_text
from veilscan.operators.findings import first_chunks
from veilscan.session import spread
from veilscan.sources import documents as docs
from veilscan.sources import files as src
from veilscan.sources import json as js
from veilscan.sources import json_lines as jsl
from veilscan.sources import tables as tab

_GAP = "﷐"
_MARKUP = (
    r"(?s)<!--.*?-->",
    r"(?is)<script(?:\s[^>]*)?>.*?(?:</script\s*>|\z)",
    r"(?is)<style(?:\s[^>]*)?>.*?(?:</style\s*>|\z)",
    r"(?is)<noscript(?:\s[^>]*)?>.*?(?:</noscript\s*>|\z)",
)


def _html_sql(column: str) -> str:
    out = column
    for pattern in _MARKUP:
        out = f"regexp_replace({out}, '{pattern}', '{_GAP}', 'g')"
    out = rf"regexp_replace({out}, '(?is)^.*?<body(?:\s[^>]*)?>', '')"
    out = rf"regexp_replace({out}, '(?is)</body\s*>.*$', '')"
    quoted = r"""<[a-zA-Z/!?](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
    out = f"regexp_replace({out}, '{quoted}', '{_GAP}', 'g')"
    out = f"regexp_replace({out}, '<[a-zA-Z/!?][^>]*>', '{_GAP}', 'g')"
    out = f"regexp_replace({out}, '^{_GAP}+|{_GAP}+$', '', 'g')"
    out = f"regexp_replace({out}, '{_GAP}+', ' ', 'g')"
    return f"html_unescape({out})"


_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _unescaped_sql(column: str) -> str:
    out = column
    for name, char in _REFERENCES:
        out = f"replace({out}, '{name}', '{char}')"
    return out


_PAGE_TEXT = _unescaped_sql(_html_sql("html").removeprefix("html_unescape(")[:-1])


@query("src_html_text", f"SELECT page_id, {_PAGE_TEXT} AS text FROM pages")
def src_html_text(spark, sf_dir):
    return spread(corpus.table(spark, sf_dir, "pages")).select("page_id", html_text(F.col("html")).alias("text"))


def _page_files(spark, sf_dir):
    """Pages as files, some of them under the name of another format."""
    ext = F.when(F.col("page_id") % 4 == 0, F.lit(".pdf")).when(F.col("page_id") % 4 == 1, F.lit(".doc")).otherwise(F.lit(".html"))
    pages = corpus.table(spark, sf_dir, "pages")
    body = F.when(F.col("page_id") % 8 == 0, F.concat(F.lit("%PDF-1.4 "), "html")).otherwise(F.concat(F.lit("\n  "), "html"))
    return pages.select(
        F.concat(F.lit("/web/"), F.col("page_id").cast("string"), ext).alias("path"),
        F.octet_length(body).cast("bigint").alias("size"),
        body.cast("binary").alias("content"),
        guess_kind(ext, F.lit(None).cast("string")).alias("kind"),
    )


_PAGE_FILES = """SELECT '/web/' || CAST(page_id AS STRING) || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.doc' ELSE '.html' END AS path,
  CASE WHEN page_id % 8 = 0 THEN 'pdf' ELSE 'html' END AS kind, html FROM pages"""


@query("src_sniff", f"SELECT path, kind FROM ({_PAGE_FILES})")
def src_sniff(spark, sf_dir):
    return _page_files(spark, sf_dir).select("path", sniffed_kind(F.col("kind"), F.col("content")).alias("kind"))


@query("src_html_chunks", f"SELECT path, 0 AS chunk_no, {_PAGE_TEXT} AS text, 'html' AS locator FROM ({_PAGE_FILES}) WHERE kind = 'html'")
def src_html_chunks(spark, sf_dir):
    chunks = docs.html_chunks(src.with_actual_kind(_page_files(spark, sf_dir)))
    # the blanks before the page are text outside of its body
    return chunks


@query(
    "src_text_decode",
    f"SELECT path, chunk_no, text FROM ({corpus.letters_sql()})",
)
def src_text_decode(spark, sf_dir):
    """Half of the letters as UTF-8 bytes, half in the Cyrillic Windows code page; both read alike."""
    letters = corpus.letters(spark, sf_dir)
    one_byte = F.encode(F.translate("text", docs._AS_CYRILLIC, docs._AS_LATIN), "ISO-8859-1")
    stored = F.when(F.col("chunk_no") % 2 == 0, F.col("text").cast("binary")).otherwise(one_byte)
    return letters.select("path", "chunk_no", docs.decode_text(stored).alias("text"))


_MIME = {
    ".pdf": "application/pdf",
    ".csv": "text/csv",
    ".json": "application/json",
    ".html": "text/html",
    ".htm": "text/html",
    ".jpg": "image/jpeg",
    ".mp4": "video/mp4",
    ".txt": "text/plain",
    ".tif": "image/tiff",
    ".zip": "application/zip",
    ".py": "text/x-python",
    ".tar.gz": "application/x-tar",
}
_KIND = {
    "pdf": ("pdf",), "docx": ("docx",), "csv": ("csv",), "json": ("json", "jsonl"), "html": ("html", "htm"), "image": ("jpg", "tif"),
    "video": ("mp4",), "text": ("txt", "log", "py"), "xlsx": ("xlsx",), "parquet": ("parquet",),
}
_MIME_SQL = "CASE " + " ".join(f"WHEN lower(path) LIKE '%_{e}' THEN '{m}'" for e, m in _MIME.items()) + " ELSE 'application/octet-stream' END"
_KIND_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(path), '[^/]\\.({'|'.join(e)})$') THEN '{k}'" for k, e in _KIND.items()
) + " END"


@query("src_guess_kind", f"SELECT path, {_MIME_SQL} AS mime, {_KIND_SQL} AS kind FROM ({corpus.files_sql()})")
def src_guess_kind(spark, sf_dir):
    files = with_mime(corpus.files(spark, sf_dir).select("path"))
    return files.select("path", "mime", guess_kind(suffix(F.col("path")), F.col("mime")).alias("kind"))


_LISTED = """SELECT CASE doc_id % 9 WHEN 0 THEN 'a/.git/' WHEN 1 THEN '__pycache__/' WHEN 2 THEN 'lost+found/b/' ELSE 'docs/' END || source || '/'
  || CASE doc_id % 7 WHEN 0 THEN 'Thumbs.db' WHEN 1 THEN 'lib.so' WHEN 2 THEN 'Old.BAK' ELSE CAST(doc_id AS STRING) || '.txt' END AS rel FROM documents"""


@query(
    "src_ignored",
    f"""SELECT rel FROM ({_LISTED}) WHERE NOT regexp_matches(rel, '(^|/)(\\.git|__pycache__|lost\\+found|Thumbs\\.db)(/|$)')
      AND NOT regexp_matches(lower(rel), '\\.(so|bak)$')""",
)
def src_ignored(spark, sf_dir):
    return corpus._run(spark, sf_dir, _LISTED, "documents").filter(src.not_ignored(F.col("rel")))


_PERSON = """'fio=' AS unused, CAST(c_custkey AS STRING) AS id, c_name AS full_name, c_mktsegment AS segment,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'user' || CAST(c_custkey AS STRING) || '@mail.ru' END AS email, c_nationkey AS nation, c_custkey % 2 = 0 AS active"""
_ROW_SQL = """'id=' || c_custkey || '; [[PII_DIRECT:fio:' || c_name || ']]; segment=' || c_mktsegment
  || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '; [[PII_DIRECT:email:user' || c_custkey || '@mail.ru]]' END
  || '; nation=' || c_nationkey || '; active=' || CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END"""
_COLUMNS = ["id", "full_name", "segment", "email", "nation", "active"]


def _people(spark, sf_dir):
    return corpus._run(spark, sf_dir, f"SELECT c_custkey, {_PERSON} FROM customer", "customer")


@query(
    "src_structured_rows",
    f"SELECT '/db/people' AS path, c_custkey + 1 AS chunk_no, {_ROW_SQL} AS text, 'row=' || c_custkey || ':rows=1' AS locator FROM customer",
)
def src_structured_rows(spark, sf_dir):
    return tab.table_chunks(_people(spark, sf_dir), F.lit("/db/people"), F.col("c_custkey"), _COLUMNS)


@query(
    "src_parquet_sample",
    """SELECT c_custkey + 1 AS chunk_no, 'c_custkey=' || c_custkey || '; c_name=' || c_name || '; c_nationkey=' || c_nationkey || '; c_acctbal=' || c_acctbal
      || '; c_mktsegment=' || c_mktsegment AS text FROM customer WHERE c_custkey < 1000
    UNION ALL SELECT 0, 'c_custkey c_name c_nationkey c_acctbal c_mktsegment'""",
)
def src_parquet_sample(spark, sf_dir):
    chunks = tab.parquet_chunks(spark, f"{sf_dir}/customer.parquet", full=False)
    return chunks.select("chunk_no", "text")


@query(
    "src_parquet_rows",
    """SELECT s_suppkey + 1 AS chunk_no, 's_suppkey=' || s_suppkey || '; s_name=' || s_name || '; s_nationkey=' || s_nationkey || '; s_acctbal=' || s_acctbal AS text FROM supplier
    UNION ALL SELECT 0, 's_suppkey s_name s_nationkey s_acctbal'""",
)
def src_parquet_rows(spark, sf_dir):
    return tab.parquet_chunks(spark, f"{sf_dir}/supplier.parquet").select("chunk_no", "text")


# One delimited file per hundred customers: odd ones with commas, even ones with semicolons, some with tabs.
_FILE_NO = "CAST(floor(c_custkey / 100) AS BIGINT)"


def _joined(cells, sep):
    return F.call_function("array_join", cells, sep)


def _csv_files(spark, sf_dir):
    people = _people(spark, sf_dir).withColumn("file_no", F.floor(F.col("c_custkey") / 100))
    kind = F.col("file_no") % 3
    sep = F.when(kind == 0, F.lit(",")).when(kind == 1, F.lit(";")).otherwise(F.lit("\t"))
    quoted = F.concat(F.lit('"'), F.concat("full_name", sep, F.lit('""x""\nJr')), F.lit('"'))
    line = _joined(F.array("id", quoted, "segment", "email", F.lit("")), sep)
    bad = _joined(F.array(*[F.lit("x")] * 7), sep)
    body = F.when(F.col("c_custkey") % 50 == 7, F.concat(line, F.lit("\r\n"), bad)).otherwise(line)
    grouped = people.groupBy("file_no", kind.alias("kind_no"), sep.alias("sep")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", body.alias("line")))), lambda x: x["line"]).alias("body")
    )
    header = _joined(F.array(*[F.lit(c) for c in ("id", "full_name", "segment", "email", "note")]), F.col("sep"))
    text = F.concat(header, F.lit("\r\n"), F.array_join("body", "\r\n"), F.lit("\r\n"))
    ext = F.when(F.col("kind_no") == 2, F.lit(".tsv")).otherwise(F.lit(".csv"))
    return grouped.select(
        F.concat(F.lit("/csv/"), F.col("file_no").cast("string"), ext).alias("path"),
        F.lit("csv").alias("kind"),
        F.octet_length(text).cast("bigint").alias("size"),
        text.cast("binary").alias("content"),
    )


@query(
    "src_csv_chunks",
    f"""SELECT '/csv/' || file_no || CASE WHEN kind_no = 2 THEN '.tsv' ELSE '.csv' END AS path, 0 AS chunk_no,
      'id full_name segment email note' || chr(10) || string_agg(line, chr(10) ORDER BY c_custkey) AS text, 'chunk=0:rows=' || count(*) AS locator
    FROM (SELECT c_custkey, {_FILE_NO} AS file_no, {_FILE_NO} % 3 AS kind_no,
      'id=' || c_custkey || '; [[PII_DIRECT:fio:' || c_name || CASE {_FILE_NO} % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END || '"x"' || chr(10) || 'Jr]]; segment=' || c_mktsegment
        || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '; [[PII_DIRECT:email:user' || c_custkey || '@mail.ru]]' END AS line FROM customer)
    GROUP BY file_no, kind_no""",
)
def src_csv_chunks(spark, sf_dir):
    return tab.csv_chunks(_csv_files(spark, sf_dir))


@query("src_json_open", """SELECT event_id, 'k=' || (props::JSON ->> 'k') AS leaves FROM events""")
def src_json_open(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events")
    return events.select("event_id", F.array_join(js.flatten_json(F.col("props")), "\n").alias("leaves"))


@query("src_json_known", """SELECT event_id, 'k=' || (props::JSON ->> 'k') AS leaves FROM events""")
def src_json_known(spark, sf_dir):
    from pyspark.sql import types as T

    events = corpus.table(spark, sf_dir, "events")
    schema = T.StructType([T.StructField("k", T.LongType())])
    parsed = events.select("event_id", F.from_json("props", schema).alias("p"))
    return parsed.select("event_id", F.concat_ws("\n", *js.flatten_struct(schema, F.col("p"))).alias("leaves"))


# Nested documents, one in ten of them broken.
_NESTED = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN '{"broken": ' || CAST(o_orderkey AS STRING) ELSE
  '{"order": {"id": ' || CAST(o_orderkey AS STRING) || ', "tags": ["a", {"b": null}, "' || o_orderstatus || '"], "ok": true, "price": 2.50, "none": null, "empty": ""}, "list": [[1, 2], []], "прио": "'
  || o_orderpriority || '"}' END AS raw FROM orders"""


@query(
    "src_json_nested",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN concat_ws(chr(10), 'order.id=' || o_orderkey, 'order.tags[0]=a', 'order.tags[2]=' || o_orderstatus, 'order.ok=True', 'order.price=2.5',
      'list[0][0]=1', 'list[0][1]=2', 'прио=' || o_orderpriority) END AS leaves FROM orders""",
)
def src_json_nested(spark, sf_dir):
    rows = corpus._run(spark, sf_dir, _NESTED, "orders")
    return rows.select("o_orderkey", F.array_join(js.flatten_json(F.col("raw")), "\n").alias("leaves"))


@query(
    "src_json_chunks",
    """SELECT '/json/' || o_orderkey || '.json' AS path, 0 AS chunk_no, CASE WHEN o_orderkey % 10 <> 3 THEN concat_ws(chr(10), 'order.id=' || o_orderkey, 'order.tags[0]=a', 'order.tags[2]=' || o_orderstatus,
      'order.ok=True', 'order.price=2.5', 'list[0][0]=1', 'list[0][1]=2', 'прио=' || o_orderpriority) ELSE '{"broken": ' || o_orderkey END AS text,
      CASE WHEN o_orderkey % 10 <> 3 THEN 'json_root' ELSE 'raw_json' END AS locator FROM orders""",
)
def src_json_chunks(spark, sf_dir):
    rows = corpus._run(spark, sf_dir, _NESTED, "orders")
    files = rows.select(
        F.concat(F.lit("/json/"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("path"),
        F.lit("json").alias("kind"),
        F.octet_length("raw").cast("bigint").alias("size"),
        F.col("raw").cast("binary").alias("content"),
    )
    return js.json_chunks(files)


# Orders as JSON lines of 1 to 4 leaves, in files of 120 000 lines; one line in ten is broken, some are empty objects.
_LINES = """SELECT CAST(floor(o_orderkey / 120000) AS BIGINT) AS file_no, o_orderkey AS line_no,
  CASE WHEN o_orderkey % 10 = 3 THEN '{"broken": ' WHEN o_orderkey % 10 = 4 THEN '{}' ELSE '{"id": ' || CAST(o_orderkey AS STRING)
    || CASE WHEN o_orderkey % 10 < 3 THEN '' ELSE ', "at": {"status": "' || o_orderstatus || '", "list": [1, "x"]}' END || '}' END AS raw FROM orders"""
# The chunk of a line follows from all lines before it, which a recursive walk from chunk to chunk finds.
_LINE_LEAVES = """SELECT '/jsonl/' || file_no AS path, line_no, CASE WHEN line_no % 10 = 4 THEN 0 WHEN line_no % 10 < 3 THEN 1 ELSE 4 END AS n,
  CASE WHEN line_no % 10 <> 4 THEN 'id=' || line_no || CASE WHEN line_no % 10 < 3 THEN '' ELSE chr(10) || 'at.status=' || o_orderstatus || chr(10) || 'at.list[0]=1' || chr(10) || 'at.list[1]=x' END END AS text
  FROM (SELECT CAST(floor(o_orderkey / 120000) AS BIGINT) AS file_no, o_orderkey AS line_no, o_orderstatus FROM orders) WHERE line_no % 10 <> 3"""


@query(
    "src_json_line_batches",
    f"""WITH RECURSIVE leaves AS ({_LINE_LEAVES}),
    summed AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY line_no) AS upto FROM leaves),
    walk AS (SELECT path, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS HUGEINT) AS before, (SELECT min(upto) FROM summed s WHERE s.path = p.path AND s.upto >= 10000) AS until FROM (SELECT DISTINCT path FROM leaves) p
      UNION ALL SELECT path, chunk_no + 1, until, (SELECT min(upto) FROM summed s WHERE s.path = w.path AND s.upto >= w.until + 10000) FROM walk w WHERE until IS NOT NULL)
    SELECT s.path, chunk_no, md5(string_agg(text, chr(10) ORDER BY line_no)) AS digest, 'jsonl_batch' AS locator
    FROM summed s JOIN walk w ON s.path = w.path AND upto > before AND (until IS NULL OR upto <= until) WHERE n > 0 GROUP BY s.path, chunk_no""",
)
def src_json_line_batches(spark, sf_dir):
    """Several chunks to a file, the lines in parts of 4096."""
    rows = corpus._run(spark, sf_dir, _LINES, "orders").select(
        F.concat(F.lit("/jsonl/"), F.col("file_no").cast("string")).alias("path"), "line_no", js.flatten_json(F.col("raw")).alias("leaves")
    )
    return jsl.json_line_batches(rows, part_lines=4096).select("path", "chunk_no", F.md5("text").alias("digest"), "locator")


def _paragraphs(content: bytes):
    for i, part in enumerate(content.decode("utf-8").split("\n")):
        if part == "":
            raise ValueError("empty line")
        yield part, f"line={i}"


@query(
    "src_decoder_hook",
    """SELECT doc_id AS path, n - 1 AS chunk_no, CASE WHEN ls[n] <> '' THEN ls[n] END AS text, CASE WHEN ls[n] <> '' THEN 'line=' || (n - 1) ELSE '' END AS locator,
      CASE WHEN ls[n] = '' THEN 'extract_error: empty line' END AS error
    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS n, list_position(ls, '') AS stop FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
    WHERE stop IS NULL OR stop = 0 OR n <= stop""",
)
def src_decoder_hook(spark, sf_dir):
    """A decoder that reads lines and fails at the first empty one; what came before stays."""
    files = corpus.documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("path"), F.lit("lines").alias("kind"), F.col("text").cast("binary").alias("content")
    )
    chunks = src.decoded_chunks(files, {"lines": _paragraphs})
    return chunks.withColumn("path", F.col("path").cast("bigint"))


@query(
    "src_first_chunks",
    "SELECT conv_id AS path, turn AS chunk_no, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2",
)
def src_first_chunks(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    return first_chunks(turns.select(F.col("conv_id").alias("path"), F.col("turn").alias("chunk_no"), "text"), 2)


@query(
    "prf_csv_schemas",
    """SELECT path, no - 1 AS column_no, ['id', 'full_name', 'segment', 'email', 'note'][no] AS "column",
      CASE file_no % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter
    FROM (SELECT *, unnest(range(1, 6)) AS no FROM (SELECT '/csv/' || file_no || CASE WHEN file_no % 3 = 2 THEN '.tsv' ELSE '.csv' END AS path, file_no, size FROM (
      SELECT CAST(floor(c_custkey / 100) AS BIGINT) AS file_no,
        33 + 2 + sum(length(CAST(c_custkey AS STRING)) + length(c_name) + 1 + 8 + 2 + length(c_mktsegment)
          + CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 12 + length(CAST(c_custkey AS STRING)) + 1 END + 4 + CASE WHEN c_custkey % 50 = 7 THEN 15 ELSE 0 END + 2) AS size
      FROM customer GROUP BY ALL) ORDER BY size DESC, path LIMIT 25))""",
)
def prf_csv_schemas(spark, sf_dir):
    return tab.csv_schemas(_csv_files(spark, sf_dir)).select("path", "column_no", "column", "delimiter")


@query(
    "prf_json_schemas",
    """SELECT path, CASE WHEN bad THEN NULL ELSE no - 1 END AS key_no, CASE WHEN NOT bad THEN ['order', 'list', 'прио'][no] END AS key
    FROM (SELECT *, unnest(range(1, CASE WHEN bad THEN 2 ELSE 4 END)) AS no FROM (
      SELECT '/json/' || o_orderkey || '.json' AS path, o_orderkey % 10 = 3 AS bad, strlen(raw) AS size FROM (NESTED) ORDER BY size DESC, path LIMIT 15))""".replace(
        "NESTED", _NESTED
    ),
)
def prf_json_schemas(spark, sf_dir):
    rows = corpus._run(spark, sf_dir, _NESTED, "orders")
    files = rows.select(
        F.concat(F.lit("/json/"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("path"),
        F.octet_length("raw").cast("bigint").alias("size"),
        F.col("raw").cast("binary").alias("content"),
    )
    return tab.json_schemas(files).select("path", "key_no", "key")
