import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilscan.functions.html import html_text
from veilscan.operators import dedup
from veilscan.operators import profile as prf
from veilscan.plans import scan
from veilscan.plans.scan import scan_tree, tree_chunks, ScanOptions
from veilscan.session import shared_dir
from veilscan.sources import sinks, tables as tab
from veilscan.sources.files import list_files
from veilscan.sources.parquet import mixed_parquet_chunks, parquet_footers, parquet_schemas
from veilscan.streaming.stream import scanned_so_far, start_scan, stream_files
from veilscan.operators.findings import findings


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("share")
    (root / "sub dir+x").mkdir()
    (root / "lost+found").mkdir()
    (root / "a.txt").write_text("ФИО: Иванов Иван Иванович, почта a@b.ru", encoding="utf-8")
    (root / "copy.txt").write_text("ФИО: Иванов Иван Иванович, почта a@b.ru", encoding="utf-8")
    (root / "old.txt").write_bytes("Диагноз: здоров".encode("cp1251"))
    (root / "empty.txt").write_bytes(b"")
    (root / "page.pdf").write_text("\n <!DOCTYPE html><body><p>тел. +7 910 245-63-18</p></body>", encoding="utf-8")
    (root / "real.pdf").write_bytes(b"%PDF-1.4 ...")
    (root / "sub dir+x" / "t.csv").write_text('id;email;"full_name"\n1;x@y.ru;"Петрова ""А"" Анна"\n2;;\n3;1;2;3\n', encoding="utf-8")
    (root / "sub dir+x" / "t.tsv").write_text("phone\tnote\n89102456318\tok\n", encoding="utf-8")
    (root / "d.json").write_text(json.dumps({"a": {"b": [1, None, "", True]}, "mail": "q@w.ru"}), encoding="utf-8")
    (root / "bad.json").write_text('{"mail": q@w.ru', encoding="utf-8")
    (root / "l.jsonl").write_text('{"e": "l1@w.ru"}\nbroken\n\n{"e": "l2@w.ru"}\n', encoding="utf-8")
    (root / "bom.csv").write_bytes("\ufeffemail;n\r\nb@m.ru;1\r\n".encode())
    (root / "one.csv").write_text("ivan.petrov@mail.ru;+7 910 123-45-67", encoding="utf-8")
    (root / "notes.txt.gz").write_bytes(b"\x1f\x8b")
    (root / "pic.png").write_bytes(b"\x89PNG")
    (root / "lost+found" / "l.jsonl").write_text('{"e": "hidden@w.ru"}')
    pq.write_table(pa.table({"Email": ["p@q.ru", None], "ok": [True, False]}), root / "t.parquet")
    (root / "x.bin").write_bytes(b"1")
    (root / "noext").write_bytes(b"1")
    (root / "lost+found" / "z.txt").write_text("z@z.ru")
    return str(root)


def test_listing(spark, tree):
    rows = {r["rel"]: (r["ext"], r["kind"], r["mime"], r["error"]) for r in list_files(spark, tree).collect()}
    assert rows["sub dir+x/t.csv"] == (".csv", "csv", "text/csv", None)
    assert rows["noext"] == ("", None, "application/octet-stream", "unsupported_format")
    assert rows["l.jsonl"][1] == "json" and rows["t.parquet"][1] == "parquet"
    assert "x.bin" not in rows and "lost+found/z.txt" not in rows
    assert "`content`" not in list_files(spark, tree)._jdf.queryExecution().executedPlan().toString()


def _pdf_decoder():
    def decode(content):
        yield "mail in@pdf.ru", "page=1"
        raise ValueError("bad page")

    return decode


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 10])
def test_chunks_of_all_formats(spark, tree, limit):
    """With a low limit the same files go through the splittable readers, with the same result."""
    options = ScanOptions(whole_file_bytes=limit, decoders={"pdf": _pdf_decoder()} if limit > 10 else {})
    rows = tree_chunks(spark, tree, options).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: r["chunk_no"]):
        texts.setdefault(r["path"].split("/share")[-1].split("/", 1)[-1], []).append(r["text"])
    assert texts["a.txt"] == ["ФИО: Иванов Иван Иванович, почта a@b.ru"]
    table = ["id email full_name", 'id=1; [[PII_DIRECT:email:x@y.ru]]; [[PII_DIRECT:fio:Петрова "А" Анна]]', "id=2"]
    tabs = ["phone note", "[[PII_DIRECT:phone:89102456318]]; note=ok"]
    assert texts["l.jsonl"] == ["e=l1@w.ru\ne=l2@w.ru"]
    assert texts["t.parquet"] == ["Email ok", "Email=p@q.ru; ok=True", "ok=False"]
    assert texts["sub dir+x/t.csv"] == ["\n".join(table)] and texts["sub dir+x/t.tsv"] == ["\n".join(tabs)]
    assert texts["bom.csv"] == ["email n\n[[PII_DIRECT:email:b@m.ru]]; n=1"]
    assert texts["one.csv"] == ["ivan.petrov@mail.ru +7 910 123-45-67"]
    assert texts["old.txt"] == ["Диагноз: здоров"]
    if limit > 10:
        assert texts["page.pdf"] == ["тел. +7 910 245-63-18"]
        assert texts["d.json"] == ["a.b[0]=1\na.b[3]=True\nmail=q@w.ru"]
        assert texts["bad.json"] == ['{"mail": q@w.ru']
        assert texts["real.pdf"] == ["mail in@pdf.ru", None]
        assert [r["error"] for r in rows if r["path"].endswith("real.pdf") and r["error"]] == ["extract_error: bad page"]


def test_scan_and_sinks(spark, tree, tmp_path):
    found, reports = scan_tree(spark, tree, shared_dir(spark), decoders={"pdf": _pdf_decoder()})
    by_name = {r["path"].rsplit("/", 1)[-1]: r for r in reports.collect()}
    assert by_name["a.txt"]["category_counts"] == {"email": 1, "fio": 1}
    assert "copy.txt" not in by_name
    assert by_name["old.txt"]["protection_level"] == "УЗ-1"
    assert by_name["t.csv"]["category_counts"] == {"email": 2, "fio": 1} and by_name["t.csv"]["rows_processed"] == 2
    assert by_name["real.pdf"]["error"] == "extract_error: bad page" and by_name["real.pdf"]["category_counts"] == {"email": 1}
    assert by_name["noext"]["error"] == "unsupported_format"
    assert by_name["pic.png"]["error"] == "no_reader_for_format" and by_name["notes.txt.gz"]["error"] == "compressed_file"
    assert by_name["one.csv"]["category_counts"] == {"email": 1, "phone": 1}
    assert by_name["bom.csv"]["category_counts"] == {"email": 2}
    assert by_name["page.pdf"]["kind"] == "html" and by_name["page.pdf"]["error"] is None
    assert by_name["page.pdf"]["category_counts"] == {"phone": 1}
    out = str(tmp_path / "out")
    sinks.write_report_json(reports, found, out)
    again = sinks.read_reports(spark, out)
    assert sorted(map(str, again.select("path", "category_counts").collect())) == sorted(
        map(str, reports.select("path", "category_counts").collect())
    )
    sinks.write_report_csv(again, f"{out}/report")
    sinks.write_result_csv(again, f"{out}/result")
    assert spark.read.option("header", "true").csv(f"{out}/report").count() == reports.count()
    assert spark.read.option("header", "true").csv(f"{out}/result").columns == ["size", "time", "name"]


def test_large_and_ignored_files(spark, tree):
    """What is too large to be read whole has an error; nothing below ignored names is found."""
    found, reports = scan_tree(spark, tree, shared_dir(spark), whole_file_bytes=30, drop_duplicates=False)
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in reports.collect()}
    assert errors["d.json"] == "too_large_to_read_whole" and errors["page.pdf"] == "no_reader_for_format"
    assert errors["a.txt"] is None and errors["l.jsonl"] is None
    assert found.filter(F.col("path").contains("lost+found")).count() == 0


def test_findings_do_not_depend_on_the_limit(spark, tree, monkeypatch):
    """Copies go and the same is found when nothing is read whole; also when copies are too many to be broadcast."""

    def found(limit):
        rows, reports = scan_tree(spark, tree, shared_dir(spark), whole_file_bytes=limit)
        kinds = {r.path: r.kind for r in reports.collect()}
        got = sorted(tuple(r) for r in rows.collect() if kinds[r.path] in ("text", "csv", "parquet"))
        return got, sorted(p for p, k in kinds.items() if k in ("text", "csv", "parquet"))

    whole = found(64 * 1024 * 1024)
    assert len(whole[0]) > 8 and not any(p.endswith("copy.txt") for p in whole[1])
    monkeypatch.setattr(scan, "BROADCAST_COPIES", 0)
    assert found(0) == whole


def test_files_that_spark_does_not_list(spark, tmp_path):
    """A caller's listing brings hidden and empty files into the reports."""
    for name, text in ((".env", "mail=a@b.ru"), ("_draft.txt", "x"), ("empty.txt", ""), ("seen.txt", "a@b.ru")):
        (tmp_path / name).write_text(text)
    listing = spark.createDataFrame([(f"file:{p}", p.stat().st_size) for p in tmp_path.iterdir()], "path string, size long").withColumn("mtime", F.current_timestamp())
    _, reports = scan_tree(spark, str(tmp_path), shared_dir(spark), listing=listing)
    got = {r.path.rsplit("/", 1)[-1]: (r.error, r.size) for r in reports.collect()}
    assert got == {".env": ("unsupported_format", 11), "_draft.txt": ("hidden_file", 1), "empty.txt": (None, 0), "seen.txt": (None, 6)}


def test_stream_takes_old_files(spark, tmp_path):
    import os

    def run():
        files = stream_files(spark, str(tmp_path), (".txt",))
        return files.select("path", F.lit(0).cast("bigint").alias("chunk_no"), F.col("content").cast("string").alias("text"), F.lit("full").alias("locator"))

    out = shared_dir(spark)
    (tmp_path / "new.txt").write_text("anna@b.ru")
    start_scan(run(), f"{out}/spans", f"{out}/cp").awaitTermination()
    (tmp_path / "old.txt").write_text("c@d.ru")
    os.utime(tmp_path / "old.txt", (1_000_000_000, 1_000_000_000))
    start_scan(run(), f"{out}/spans", f"{out}/cp").awaitTermination()
    assert findings(scanned_so_far(spark, f"{out}/spans")).count() == 2
    # a copy is not searched, however late it comes, and no value is written as it is
    (tmp_path / "late.txt").write_text("anna@b.ru")
    start_scan(run(), f"{out}/spans", f"{out}/cp").awaitTermination()
    assert sorted(r["occurrences"] for r in findings(scanned_so_far(spark, f"{out}/spans")).collect()) == [1, 1]
    stored = spark.read.parquet(f"{out}/spans")
    assert "value" not in stored.columns and not any("anna@b.ru" in str(r) for r in stored.collect())


def test_stream_equals_batch(spark, tree):
    out = shared_dir(spark)
    files = stream_files(spark, tree, (".txt",))
    chunks = files.select(
        "path", F.lit(0).cast("bigint").alias("chunk_no"), F.col("content").cast("string").alias("text"), F.lit("full").alias("locator")
    )
    start_scan(chunks, f"{out}/spans", f"{out}/cp").awaitTermination()
    # a second run finds nothing new
    start_scan(chunks, f"{out}/spans", f"{out}/cp").awaitTermination()
    streamed = findings(scanned_so_far(spark, f"{out}/spans")).select("category", "value_hash", "occurrences").collect()
    assert sorted((r["category"], r["occurrences"]) for r in streamed) == [("email", 1), ("fio", 1)]


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 0])
def test_parquet_files_of_different_schemas(spark, tmp_path, limit):
    tables = {
        "a": pa.table({"Id": [1, 2], "mail": ["a@b.ru", None]}),
        "b [1]": pa.table({"Id": ["x"], "extra": [True]}),
        "c": pa.table({"Id": [3], "mail": ["c@d.ru"]}),
        "d": pa.table({"Id": [3], "id": ["twice"]}),
    }
    for name, table in tables.items():
        pq.write_table(table, tmp_path / f"{name}.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 nothing PAR1")
    footers = parquet_footers(spark, str(tmp_path), limit)
    rows = mixed_parquet_chunks(spark, footers).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.chunk_no):
        got.setdefault(r.path.rsplit("/", 1)[-1].removesuffix(".parquet"), []).append(r.text or r.error.split(":")[0])
    assert got.pop("broken") == got.pop("d") == ["unhandled"]
    assert got == {"a": ["Id mail", "Id=1; mail=a@b.ru", "Id=2"], "b [1]": ["Id extra", "Id=x; extra=True"], "c": ["Id mail", "Id=3; mail=c@d.ru"]}
    columns = [(r.column_no, r.column) for r in parquet_schemas(footers, 2).orderBy("path", "column_no").collect()]
    assert columns == [(0, "Id"), (1, "mail"), (0, "Id"), (1, "extra")]
    if not limit:
        return
    found, reports = scan_tree(spark, str(tmp_path), shared_dir(spark), whole_file_bytes=limit)
    errors = {r.path.rsplit("/", 1)[-1]: (r.error or "").split(":")[0] for r in reports.collect()}
    assert errors["broken.parquet"] == errors["d.parquet"] == "unhandled" and errors["a.parquet"] == ""
    assert found.count() == 2


def test_schemas_of_long_headers_and_documents(spark):
    names = [f"column_{k}_{'x' * 40}" for k in range(3000)]
    document = '{"first": "' + "y" * 3_000_000 + '", "second": {"a": [1]}, "third": null}'
    listed = '[{"inner": "' + "z" * 100_000 + '", "last": 1}, {"other": 2}]'
    line = '{"one": "' + "w" * 100_000 + '", "two": 2}\n{"later": 1}\n'
    rows = [("/a.csv", ";".join(names) + "\n1;2\n"), ("/b.json", document), ("/c.json", listed), ("/d.jsonl", line), ("/e.json", document[:-1])]
    files = spark.createDataFrame([(p, len(t), bytearray(t.encode())) for p, t in rows], "path string, size long, content binary")
    got = tab.csv_schemas(files).orderBy("column_no").collect()
    assert [r.column for r in got] == names and {r.delimiter for r in got} == {";"}
    keys = sorted((r.path, r.key_no, r.key) for r in tab.json_schemas(files).where("key_no IS NOT NULL").collect())
    assert keys == [
        ("/b.json", 0, "first"), ("/b.json", 1, "second"), ("/b.json", 2, "third"),
        ("/c.json", 0, "inner"), ("/c.json", 1, "last"), ("/d.jsonl", 0, "one"), ("/d.jsonl", 1, "two"),
    ]


def test_html(spark):
    pages = {
        "<p>a</p><p>b &amp;lt; c</p>": "a b &lt; c",
        "<html><head><title>t</title></head><body><script>x<1</script>one<!-- no --><b>two</b></body></html>": "one two",
        "A&#1071;&#x42F;&unknown; &copy": "AЯЯ&unknown; &copy",
        "x<style>p{}</style><noscript>n</noscript>y": "x y",
        "1 < 2": "1 < 2",
        '<img alt="a>secret text">hello <a title="open>rest</a>': "hello  rest",
        "shown<script>var x = 1": "shown",
    }
    rows = spark.createDataFrame([(k,) for k in pages], "h string").select("h", html_text(F.col("h")).alias("t")).collect()
    assert {r["h"]: r["t"] for r in rows} == pages


def test_hot_duplicates_and_profile(spark):
    """A third of all files share one content; nothing is lost."""
    files = spark.range(3000).select(
        F.concat(F.lit("/r/d"), (F.col("id") % 7).cast("string"), F.lit("/f"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(".txt")).alias("path"),
        (F.col("id") % 11 * 1000).alias("size"),
        F.lit("2020-01-01").cast("timestamp").alias("mtime"),
        F.sha2(F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")), 256).alias("content_hash"),
    )
    assert dedup.keep_first(files).count() == 2001
    copies = dedup.duplicate_map(files)
    assert copies.count() == 999 and copies.select("duplicate_of").distinct().count() == 1
    assert [r["path_no"] for r in dedup.largest_groups(files).orderBy("path_no").collect()] == [1, 2, 3, 4, 5]
    facts = prf.file_facts(files, "/r")
    sizes = sorted(i % 11 * 1000 for i in range(3000))
    row = prf.overview(facts).first()
    assert row["median_size_kb"] == round((sizes[1499] + sizes[1500]) / 2 / 1024, 2)
    assert row["p95_size_kb"] == round(sizes[2850] / 1024, 2)
    assert row["empty_files"] == sizes.count(0)
