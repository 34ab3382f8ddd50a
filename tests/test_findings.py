import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilscan.functions.masking import mask_value, sha256_hex
from veilscan.functions.text import lower_yo_to_ye, normalize_text, rows_from_locator, strip_diacritics
from veilscan.operators import findings as fnd
from veilscan.operators import reports as rpt
from veilscan.operators.classify import is_confident, protection_level, recommendation
from veilscan.schema import LEVELS

MASKS = [
    ("phone", "+7 910 245-63-18", "+7 910 ***-**-18"),
    ("phone", "12345", "12*45"),
    ("email", "ivan@mail.ru", "i***@mail.ru"),
    ("email", "@mail.ru", "@mail.ru"),
    ("email", "nomail", "no**il"),
    ("bank_card", "4111 1111 1111 1111", "4111 **** **** 1111"),
    ("snils", "112-233-445 95", "112-***-*** 95"),
    ("snils", "1122", "****"),
    ("passport_rf", "52 17 № 118903", "52** ****03"),
    ("inn_personal", "500100732259", "50***59"),
    ("inn_legal", "7707083893", "77***93"),
    ("bank_account", "40702810900000000001", "40702***********0001"),
    ("bik", "044525225", "0445***25"),
    ("cvv", "123", "***"),
    ("mrz", "P<RUSIVANOV", "P<R***"),
    ("driver_license", "77 АВ 123456", "77** ****56"),
    ("fio", " Иванов  Иван Иванович ", "И. И. И."),
    ("address", "г. Москва, ул. Ленина", "г. Мос…"),
    ("birth_date", "01.02.1990", "**.**.****"),
    ("health", "диагноз", "ди***оз"),
    ("race", "abcd", "****"),
    ("race", "", ""),
]


def test_masks(spark):
    rows = spark.createDataFrame(MASKS, "category string, value string, expected string")
    got = rows.select("expected", mask_value(F.col("value"), F.col("category")).alias("m")).collect()
    assert [r["m"] for r in got] == [r["expected"] for r in got]
    row = rows.limit(1).select(
        mask_value(F.lit("abc"), F.lit("fio"), "full"),
        mask_value(F.lit("a" * 20), F.lit("fio"), "full"),
        mask_value(F.lit("abc"), F.lit("fio"), "hash_only"),
        sha256_hex(F.lit("abc")),
    ).first()
    assert row[0] == "***" and row[1] == "********"
    assert row[2] == "sha256:ba7816bf8f01" and row[3].startswith("ba7816bf8f01")
    with pytest.raises(ValueError):
        mask_value(F.lit("a"), F.lit("fio"), "none")


def test_text_functions(spark):
    row = spark.createDataFrame([("①ﬁ\r\nёЁé x", "chunk=1:rows=25000")], "t string, l string").select(
        normalize_text(F.col("t")), strip_diacritics(F.lit("é") if False else F.col("t")), lower_yo_to_ye(F.col("t")),
        rows_from_locator(F.col("l")), rows_from_locator(F.lit("full")),
    ).first()
    assert row[0] == "1fi\nёЁé\nx"
    assert row[1] == "1fi\r\nеЕe x"
    assert row[2].startswith("①ﬁ\r\nеЕ")
    assert (row[3], row[4]) == (25000, 0)


LEVEL_CASES = [
    ({}, 0, "Без ПДн"),
    ({"biometric": 1}, 0, "УЗ-1"),
    ({"health": 1, "fio": 5}, 0, "УЗ-1"),
    ({"bank_card": 1}, 0, "УЗ-2"),
    ({"snils": 15}, 0, "УЗ-2"),
    ({"passport_rf": 1, "fio": 1}, 0, "УЗ-3"),
    ({"fio": 100}, 0, "УЗ-3"),
    ({"fio": 1, "email": 1}, 0, "УЗ-4"),
    ({"inn_legal": 3, "ogrn": 1}, 0, "Без ПДн"),
    ({"snils": 1}, 50, "УЗ-2"),
    ({"fio": 5}, 40, "УЗ-3"),
    ({"fio": 5}, 60, "УЗ-4"),
]


def test_levels(spark):
    rows = spark.createDataFrame(LEVEL_CASES, "counts map<string,bigint>, n bigint, expected string")
    got = rows.select("expected", protection_level(F.col("counts"), F.col("n")).alias("level")).collect()
    assert [r["level"] for r in got] == [r["expected"] for r in got]
    one = spark.createDataFrame([({"snils": 60},)], "counts map<string,bigint>")
    limits = {"state_id_large_count": 1000, "state_id_large_ratio": 0.5}
    assert one.select(protection_level(F.col("counts"), F.lit(100), **limits)).first()[0] == "УЗ-2"
    texts = spark.createDataFrame([(x,) for x in (*LEVELS, "?")], "level string").select(recommendation(F.col("level"))).collect()
    assert all(r[0] for r in texts[:-1]) and texts[-1][0] == ""


CONFIDENT = [
    ({}, False),
    ({"snils": 1}, True),
    ({"inn_personal": 1}, True),
    ({"bik": 1}, True),
    ({"health": 1}, True),
    ({"fio": 20}, False),
    ({"address": 5}, False),
    ({"birth_place": 3}, False),
    ({"email": 2}, False),
    ({"email": 3}, True),
    ({"phone": 1}, False),
    ({"phone": 3}, True),
    ({"fio": 1, "phone": 1}, True),
    ({"email": 1, "address": 1}, True),
    ({"fio": 5, "ogrn": 1}, False),
]


def test_confident_files(spark):
    rows = spark.createDataFrame(CONFIDENT, "counts map<string,bigint>, expected boolean")
    got = rows.select("expected", is_confident(F.col("counts")).alias("c")).collect()
    assert [r["c"] for r in got] == [r["expected"] for r in got]


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "path string, chunk_no long, text string, locator string, error string")


def test_findings_and_reports(spark):
    chunks = _chunks(
        spark,
        [
            ("a", 0, "email: x@y.ru", "rows=7", None),
            ("a", 1, "x@y.ru и x@y.ru", "rows=5", None),
            ("a", 2, None, "", "extract_error: broken"),
            ("b", 0, "ничего", "full", None),
            ("c", 0, "ОГРН 1027700132195", "full", None),
        ],
    )
    scanned = fnd.scan_chunks(chunks)
    rows = fnd.findings(scanned).orderBy("path").collect()
    # three occurrences, one finding, and the confidence of the first one
    assert [(r["path"], r["category"], r["value_masked"], r["confidence"], r["occurrences"]) for r in rows] == [
        ("a", "email", "x@y.ru", 1.0, 3),
        ("c", "ogrn", "10*********95", 1.0, 1),
    ]
    files = spark.createDataFrame(
        [(p, 10, dt.datetime(2024, 9, 26, 18, 31), ".txt", "text/plain", "text", None) for p in "abc"]
        + [("d", 5, dt.datetime(2024, 9, 6, 8, 1), "", "application/octet-stream", None, "unsupported_format")],
        "path string, size long, mtime timestamp, ext string, mime string, kind string, error string",
    )
    reports = rpt.file_reports(scanned, files).orderBy("path").collect()
    assert [(r["path"], r["category_counts"], r["protection_level"], r["error"], r["text_length"], r["rows_processed"]) for r in reports] == [
        ("a", {"email": 3}, "УЗ-3", "extract_error: broken", 28, 12),
        ("b", {}, "Без ПДн", None, 6, 0),
        ("c", {"ogrn": 1}, "Без ПДн", None, 18, 0),
        ("d", {}, "Без ПДн", "unsupported_format", 0, 0),
    ]
    table = rpt.file_reports(scanned, files)
    assert rpt.totals(table).first().asDict() == {"total_files": 4, "files_with_pii": 2, "errors": 2}
    assert [tuple(r) for r in rpt.result_rows(table).collect()] == [(10, "sep 26 18:31", "a")]
    assert {tuple(r) for r in rpt.by_format(table).collect()} == {("txt", 3), ("(без расш.)", 1)}
    assert [tuple(r) for r in rpt.by_level(table).collect()] == [("УЗ-3", 1), ("Без ПДн", 3)]
    assert [tuple(r) for r in rpt.top_files(table).collect()] == [("a", "УЗ-3", 3, "email"), ("c", "Без ПДн", 1, "ogrn")]


def test_hidden_hashes_and_context(spark):
    chunks = _chunks(spark, [("a", 0, "a@b.ru, c@d.ru", "full", None)])
    rows = fnd.findings(fnd.scan_chunks(chunks, store_value_hash=False, masking="hash_only")).collect()
    assert len(rows) == 2 and {r["value_hash"] for r in rows} == {""}
    assert all(r["value_masked"].startswith("sha256:") for r in rows)


def test_summary_and_profile_read_their_input_once(spark):
    """One scan and one exchange for all report tables; sizes of files are counted once."""
    from veilscan.operators import profile as prf
    from veilscan.sources.sinks import summary

    schema = "path string, extension string, category_counts map<string,bigint>, protection_level string, error string"
    rows = [("/a", ".txt", {"fio": 2, "phone": 1}, "УЗ-4", None), ("/b", "", {}, None, "broken"), ("/c", ".txt", {"fio": 1}, "УЗ-4", None)]
    reports = spark.createDataFrame(rows, schema)
    got = {(r.metric, r.key): r.value for r in summary(reports).collect()}
    assert got == {
        ("total_files", ""): 3, ("files_with_pii", ""): 2, ("errors", ""): 1, ("protection_level_counts", "УЗ-4"): 2,
        ("protection_level_counts", "Без ПДн"): 1, ("category_counts", "fio"): 3, ("category_counts", "phone"): 1,
        ("format_counts", "txt"): 2, ("format_counts", "(без расш.)"): 1,
    }
    empty = {r.metric: r.value for r in summary(reports.limit(0)).collect()}
    assert empty == {"total_files": 0, "files_with_pii": 0, "errors": 0}
    plan = summary(reports)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Generate") == 1

    files = spark.createDataFrame([("/r/a.txt", 5), ("/r/b.txt", 7), ("/r/c.csv", 100)], "path string, size long").withColumn("mtime", F.current_timestamp())
    facts = prf.file_facts(files, "/r")
    sizes = prf.size_table(facts)
    assert prf.overview(facts, sizes).first() == prf.overview(facts).first()
    assert "LogicalRDD" not in prf.by_extension(facts, sizes)._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[:3] for r in prf.by_extension(facts, sizes).collect()] == [(".txt", "Текстовые", 2), (".csv", "Таблицы", 1)]
