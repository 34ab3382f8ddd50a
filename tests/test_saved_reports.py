import datetime as dt

from veilscan.schema import REPORTS
from veilscan.sources import sinks


def test_reports_are_made_once_for_files_and_summary(spark, tmp_path):
    """The summary is that of the saved reports; making them again would group all files' rows once more."""
    at = dt.datetime(2020, 1, 2, 3, 4, 5)
    rows = [
        ("a\nb", 3, at, ".txt", "text/plain", "text", {"phone": 2, "email": 1}, "УЗ-4", None, 10, 1),
        ("a\nb", 3, at, ".txt", "text/plain", "text", {"phone": 2, "email": 1}, "УЗ-4", None, 10, 1),
        ("c", None, None, "", None, None, {}, None, "unsupported_format", 0, 0),
        (None, 1, at, None, None, None, None, "Без ПДн", "", 0, 0),
    ]
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame(rows, REPORTS)
    findings = spark.createDataFrame([], "path string, category string")
    out = str(tmp_path / "out")
    sinks.write_report_json(plain.mapInArrow(counted, REPORTS), findings, out)
    assert made.value == len(rows)
    kind = "metric string, key string, value long"
    saved = sorted(map(tuple, spark.read.schema(kind).json(f"{out}/summary").collect()))
    assert saved == sorted(map(tuple, sinks.summary(plain).collect()))
    sinks.write_report_json(plain.where("false"), findings, out)
    empty = sorted(map(tuple, spark.read.schema(kind).json(f"{out}/summary").collect()))
    assert empty == sorted(map(tuple, sinks.summary(plain.where("false")).collect()))
