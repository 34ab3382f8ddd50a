from pyspark.sql import functions as F

from veilscan import session
from veilscan.operators import detect as det


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    """As many splits as cores may still hold all rows in one of them."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 5000, 1, 1).write.parquet(f"{tmp_path}/t")
    spark.range(5000, 5000 + cores, 1, cores).write.mode("append").parquet(f"{tmp_path}/t")
    spread = session.spread(spark.read.parquet(f"{tmp_path}/t"))
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5000 + cores and max(sizes) <= 200


def test_small_inputs_still_reach_all_cores(spark):
    assert session.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_numbers_with_just_enough_digits_are_searched(spark):
    """The least number of digits of each pattern, in ASCII and in other scripts, and more matches than one block holds."""
    texts = ["паспорт 6004 123456", "паспорт ٦٠٠٤ ١٢٣٤٥٦", "рожд 1.1.1990", "driver АВ 123456", "БИК 044525225", "адрес 123456", " ".join(["driver АВ 123456;"] * 600)]
    rows = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "path string, chunk_no long, text string")
    found = {(r.path, r.category): r["count"] for r in det.detect(rows, min_confidence=0.0).groupBy("path", "category").count().collect()}
    assert found[("0", "passport_rf")] == found[("1", "passport_rf")] == found[("2", "birth_date")] == found[("3", "driver_license")] == 1
    assert found[("4", "bik")] == found[("5", "address")] == 1 and found[("6", "driver_license")] == 600
