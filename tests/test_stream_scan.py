import __spark_entry__ as entry_points


def test_documents_in_one_file_or_in_a_folder(spark, tmp_path):
    """The stream reads the table whichever way it is laid out."""
    rows = [(i, f"mail user{i}@mail.ru", "en", f"s{i % 2}", 20) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    stream_scan = entry_points.queries()["stream_scan"]
    results = [sorted(map(tuple, stream_scan(spark, f"{tmp_path}/{kind}").collect())) for kind in ("folder", "file")]
    assert results[0] == results[1] and len(results[0]) == 20
