"""Small splits of delimited files share tasks."""

import glob

import pytest

from veilscan.sources import delimited
from veilscan.sources import tables as tab
from veilscan.sources.files import binary_files, describe


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "4k")
    yield 4096
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def test_delimited_splits_share_a_task(spark, tmp_path, monkeypatch, small_splits):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    body = "".join(f'{k};"client ""{k}""\nof {k % 7}";{"" if k % 5 else chr(34) + "x;y" + chr(34) + "z"}\n' for k in range(9_000))
    (root / "a.csv").write_text("id;full_name;note\n" + body)
    whole = tab.csv_chunks(describe(binary_files(spark, str(root)), str(root))).collect()
    monkeypatch.setattr(delimited, "shared_dir", lambda spark: str(out))
    got = delimited.large_csv_chunks(spark, str(root), "*.csv", -1).collect()
    assert [(r.chunk_no, r.locator, r.text) for r in got] == [(r.chunk_no, r.locator, r.text) for r in whole]
    assert len(body) > 50 * small_splits
    for table in ("summaries", "records"):
        assert len(glob.glob(f"{out}/{table}/*.parquet")) <= 2 * spark.sparkContext.defaultParallelism
    # one row a split, as before
    assert spark.read.parquet(f"{out}/summaries").count() > 50
