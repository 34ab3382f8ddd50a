"""Small splits of texts: few rows that meet by file, no work for copies."""

import pytest
from pyspark.sql import functions as F

from veilscan.operators import detect
from veilscan.sources import windows
from veilscan.sources.files import binary_files


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "4k")
    yield 4096
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def test_neighbouring_splits_meet_in_their_task(spark, tmp_path, monkeypatch, small_splits):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    text = "".join(f"строка {k} user{k}@mail.ru\n" for k in range(12_000))
    (root / "a.txt").write_text(text)
    (root / "b.txt").write_text(text)
    monkeypatch.setattr(windows, "shared_dir", lambda spark: str(out))
    copies = binary_files(spark, str(root)).select("path").where(F.col("path").endswith("b.txt"))
    chunks = windows.text_windows(spark, str(root), "*.txt", -1, halo=256, core=2048, left_out=copies).collect()
    own = [r.text[r.own_from : r.own_to] for r in sorted(chunks, key=lambda r: r.chunk_no)]
    assert "".join(own) == text and {r.path.rsplit("/", 1)[-1] for r in chunks} == {"a.txt"}
    edges = spark.read.parquet(f"{out}/edges")
    assert edges.where(F.col("path").endswith("b.txt")).count() == 0
    # ends of tasks, and of the last split, which is shorter
    assert edges.count() <= 2 * spark.sparkContext.defaultParallelism + 2 < len(text.encode()) // small_splits


def test_text_length_is_counted_once(spark, monkeypatch):
    """Not for every machine readable zone: that took the square of a text's length."""
    text, transform, length = F.col("text"), F.transform, F.length
    depth, counted = [0], []

    def deeper(*args):
        depth[0] += 1
        out = transform(*args)
        depth[0] -= 1
        return out

    with monkeypatch.context() as m:
        m.setattr(F, "transform", deeper)
        m.setattr(F, "length", lambda c: (counted.append(depth[0]) if c is text else None, length(c))[1])
        detect._mrz(text, F.col("hits"))
    # outside of all loops over matches
    assert counted == [0]
    line = "P<RUSORLOV<<PETR<<<<<<<<<<<<<<<<<<<<<<<<<<<<\n1234567890RUS8001017M2501017<<<<<<<<<<<<<<02"
    text = f"{line}\nконец\n{line}"
    spans = detect.with_spans(spark.createDataFrame([(text,)], "text string"), detectors=["mrz"]).first().spans
    assert [(s.start, s.end) for s in spans] == [(0, len(line) + 1), (len(line) + 7, len(text))]
