import unicodedata

import pyarrow as pa

from veilscan.functions import text as txt
from veilscan.sources import documents, windows


def test_small_splits_share_a_task(spark, tmp_path):
    """Splits gathered in a task are the same splits, and few tasks are left however many there are."""
    lines = "\n".join(f"строка {i} user{i}@mail.ru" for i in range(20_000))
    (tmp_path / "a.txt").write_text(lines)
    (tmp_path / "b.txt").write_text(lines[: len(lines) // 3])
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, "4k")
        single = documents.lines(spark, str(tmp_path), "*.txt", -1, "\n")
        packed = documents.packed(single)
        assert packed.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism < single.rdd.getNumPartitions()
        assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, single.collect()))
        chunks = windows.text_windows(spark, str(tmp_path), "*.txt", -1, halo=256, core=2048)
        owned = chunks.selectExpr("path", "chunk_no", "substring(text, own_from + 1, own_to - own_from) AS own").orderBy("path", "chunk_no").collect()
        assert chunks.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    for name in ("a.txt", "b.txt"):
        assert "".join(r.own for r in owned if r.path.endswith(name)).rstrip("\n") == (tmp_path / name).read_text().rstrip("\n")


def test_normal_forms_are_made_in_slices(monkeypatch):
    """A batch is never held whole as Python strings."""
    texts = [None if i % 7 == 0 else f"é№{i} " * (i % 5) for i in range(500)]
    sizes = []
    whole = pa.array

    def watched(values, *kind):
        sizes.append(len(values))
        return whole(values, *kind)

    monkeypatch.setattr(txt.pa, "array", watched)
    for form in ("NFKD", "NFKC"):
        got = txt._normalized(form, whole(texts, pa.string()))
        assert got.to_pylist() == [None if t is None else unicodedata.normalize(form, t) for t in texts]
    assert max(sizes) <= 64
