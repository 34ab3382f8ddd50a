"""What a task of the pipeline holds at most at a time, beside its batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import jaccard_groups, quality_rules, repeated_bytes
from veilscan.llm import words as W


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    return pa.array([" ".join(f"w{n}" for n in rng.integers(0, 9000, 400)) for _ in range(2500)])


def peak(f):
    f()
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_quality_rules_hold_little(texts, monkeypatch):
    made = []
    monkeypatch.setattr(quality_rules, "filtered", lambda docs, column, keep: made.append(keep()))
    quality_rules.kept_rows(None)
    assert peak(lambda: made[0](texts)) < 40e6


def test_shingles_hold_little(texts):
    data, offs = W.texts(texts)
    assert peak(lambda: jaccard_groups._pieced(data, offs, 5)) < 40e6


def test_anchors_hold_little(texts, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    ids = pa.array(np.arange(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], ["id", "h", "text"])
    assert peak(lambda: [None for _ in repeated_bytes._scan(100, 24, 8)([batch])]) < 80e6
