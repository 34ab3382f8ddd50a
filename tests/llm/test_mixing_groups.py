"""Texts that are mixed side by side."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from veilscan.llm import context_mixing


def test_texts_of_some_megabytes_are_mixed_side_by_side(monkeypatch):
    """Each group runs to the end of its longest text, so few texts in a group make many runs."""
    groups = []

    def mixed(tables, classes, ctx, first, sizes):
        groups.append(len(first))
        return np.zeros(len(first))

    monkeypatch.setattr(context_mixing, "_mix_group", mixed)
    monkeypatch.setattr(context_mixing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    made = []
    kind = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))
    docs = SimpleNamespace(schema={"id": kind}, mapInArrow=lambda run, fields: made.append(run))
    none = np.zeros(0, dtype=np.uint64)
    chances = np.full(context_mixing.NODES, 0.5, dtype=np.float32)
    tables = context_mixing.Tables([], chances, np.ones(context_mixing.NODES), none, none.view(np.int64), True, 0, 0)
    context_mixing._score_tasks(docs, tables)
    texts = [" ".join(f"{k}-{n}" + "x" * 100 for n in range(140)) for k in range(300)]
    assert sum(map(len, texts)) > 4 << 20
    rows = list(made[0]([pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["id", "text"])]))
    assert groups == [300]
    assert [n for r in rows for n in r.column(2).to_pylist()] == [141] * 300
