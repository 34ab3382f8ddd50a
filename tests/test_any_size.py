"""Files give the same chunks and findings whether they are read whole or in splits of any size."""

import random

import pytest
from pyspark.sql import functions as F

from veilscan.operators.findings import findings, scan_chunks
from veilscan.sources import delimited, json_lines, windows
from veilscan.sources import documents as docs
from veilscan.sources import tables as tab
from veilscan.sources.files import binary_files, describe


@pytest.fixture
def split_size(spark):
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None}
    before = {k: spark.conf.get(k) for k in keys}

    def use(n):
        for k in keys:
            spark.conf.set(k, str(n))

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def _cell(rng, sep):
    kind = rng.random()
    if kind < 0.25:
        return '"' + rng.choice(["a", 'x""y', f"one{sep}two", "two\nlines", "three\r\nmore\n\nlines", '""', "", "длинное " * 40]) + '"' + rng.choice(["", "", "tail", 'ta"il'])
    return rng.choice(["", "plain", 'in"side', "кириллица", "user@mail.ru", "7", f'q"{"x" * rng.randrange(50)}'])


def _table(rng, sep, rows, line_end):
    lines = [sep.join(["id", '"full_name"', "note", "e-mail"])]
    for k in range(rows):
        cells = [str(k), *(_cell(rng, sep) for _ in range(rng.choice([3, 3, 3, 3, 2, 5])))]
        lines.append(sep.join(cells))
        if rng.random() < 0.05:
            lines.append("")
    return line_end.join(lines) + rng.choice(["", line_end])


@pytest.fixture(scope="module")
def delimited_files(tmp_path_factory):
    root = tmp_path_factory.mktemp("delimited")
    rng = random.Random(11)
    for k in range(8):
        sep = (";", ",", "\t")[k % 3]
        text = _table(rng, sep, rng.choice([3, 40, 120]), ("\n", "\r\n", "\n", "\r\n")[k % 4])
        if k == 4:
            text += '\n9;"never closed;x\n10;a""b;"";y\n\n11;z;"""";w'
        if k == 5:
            text = "﻿" + text
        (root / f"f{k}{'.tsv' if sep == chr(9) else '.csv'}").write_bytes(text.encode("utf-8") + (b";\xff\xfe" if k == 6 else b""))
    (root / "header.csv").write_text('a;"b\nc";d')
    (root / "open.csv").write_text('"a;b\n1;2\n3;4\n' * 3)
    (root / "openhead.csv").write_text('a;"b\n1;2\n\n3;4\n')
    (root / "blank.csv").write_text("\n\n\r\n")
    (root / "long.csv").write_text("id;fio\n" + "\n".join(f"{k};n{k}" for k in range(60_000)))
    return str(root)


@pytest.mark.parametrize("size", [1000, 65536, 128 * 1024 * 1024])
def test_delimited(spark, delimited_files, split_size, size, monkeypatch):
    if size == 1000:
        monkeypatch.setattr(delimited, "BROADCAST_SPLITS", 0)
    whole = describe(binary_files(spark, delimited_files), delimited_files)
    keep = ~F.col("path").contains("long.csv") if size == 1000 else F.lit(True)
    want = {(r.path, r.chunk_no): (r.locator, r.text) for r in tab.csv_chunks(whole).where(keep).collect()}
    split_size(size)
    got = delimited.large_csv_chunks(spark, delimited_files, "f*" if size == 1000 else "*", -1).collect()
    got = {(r.path, r.chunk_no): (r.locator, r.text) for r in got}
    if size == 1000:
        want = {k: v for k, v in want.items() if "/f" in k[0]}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == value, key
    if size != 1000:
        assert [n for p, n in sorted(got) if p.endswith("long.csv")] == [0, 1, 2]


def test_states_of_odd_runs():
    import numpy as np

    def plainly(text, sep, state):
        out, at_start, k = [], True, 0
        while k < len(text):
            c = text[k]
            if state == 1:
                if c == '"' and text[k + 1 : k + 2] == '"':
                    k += 1
                elif c == '"':
                    state, at_start = 0, False
            elif c == '"' and at_start:
                state = 1
            else:
                at_start = c in (sep, "\n")
            if c == "\n":
                out.append(state)
            k += 1
        return out

    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice('"";;\nab') for _ in range(rng.randrange(60))) + "\n"
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        for state in (0, 1):
            starts, before, _ = delimited.quote_runs(data)
            now = delimited.states(before, ord(";"), state)
            assert now[np.searchsorted(starts, np.flatnonzero(data == 10))].tolist() == plainly(text, ";", state)


_SENTENCES = [
    "Паспорт гражданина: серия 4509\n 112233 выдан.\n", "ИНН организации\n7707083893 указан\n", "звонить +7 (916)\n555-12-34\n", "Место рождения: г. Тверь,\nТверская область; рост\n",
    "расчётный счёт 40702810900000005555\n", "БИК 044525225\n", "Орлов Пётр\nСергеевич и Зайцева Ольга Павловна\n", "почта box@site.ru", "\r\n", "просто текст без данных, ничего более. " * 12,
    "P<RUSORLOV<<PETR<<<<<<<<<<<<<<<<<<<<<<<<<<<<\n1234567890RUS8001017M2501017<<<<<<<<<<<<<<02\n", "карта 4111 1111 1111\n1111 visa\n", "диагноз: здоров\n", "ул. Садовая,\nд. 5, кв. 7\n",
]


@pytest.fixture(scope="module")
def text_files(tmp_path_factory):
    root = tmp_path_factory.mktemp("texts")
    rng = random.Random(5)
    for k in range(6):
        text = "".join(rng.choice(_SENTENCES) for _ in range((400, 30, 1, 700, 250, 500)[k]))
        if k == 3:
            text = text.replace("БИК 044525225", "") + "БИК 044525225"
        if k == 4:
            text += "[[PII_DIRECT:email:a@b.ru]]"
        (root / f"t{k}.txt").write_bytes(text.encode("cp1251" if k == 5 else "utf-8"))
    (root / "empty.txt").write_bytes(b"")
    (root / "line.txt").write_bytes(("слово " * 20_000 + "почта end@site.ru").encode())
    return str(root)


def _found(chunks):
    scanned = scan_chunks(chunks)
    rows = findings(scanned).collect()
    sizes = scanned.groupBy("path").agg(F.sum("text_length").alias("n")).collect()
    return sorted(map(tuple, rows)), sorted(map(tuple, sizes))


@pytest.mark.parametrize("size, core", [(4096, 8192), (128 * 1024 * 1024, 6000), (128 * 1024 * 1024, None)])
def test_text(spark, text_files, split_size, size, core):
    whole = docs.text_chunks(describe(binary_files(spark, text_files), text_files))
    want = _found(whole)
    split_size(size)
    halo = None if core is None else 1000
    chunks = windows.text_windows(spark, text_files, "*.txt", -1, halo, core)
    got = _found(chunks)
    assert got[1] == want[1]
    assert got[0] == want[0] and len(want[0]) > 20
    assert {r[1] for r in want[0]} > {"passport_rf", "bank_account", "mrz", "birth_place", "fio", "address"}
    # cores follow each other without a gap
    texts = {}
    for r in sorted(chunks.collect(), key=lambda r: r.chunk_no):
        texts[r.path] = texts.get(r.path, "") + r.text[r.own_from : r.own_to]
    assert texts == {r.path: r.text for r in whole.collect()}


def _line_chunks(sizes, most):
    """Which lines each chunk has, one after another."""
    out, now, held = [], [], 0
    for k, n in enumerate(sizes):
        now.append(k)
        held += n
        if held >= most:
            out.append(now)
            now, held = [], 0
    return out + ([now] if now else [])


@pytest.mark.parametrize("size, few", [(4096, True), (65_536, False), (128 * 1024 * 1024, True)])
def test_json_lines(spark, tmp_path, split_size, monkeypatch, size, few):
    rng = random.Random(8)
    want = {}
    for k, n in enumerate((5000, 1, 900)):
        sizes = [rng.choice([0, 1, 1, 2, 7, 30 if k else 3]) for _ in range(n)]
        texts = [[f"k{i}={j}" for i in range(m)] for j, m in enumerate(sizes)]
        raw = ["{" + ", ".join(f'"k{i}": {j}' for i in range(m)) + "}" for j, m in enumerate(sizes)]
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(x + rng.choice(["", "\n", "\nbroken", "\n{"]) for x in raw))
        chunks = ["\n".join(x for j in own for x in texts[j]) for own in _line_chunks(sizes, 100)]
        want |= {(f"f{k}.jsonl", c): text for c, text in enumerate(chunks) if text}
    if not few:
        monkeypatch.setattr(json_lines, "BROADCAST_PARTS", 0)
    split_size(size)
    got = json_lines.json_line_chunks(spark, str(tmp_path), "*.jsonl", 100).collect()
    assert {(r.path.rsplit("/", 1)[-1], r.chunk_no): r.text for r in got} == want and len(got) == len(want)


def test_a_million_lines_in_one_file(spark):
    """Several parts and hundreds of chunks; the sizes of a file never meet in one row."""
    rows = spark.range(1_000_000).select(
        F.lit("/one").alias("path"), F.col("id").alias("line_no"), F.array_repeat(F.lit("a=1"), (F.col("id") % 7).cast("int")).alias("leaves")
    )
    got = json_lines.json_line_batches(rows, part_lines=1 << 16).select("chunk_no", F.size(F.split("text", "\n")).alias("n")).collect()
    assert [n for _, n in sorted((r.chunk_no, r.n) for r in got)] == [sum(k % 7 for k in own) for own in _line_chunks([k % 7 for k in range(1_000_000)], 10_000)]
