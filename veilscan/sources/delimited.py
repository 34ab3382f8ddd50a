"""Delimited files of any size, read in splits, with the chunks that a reader of the whole file would give.

Where a record ends depends on whether a quote is open, which depends on all text before. Within a split that is a function of
two states: each run of quotes leaves the state as it is (an even run), turns it (an odd run where a field begins) or closes it (any
other odd run), and so does every sequence of them. So

1. one pass gives for each split the function for each possible separator, the beginning of the file (separator, header) and whether
   a record ends in it;
2. running sums over the splits of a file, small rows, give the state each split begins in. A quote that is still open at the
   end of the file is plain text: it is the last odd run of the file, and everything behind it is read as if it were even;
3. a second pass cuts every split into records, which are written; a record over several splits is put together from its parts, which
   have a column of their own, so that looking for them reads no other record;
4. counts of the records that fit the header give by one more running sum the number of each row, and so its chunk of 25 000
   rows. Rows meet their chunk in a shuffle by file and chunk, all of like size.

Nothing but one row for each split is ever sorted by file. The second pass learns the state of its split by a broadcast while there are at
most ``BROADCAST_SPLITS`` splits and by a join on file and split beyond that; so do records the number of their row. Small splits share a
task, as in the reader of texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.functions.files import suffix
from veilscan.session import shared_dir
from veilscan.sources.documents import lines, packed
from veilscan.sources.tables import ROWS_PER_CHUNK, SAMPLE_BYTES, SEPARATORS, column_category, fields, rendered_record, separator

#: Splits whose states are broadcast, about 100 bytes each, and bytes of headers that are broadcast with their first row numbers.
BROADCAST_SPLITS, BROADCAST_BYTES = 100_000, 16 << 20
_QUOTE, _LINE_END = 0x22, 0x0A
_MARK = b"\xef\xbb\xbf"


def quote_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each odd run of quotes begins, the byte before it (a line end at the beginning), and where it ends."""
    quote = np.zeros(len(data) + 2, dtype=bool)
    quote[1:-1] = data == _QUOTE
    edge = np.flatnonzero(quote[1:] != quote[:-1])
    starts, ends = edge[::2], edge[1::2]
    odd = (ends - starts) % 2 == 1
    starts, ends = starts[odd], ends[odd]
    before = np.where(starts > 0, data[starts - 1], _LINE_END) if len(data) else np.zeros(0, np.uint8)
    return starts, before, ends


def states(before: np.ndarray, sep: int, state: int, plain: int | None = None) -> np.ndarray:
    """Whether a quote is open (1) before each odd run and behind the last one; run number ``plain`` counts as even."""
    turns = ((before == sep) | (before == _LINE_END)).astype(np.int64)
    closes = 1 - turns
    if plain is not None and 0 <= plain < len(turns):
        turns[plain] = closes[plain] = 0
    so_far = np.concatenate([[0], np.cumsum(turns)])
    last = np.maximum.accumulate(np.concatenate([[0], np.where(closes == 1, np.arange(1, len(turns) + 1), 0)]))
    begun = np.where(last > 0, 0, state)
    return (begun + so_far - so_far[last]) % 2


def _normal(values: pa.Array) -> bytes:
    """Lines of a split as one text; all line ends are a single line feed."""
    raw = b"\n".join(values.to_pylist()) + b"\n"
    return raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n") if b"\r" in raw else raw


def _by_split(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where the split, told by some columns, changes; the lines of a split follow each other."""
    for batch in batches:
        codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in names]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield tuple(batch.column(c)[a].as_py() for c in names), batch.slice(a, b - a)


class _Summary:
    """What is known of a split so far, for each separator."""

    def __init__(self, key: tuple[str, int]):
        self.key, self.odd, self.head = key, 0, b""
        n = len(SEPARATORS)
        self.turns, self.closed, self.ended = [0] * n, [False] * n, [False] * n
        self.header: list[bytes | None] = [None] * n
        self.first_line: bytes | None = None
        self.opening = b""

    def add(self, values: pa.Array) -> None:
        if self.key[1] < SAMPLE_BYTES and len(self.head) < SAMPLE_BYTES:
            self.head = (self.head + b"\n".join(values.to_pylist()) + b"\n")[:SAMPLE_BYTES]
        raw = _normal(values)
        if self.key[1] == 0:
            if self.odd == 0 and not self.opening and self.first_line is None:
                raw = raw.removeprefix(_MARK)
            if None in self.header:
                self._look_for_header(raw)
        data = np.frombuffer(raw, dtype=np.uint8)
        starts, before, _ = quote_runs(data)
        line_ends = np.flatnonzero(data == _LINE_END)
        for k, sep in enumerate(SEPARATORS):
            # the state within the split if a quote was open at its beginning
            inside = states(before, ord(sep), self.turns[k] % 2 if self.closed[k] else (1 + self.turns[k]) % 2)
            if not self.ended[k]:
                self.ended[k] = bool((inside[np.searchsorted(starts, line_ends)] == 0).any())
            own = (before == ord(sep)) | (before == _LINE_END)
            closing = np.flatnonzero(~own)
            if len(closing):
                self.closed[k], self.turns[k] = True, int(own[closing[-1] + 1 :].sum())
            else:
                self.turns[k] += int(own.sum())
        self.odd += len(starts)

    def _look_for_header(self, raw: bytes) -> None:
        self.opening += raw
        data = np.frombuffer(self.opening, dtype=np.uint8)
        starts, before, _ = quote_runs(data)
        line_ends = np.flatnonzero(data == _LINE_END)
        for k, sep in enumerate(SEPARATORS):
            if self.header[k] is None:
                ends = line_ends[states(before, ord(sep), 0)[np.searchsorted(starts, line_ends)] == 0]
                found = (self.opening[a:b] for a, b in zip([0, *(ends + 1).tolist()], ends.tolist()))
                self.header[k] = next((r for r in found if r), None)
        if self.first_line is None:
            self.first_line = next((x for x in self.opening.split(b"\n") if x), None)

    def row(self) -> tuple:
        return (
            *self.key, self.odd, [t % 2 for t in self.turns], self.closed, self.ended,
            self.head if self.key[1] < SAMPLE_BYTES else None, self.header, self.first_line,
        )


_SUMMARY = pa.schema(
    [
        ("path", pa.string()),
        ("block_start", pa.int64()),
        ("odd", pa.int64()),
        ("turns", pa.list_(pa.int32())),
        ("closed", pa.list_(pa.bool_())),
        ("ended", pa.list_(pa.bool_())),
        ("head", pa.binary()),
        ("headers", pa.list_(pa.binary())),
        ("first_line", pa.binary()),
    ]
)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Summary | None = None
    for key, part in _by_split(batches, "path", "block_start"):
        if now is None or now.key != key:
            if now is not None:
                yield _summary_batch(now)
            now = _Summary(key)
        now.add(part.column("value"))
    if now is not None:
        yield _summary_batch(now)


def _summary_batch(summary: _Summary) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(summary.row(), _SUMMARY, strict=True)], schema=_SUMMARY)


def _spark_schema() -> str:
    return (
        "path string, block_start long, odd long, turns array<int>, closed array<boolean>, ended array<boolean>, "
        "head binary, headers array<binary>, first_line binary"
    )


def split_states(summaries: DataFrame) -> DataFrame:
    """State, separator and header of each split: one row a split, from rows of the same size.

    Columns: ``path``, ``block_start``, ``state``, ``plain`` (number of the odd run that counts as even), ``began`` (the split where the
    record began that is open here), ``sep``, ``header``.
    """
    file = W.partitionBy("path")
    in_order = file.orderBy("block_start")
    up_to, so_far = in_order.rowsBetween(W.unboundedPreceding, -1), in_order.rowsBetween(W.unboundedPreceding, 0)
    # the first bytes of a file may lie in several splits
    sample = F.array_join(F.collect_list(F.hex("head")).over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "")
    head = F.make_valid_utf8(F.substring(F.unhex(sample), 1, SAMPLE_BYTES).cast("string"))
    known = summaries.withColumn("sep", separator(head, suffix(F.col("path")))).drop("head")
    at = F.array_position(F.array(*[F.lit(s) for s in SEPARATORS]), F.col("sep")).cast("int") - 1
    known = known.select(
        "path", "block_start", "odd", "sep", "first_line",
        F.get("turns", at).alias("turn"), F.get("closed", at).alias("close"), F.get("ended", at).alias("end"), F.get("headers", at).alias("own_header"),
    )
    # turns since the last split that closes whatever was open; such a split sets the state by its own turns
    summed = known.withColumn("turned", F.sum(F.when(F.col("close"), 0).otherwise(F.col("turn"))).over(so_far))
    summed = summed.withColumn("set", F.when(F.col("close"), F.col("turned") - F.col("turn")))
    behind = (F.col("turned") - F.coalesce(F.last("set", ignorenulls=True).over(so_far), F.lit(0))) % 2
    stated = summed.withColumn("behind", F.abs(behind)).withColumn("state", F.coalesce(F.lag("behind").over(in_order), F.lit(0)))
    # a quote that nothing closes: the last odd run of the file
    left_open = F.last("behind").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == 1
    last_odd = F.max(F.when(F.col("odd") > 0, F.col("block_start"))).over(file)
    stated = stated.withColumn("open_at", F.when(left_open, last_odd))
    stated = stated.withColumn("state", F.when(F.col("block_start") > F.col("open_at"), 0).otherwise(F.col("state")))
    stated = stated.withColumn("plain", F.when(F.col("block_start") == F.col("open_at"), F.col("odd") - 1))
    began = F.last(F.when((F.col("state") == 0) | F.col("end"), F.col("block_start")), ignorenulls=True).over(up_to)
    # the header that ends nowhere in the first split is plain text up to its line end, or longer than a split
    unclosed = F.col("own_header").isNull() & (F.col("open_at") == 0)
    first = F.when((F.col("open_at") == 0) & (F.col("odd") == 1) & unclosed, F.col("first_line")).otherwise(F.col("own_header"))
    header = F.max(F.when(F.col("block_start") == 0, first)).over(file)
    return stated.select(
        "path", "block_start", F.col("state").cast("int").alias("state"), F.col("plain").cast("long").alias("plain"), began.alias("began"), "sep",
        F.make_valid_utf8(header.cast("string")).alias("header"), (F.col("first_line").isNotNull()).alias("filled"),
    )


class _Cutter:
    """Cuts the lines of one split into records."""

    def __init__(self, told: str):
        row = json.loads(told)
        self.told, self.key = told, (row["path"], row["block_start"])
        self.sep, self.cells, self.began = ord(row["sep"]), row["cells"], row.get("began")
        self.state, self.plain, self.open_record = row["state"], row.get("plain"), row["state"] == 1
        self.held, self.rank, self.odd, self.fresh = b"", 0, 0, True

    def add(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        raw = _normal(values)
        if self.fresh and self.key[1] == 0:
            raw = raw.removeprefix(_MARK)
        self.fresh = False
        data = np.frombuffer(raw, dtype=np.uint8)
        starts, before, _ = quote_runs(data)
        now = states(before, self.sep, self.state, None if self.plain is None else self.plain - self.odd)
        line_ends = np.flatnonzero(data == _LINE_END)
        ends = line_ends[now[np.searchsorted(starts, line_ends)] == 0]
        seps = np.flatnonzero(data == self.sep)
        seps = seps[now[np.searchsorted(starts, seps)] == 0]
        self.odd, self.state = self.odd + len(starts), int(now[-1])
        begins = np.concatenate([[0], ends + 1])
        fits = (ends > begins[:-1]) & (np.diff(np.searchsorted(seps, begins)) + 1 <= self.cells)
        if len(ends) and self.open_record:
            yield self._part(self.began, self.held + raw[: int(ends[0])])
            self.open_record, self.held, fits[0] = False, b"", False
        elif len(ends) and self.held:
            # began in an earlier batch of this split, so its cells are counted anew
            record = self.held + raw[: int(ends[0])]
            self.held, fits[0] = b"", False
            if _cells(record, self.sep) <= self.cells:
                yield self._whole(pa.array([record], pa.binary()))
        if fits.any():
            # each record with its line end, which is then taken off
            offsets = pa.array(begins, pa.int32())
            cut = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(raw)])
            yield self._whole(pc.binary_slice(cut.filter(pa.array(fits)), 0, -1))
        self.held += raw[int(begins[-1]) :]

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is open at the end of the split: the beginning, or a middle part, of a record."""
        if self.held:
            yield self._part(self.began if self.open_record else self.key[1], self.held)

    def _whole(self, records: pa.Array) -> pa.RecordBatch:
        n, self.rank = len(records), self.rank + len(records)
        ranks = pa.array(np.arange(self.rank - n, self.rank))
        return self._batch(ranks, pa.nulls(n, pa.int64()), records, pa.nulls(n, pa.binary()))

    def _part(self, began: int, part: bytes) -> pa.RecordBatch:
        return self._batch(pa.array([-1], pa.int64()), pa.array([began], pa.int64()), pa.nulls(1, pa.binary()), pa.array([part], pa.binary()))

    def _batch(self, *columns: pa.Array) -> pa.RecordBatch:
        n = len(columns[0])
        path, start = pa.repeat(pa.scalar(self.key[0], pa.string()), n), pa.repeat(pa.scalar(self.key[1], pa.int64()), n)
        return pa.RecordBatch.from_arrays([path, start, *columns], ["path", "block_start", "rank", "began", "record", "part"])


def _cells(record: bytes, sep: int) -> int:
    data = np.frombuffer(record, dtype=np.uint8)
    starts, before, _ = quote_runs(data)
    seps = np.flatnonzero(data == sep)
    return 1 + int((states(before, sep, 0)[np.searchsorted(starts, seps)] == 0).sum())


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Cutter | None = None
    for (told,), part in _by_split(batches, "told"):
        if now is None or now.told != told:
            if now is not None:
                yield from now.rest()
            now = _Cutter(told)
        yield from now.add(part.column("value"))
    if now is not None:
        yield from now.rest()


def large_csv_chunks(spark: SparkSession, root: str, glob: str, min_bytes: int) -> DataFrame:
    """Delimited files above ``min_bytes``, read in splits: chunks of 25 000 rows below their header line.

    Equal to what ``csv_chunks`` gives for the whole file, wherever the splits end. Split summaries and records are written to
    the shared folder of the session. A header must end in the first split of its file.
    """
    out = shared_dir(spark)
    rows = packed(lines(spark, root, glob, min_bytes, "\n")).select("path", "block_start", "line_no", F.col("value").cast("binary").alias("value"))
    rows.select("path", "block_start", "value").mapInArrow(_summaries, _spark_schema()).write.parquet(f"{out}/summaries")
    names = fields(F.col("header"), F.col("sep"))
    stated = split_states(spark.read.parquet(f"{out}/summaries")).withColumn("cells", F.size(names))
    too_long = F.raise_error(F.concat(F.lit("the header is longer than a split: "), "path"))
    checked = F.when(F.col("header").isNull() & F.col("filled"), too_long.cast("int")).otherwise(F.col("cells"))
    stated.withColumn("cells", checked).drop("filled").write.parquet(f"{out}/splits")
    splits = spark.read.parquet(f"{out}/splits").where("header is not null")
    size = splits.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("header")), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= BROADCAST_SPLITS
    told = splits.select("path", "block_start", "state", "plain", "began", "sep", "cells")
    key = ["path", "block_start"]
    # one column for all that is told, as each is handed over line by line
    packets = told.select(*key, F.to_json(F.struct(*told.columns)).alias("told"))
    joined = rows.join(F.broadcast(packets) if few else packets, key)
    if not few:
        joined = joined.sortWithinPartitions(*key, "line_no")
    cut = joined.select("told", "value").mapInArrow(_records, "path string, block_start long, rank long, began long, record binary, part binary")
    cut.write.parquet(f"{out}/records")
    records = packed(spark.read.parquet(f"{out}/records")).withColumn("record", F.make_valid_utf8(F.col("record").cast("string")))

    # records over several splits: few rows, joined by the split they began in
    parts = packed(spark.read.parquet(f"{out}/records")).where("rank < 0").groupBy("path", "began").agg(
        F.max("block_start").alias("block_start"), F.array_sort(F.collect_list(F.struct("block_start", "part"))).alias("parts")
    )
    whole = F.make_valid_utf8(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["part"])), "")).cast("string"))
    crossing = parts.select("path", "block_start", whole.alias("record")).join(told.select(*key, "sep", "cells"), key)
    crossing = crossing.where(F.size(fields(F.col("record"), F.col("sep"))) <= F.col("cells")).select(*key, F.lit(-1).cast("long").alias("rank"), "record")
    crossing.write.parquet(f"{out}/crossing")
    crossing = spark.read.parquet(f"{out}/crossing")
    body = records.where("rank >= 0").select(*key, "rank", "record").unionByName(crossing)

    # the header is the first record of its file
    counts = body.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") < 0, 1).otherwise(0)).alias("lead"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = splits.select(*key, "sep", "header").join(counts, key, "left").na.fill(0, ["n", "lead"])
    placed = counted.withColumn("first", before - 1 + F.col("lead")).withColumn("names", fields(F.col("header"), F.col("sep")))
    placed.select(*key, "n", "first", "sep", "names", F.transform("names", column_category).alias("categories")).write.parquet(f"{out}/placed")
    placed = spark.read.parquet(f"{out}/placed")
    begun = placed.select(*key, "first", "names", "categories", "sep")
    numbered = body.join(F.broadcast(begun) if few and size["bytes"] <= BROADCAST_BYTES else begun, key)
    text = rendered_record(F.col("names"), F.col("categories"), fields(F.col("record"), F.col("sep")))
    filled = (
        numbered.select("path", (F.col("first") + F.col("rank")).alias("row_no"), text.alias("text"))
        .where("row_no >= 0")
        .groupBy("path", F.floor(F.col("row_no") / ROWS_PER_CHUNK).alias("chunk_no"))
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("rows"))
        .select("path", "chunk_no", F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("body"))
    )
    top = placed.where("block_start = 0").select("path", F.array_join("names", " ").alias("top"))
    empty = placed.groupBy("path").agg(F.sum("n").alias("n")).where("n <= 1").select("path", F.lit(0).cast("long").alias("chunk_no"), F.lit(0).alias("n_rows"), F.lit(None).cast("string").alias("body"))
    return (
        filled.unionByName(empty)
        .join(top, "path")
        .select(
            "path",
            "chunk_no",
            F.concat_ws("\n", "top", "body").alias("text"),
            F.concat(F.lit("chunk="), F.col("chunk_no").cast("string"), F.lit(":rows="), F.col("n_rows").cast("string")).alias("locator"),
        )
    )
