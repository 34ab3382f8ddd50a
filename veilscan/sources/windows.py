"""Plain text files of any size: windows that overlap, so that findings don't depend on where splits end.

A file is read in splits; small ones that follow each other in a task count as one. Each window owns a part of the text, its core, and carries up to ``HALO`` bytes of the text on either side; a
match belongs to the window in whose core it starts. Windows inside a split are cut as its lines stream by. The text around the
end of a split, ``2 * HALO`` bytes on either side, is written on the way as a small table, one row a split; windows over
that end are cut from it. Only those rows meet by file; windows cut from
them are dealt out again for the search, and no other text is shuffled.

What counts for a whole file is found once and told to its windows: whether all of it is UTF-8, whether it holds marked values, and
the residues of its BIKs (ten values stand for any number of them). Only files with something to tell are joined.

The findings are those of the whole text as long as no match, or run of matches that touch each other, is longer than ``HALO``
less the context that rules look at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.functions import checksums as check
from veilscan.functions.regex import detect_regex
from veilscan.operators.detect import MARKER
from veilscan.session import shared_dir
from veilscan.sources.documents import TASK_BYTES, decode_as, lines, packed

#: Bytes of text that a window carries on either side, and bytes that it owns (at least four halos).
HALO, CORE = 1 << 15, 1 << 19
#: Files with something to tell that are broadcast, about 100 bytes each.
BROADCAST_FILES = 100_000
_PART = "path string, chunk_no long, left binary, core binary, right binary"
_EDGE = "path string, block_start long, n long, size long, head binary, head_end long, tail binary, tail_start long, tail_from long"


def fit(raw: bytes, at: int) -> int:
    """The next place where a code point begins; in text that is not UTF-8, ``at`` itself."""
    for k in range(at, min(at + 4, len(raw))):
        if raw[k] & 0xC0 != 0x80:
            return k
    return min(at, len(raw))


def order_of(block_start: int, offset: int) -> int:
    """Order of a place in its file, from the split and the place in it."""
    return ((block_start >> 12) << 31) + offset


class _Windows:
    """Windows over one stream of text; places are counted from its beginning."""

    def __init__(self, halo: int, core: int):
        self.halo, self.core = halo, core
        self.raw, self.base = b"", 0
        self.at: int | None = None
        self.places: list[tuple[int, int, int]] = []

    def add(self, raw: bytes, block_start: int, offset: int) -> None:
        """Go on with text that stands ``offset`` bytes behind the beginning of its split."""
        if not self.places or self.places[-1][1] != block_start:
            self.places.append((self.base + len(self.raw), block_start, offset))
        self.raw += raw

    def begin(self, at: int) -> None:
        self.at = at

    def ready(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Windows that are surely inside, whatever the stream's end leaves to others."""
        while self.at is not None and self.at + self.core + 4 + 2 * self.halo <= self.base + len(self.raw):
            yield self._cut(fit(self.raw, self.at + self.core - self.base) + self.base)

    def close(self, end: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """The windows up to ``end``; what follows is context only."""
        while self.at is not None and self.at < end:
            to = fit(self.raw, self.at + self.core - self.base) + self.base
            yield self._cut(end if to + self.halo > end else to)

    def _cut(self, to: int) -> tuple[int, bytes, bytes, bytes]:
        a, b = self.at - self.base, to - self.base
        begin, block_start, offset = next(p for p in reversed(self.places) if p[0] <= self.at)
        window = (
            order_of(block_start, self.at - begin + offset),
            self.raw[fit(self.raw, max(0, a - self.halo)) : a],
            self.raw[a:b],
            self.raw[b : fit(self.raw, b + self.halo)],
        )
        self.at = to
        kept = max(0, b - self.halo - 4)
        self.raw, self.base = self.raw[kept:], self.base + kept
        return window


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int] | None, bytes]]:
    """The text of each split piece by piece, with its path, start and file size; None at the end of a split.

    A split that begins where the one before it in the task ended goes on with that, so that only the ends of the whole row of splits
    have to meet those of other tasks.
    """
    now, last, until = None, None, None
    for batch in batches:
        path, start, end, size = (batch.column(c).to_pylist() for c in ("path", "block_start", "block_end", "size"))
        values = batch.column("value").to_pylist()
        a = 0
        for b in range(1, len(values) + 1):
            if b == len(values) or start[b] != start[a] or path[b] != path[a]:
                if now is None or path[a] != now[0] or start[a] not in (last, until):
                    if now is not None:
                        yield None, b""
                    now = (path[a], start[a], size[a])
                last, until = start[a], end[a]
                yield now, b"\n".join(values[a:b]) + b"\n"
                a = b
    if now is not None:
        yield None, b""


def _edges(halo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last, key = 0, b"", b"", None
        for now, raw in _splits(batches):
            if now is not None:
                key, n = now, n + len(raw)
                first = (first + raw)[: 4 * halo + 4] if len(first) < 4 * halo + 4 else first
                last = (last + raw)[-(2 * halo + 8) :]
                continue
            whole = n <= 4 * halo
            head = first if whole else first[: fit(first, 2 * halo)]
            head_end = len(head) if whole else fit(head, halo)
            # the tail begins at tail_start and is owned by others up to tail_from
            base = n - len(last)
            begin = fit(last, n - 2 * halo - base) if not whole else 0
            owned = fit(last, n - halo - base) if not whole else 0
            row = (key[0], key[1], n, key[2], head, head_end, None if whole else last[begin:], begin + base, owned - begin)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in _EDGE.split(", ")])
            n, first, last = 0, b"", b""

    return run


def _rows(path: str, windows: Iterator[tuple[int, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    for order, left, core, right in windows:
        arrays = [pa.array([path]), pa.array([order], pa.int64()), *(pa.array([x], pa.binary()) for x in (left, core, right))]
        yield pa.RecordBatch.from_arrays(arrays, ["path", "chunk_no", "left", "core", "right"])


def _inside(halo: int, core: int):
    """Windows inside the splits, from ``halo`` behind their beginning to ``halo`` before their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, windows = None, 0, _Windows(halo, core)
        for key, raw in _splits(batches):
            if key is None:
                if n > 4 * halo:
                    yield from _rows(now[0], windows.close(fit(windows.raw, n - halo - windows.base) + windows.base))
                now, n, windows = None, 0, _Windows(halo, core)
                continue
            now, n = key, n + len(raw)
            windows.add(raw, key[1], 0)
            if windows.at is None and n > halo + 4:
                windows.begin(fit(windows.raw, halo))
            yield from _rows(key[0], windows.ready())

    return run


def _across(halo: int, core: int):
    """Windows over the ends of splits, from the parts of each run in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, end, windows = None, 0, 0, _Windows(halo, core)
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["path"], row["run"])
                if now is not None and now != key:
                    yield from _rows(now[0], windows.close(end))
                    n, windows = 0, _Windows(halo, core)
                now = key
                windows.add(row["part"], row["block_start"], row["offset"])
                if windows.at is None:
                    windows.begin(row["own_from"])
                end = n + row["own_to"]
                n += len(row["part"])
                yield from _rows(now[0], windows.ready())
        if now is not None:
            yield from _rows(now[0], windows.close(end))

    return run


def _runs(edges: DataFrame) -> DataFrame:
    """The texts around the ends of splits: ``path``, ``run``, ``block_start``, ``offset``, ``part``, ``own_from``, ``own_to``."""
    in_order = W.partitionBy("path").orderBy("block_start")
    everything = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # the reader does not tell whether the last line has a line end; the size of the file does
    bare = (F.sum("n").over(everything) > F.col("size")) & (F.col("block_start") == F.last("block_start").over(everything))
    cut = bare.cast("int")
    large = F.col("tail").isNotNull()
    known = edges.withColumn("cut", cut).withColumn("run", F.coalesce(F.sum(large.cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def without_cut(part: Column) -> Column:
        return F.substring(part, F.lit(1), (F.octet_length(part) - F.col("cut")).cast("int"))

    zero = F.lit(0).cast("long")
    head = F.when(large, F.col("head")).otherwise(without_cut(F.col("head")))
    head_to = F.when(large, F.col("head_end")).otherwise(F.octet_length(head).cast("long"))
    first = known.select("path", "run", "block_start", zero.alias("offset"), head.alias("part"), zero.alias("own_from"), head_to.alias("own_to"))
    tail = without_cut(F.col("tail"))
    second = known.where(large).select(
        "path", (F.col("run") + 1).alias("run"), "block_start", F.col("tail_start").alias("offset"), tail.alias("part"), F.col("tail_from").alias("own_from"), F.octet_length(tail).cast("long").alias("own_to")
    )
    return first.unionByName(second)


def file_facts(rows: DataFrame) -> DataFrame:
    """What a file tells all its windows: ``utf8``, ``file_marked``, ``file_residues``; files with nothing to tell are left out."""
    value = F.col("value")
    found = F.filter(F.regexp_extract_all(value, F.lit(detect_regex("bik")), F.lit(0)), check.bik_check)
    bits = F.aggregate(found, F.lit(0), lambda acc, b: acc.bitwiseOR(F.pow(F.lit(2), check.bik_residue(b)).cast("int")))
    told = rows.select(
        "path",
        F.is_valid_utf8(value).alias("utf8"),
        value.contains(MARKER).alias("marked"),
        F.when(value.rlike(r"\d{9}"), bits).otherwise(0).alias("bits"),
    )
    facts = told.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("marked").alias("file_marked"), F.bit_or("bits").alias("bits"))
    residues = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda r: F.col("bits").bitwiseAND(F.pow(F.lit(2), r).cast("int")) > 0)
    return facts.where("not utf8 or file_marked or bits > 0").select("path", "utf8", "file_marked", residues.alias("file_residues"))


def text_windows(
    spark: SparkSession, root: str, glob: str, min_bytes: int, halo: int | None = None, core: int | None = None, left_out: DataFrame | None = None
) -> DataFrame:
    """Plain text files above ``min_bytes`` as windows, without those whose ``path`` is in the small table ``left_out``.

    Columns: ``path``, ``chunk_no`` (in the order of the text), ``text`` with its halos, ``locator``, ``own_from`` and ``own_to`` (the
    core, in characters), ``file_marked`` and ``file_residues``. Texts around the ends of splits, and facts, are written to the
    shared folder of the session.
    """
    halo, core = halo or HALO, core or CORE
    if core < 4 * halo:
        raise ValueError("a core has at least four halos")
    out = shared_dir(spark)
    rows = packed(lines(spark, root, glob, min_bytes, "\n"))
    if left_out is not None:
        rows = rows.join(F.broadcast(left_out), "path", "left_anti")
    file_facts(rows).write.parquet(f"{out}/facts")
    facts = spark.read.parquet(f"{out}/facts")
    read = rows.select("path", "block_start", "block_end", "size", F.col("value").cast("binary").alias("value"))
    read.mapInArrow(_edges(halo), _EDGE).write.parquet(f"{out}/edges")
    # the session's splits may be small, those of this table need not be
    edges = packed(spark.read.parquet(f"{out}/edges"))
    parts = _runs(edges).repartition("path", "run").sortWithinPartitions("path", "run", "block_start")
    # splits of less than four halos make one run of a whole file, so its windows are dealt out again
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-edges.count() * 4 * halo // TASK_BYTES))
    across = parts.mapInArrow(_across(halo, core), _PART).repartition(tasks)
    windows = read.mapInArrow(_inside(halo, core), _PART).unionByName(across)
    few = facts.count() <= BROADCAST_FILES
    told = windows.join(F.broadcast(facts) if few else facts, "path", "left")
    utf8 = F.coalesce("utf8", F.lit(True))
    left, own, right = (decode_as(F.col(c), utf8) for c in ("left", "core", "right"))
    return told.select(
        "path",
        "chunk_no",
        F.concat(left, own, right).alias("text"),
        F.lit("full").alias("locator"),
        F.length(left).alias("own_from"),
        (F.length(left) + F.length(own)).alias("own_to"),
        F.coalesce("file_marked", F.lit(False)).alias("file_marked"),
        F.coalesce("file_residues", F.array().cast("array<int>")).alias("file_residues"),
    )
