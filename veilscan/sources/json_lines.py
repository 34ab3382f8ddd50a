"""JSON lines of files of any size in chunks of at least 10 000 leaves.

A chunk is closed by the line that fills it, so where chunks begin depends on all lines before. For a part of a file that is a function
of the leaves already held when it begins, and it only depends on which line closes the first chunk: at most as many
lines as a chunk has leaves. So

1. each part gives a table: for every line that may close the first chunk, how many chunks are closed and how many leaves are held
   at its end (found by binary search in the part's running sums, for all of these lines side by side);
2. the parts of a file are gone through in order, one look-up for each, which tells every part what is held when it begins;
3. a second pass cuts the parts into chunks. Chunks inside a part are whole at once; only those over the end of a part are put
   together from pieces.

No row holds the sizes of all lines of a file, and the texts are not shuffled but for the pieces at the ends of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.session import shared_dir
from veilscan.sources.documents import lines
from veilscan.sources.json import flatten_json

# Fixed value: leaves that fill a chunk.
LEAVES_PER_CHUNK = 10_000
#: Parts whose beginnings are broadcast, about 100 bytes each.
BROADCAST_PARTS = 100_000
_TABLE = "path string, part long, total long, reach array<long>, held array<long>, closed array<long>"
_BEGIN = "path string, part long, held long, chunk long"
_PIECE = "path string, chunk_no long, part long, whole boolean, text string"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch | None]]:
    """Batches cut where the part changes; None at the end of a part."""
    now = None
    for batch in batches:
        path, part = batch.column("path"), batch.column("part").to_numpy()
        codes = path.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                key = (path[a].as_py(), int(part[a]))
                if now is not None and now != key:
                    yield now, None
                now = key
                yield key, batch.slice(a, b - a)
    if now is not None:
        yield now, None


def closing_table(sizes: np.ndarray, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """All leaves of a part; and for each line that may close the first chunk its running sum, leaves held at the end, chunks closed."""
    sums = np.cumsum(sizes)
    total = int(sums[-1]) if len(sums) else 0
    first = np.unique(np.searchsorted(sums, np.arange(1, most + 1)))
    first = first[first < len(sums)]
    at, closed = first.copy(), np.ones(len(first), dtype=np.int64)
    live = np.arange(len(first))
    while len(live):
        following = np.searchsorted(sums, sums[at[live]] + most)
        on = following < len(sums)
        live = live[on]
        at[live] = following[on]
        closed[live] += 1
    return total, sums[first], total - sums[at], closed


def _tables(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: list[np.ndarray] = []
        for key, batch in _parts(batches):
            if batch is not None:
                sizes.append(batch.column("n").to_numpy().astype(np.int64))
                continue
            total, *rest = closing_table(np.concatenate(sizes), most)
            sizes = []
            arrays = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([total], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in rest)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _TABLE.split(", ")])

    return run


def _beginnings(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chunk = None, 0, 0
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                path, part, total = (batch.column(c)[k].as_py() for c in ("path", "part", "total"))
                if path != now:
                    now, held, chunk = path, 0, 0
                out.append((path, part, held, chunk))
                reach = batch.column("reach")[k].values.to_numpy()
                at = int(np.searchsorted(reach, most - held))
                if at < len(reach):
                    held = batch.column("held")[k].values[at].as_py()
                    chunk += batch.column("closed")[k].values[at].as_py()
                else:
                    held += total
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3), strict=True)], ["path", "part", "held", "chunk"])

    return run


def _pieces(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        held = chunk = first = None

        def piece(key: tuple[str, int], whole: bool) -> pa.RecordBatch:
            values = (key[0], chunk, key[1], whole, "\n".join(texts))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [f.split()[0] for f in _PIECE.split(", ")])

        for key, batch in _parts(batches):
            if batch is None:
                if texts:
                    yield piece(key, False)
                texts, held = [], None
                continue
            if held is None:
                held, chunk = batch.column("held")[0].as_py(), batch.column("chunk")[0].as_py()
                first = held > 0
            for n, text in zip(batch.column("n").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if n:
                    texts.append(text)
                held += n
                if held >= most:
                    yield piece(key, not first)
                    texts, held, chunk, first = [], 0, chunk + 1, False

    return run


def _chunks(rows: DataFrame, out: str, most: int, in_order: bool) -> DataFrame:
    """``rows`` has path, part, line_no, n and text, the rows of a part in one task, and gives the same rows each time it is read."""
    spark = rows.sparkSession
    order = ("path", "part", "line_no")
    sized = rows.select(*order, "n")
    (sized if in_order else sized.sortWithinPartitions(*order)).select("path", "part", "n").mapInArrow(_tables(most), _TABLE).write.parquet(f"{out}/tables")
    tables = spark.read.parquet(f"{out}/tables").repartition("path").sortWithinPartitions("path", "part")
    tables.mapInArrow(_beginnings(most), _BEGIN).write.parquet(f"{out}/beginnings")
    begin = spark.read.parquet(f"{out}/beginnings")
    few = begin.count() <= BROADCAST_PARTS
    joined = rows.join(F.broadcast(begin) if few else begin, ["path", "part"])
    if not (few and in_order):
        # sorted behind the join: the optimizer takes away what is sorted below one
        joined = joined.sortWithinPartitions(*order)
    joined.select("path", "part", "n", "text", "held", "chunk").mapInArrow(_pieces(most), _PIECE).write.parquet(f"{out}/pieces")
    pieces = spark.read.parquet(f"{out}/pieces")
    ends = pieces.where("not whole").groupBy("path", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    joined_ends = ends.select("path", "chunk_no", F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), "\n").alias("text"))
    found = pieces.where("whole").select("path", "chunk_no", "text").unionByName(joined_ends)
    return found.where("text != ''").select("path", "chunk_no", "text", F.lit("jsonl_batch").alias("locator"))


def json_line_chunks(spark: SparkSession, root: str, glob: str, most: int = LEAVES_PER_CHUNK) -> DataFrame:
    """JSON lines below a folder, read in splits: the leaves of the valid lines of each file, in chunks."""
    rows = lines(spark, root, glob).select("path", F.col("block_start").alias("part"), "line_no", flatten_json(F.trim("value")).alias("leaves"))
    sized = rows.where("leaves is not null").select("path", "part", "line_no", F.size("leaves").alias("n"), F.array_join("leaves", "\n").alias("text"))
    return _chunks(sized, shared_dir(spark), most, in_order=True)


def json_line_batches(rows: DataFrame, max_objects: int | None = None, most: int = LEAVES_PER_CHUNK, part_lines: int = 1 << 20) -> DataFrame:
    """The same for a table of lines: path, line_no and leaves; parts are ``part_lines`` line numbers long.

    ``max_objects`` keeps the first valid objects of each file.
    """
    if max_objects is not None:
        rank = F.row_number().over(W.partitionBy("path").orderBy("line_no"))
        rows = rows.where("leaves is not null").withColumn("rank", rank).filter(F.col("rank") <= max_objects).drop("rank")
    sized = rows.where("leaves is not null").select(
        "path", F.floor(F.col("line_no") / part_lines).alias("part"), "line_no", F.size("leaves").alias("n"), F.array_join("leaves", "\n").alias("text")
    )
    return _chunks(sized.repartition("path", "part"), shared_dir(rows.sparkSession), most, in_order=False)
