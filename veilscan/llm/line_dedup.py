"""Line de-duplication by two Bloom filters: only lines that were probably seen twice leave their documents to be compared.

A line's key is the line without white space at both ends and with A-Z lowered. Keys of at least ``min_chars`` code points that
``min_docs`` documents or more hold lose all their lines, except in the document with the largest id that holds them.

1. Every document's distinct keys set bits in a filter of once-seen hashes; bits that are set already go to a filter of
   twice-seen hashes. A task writes the places of its bits, packed in steps of 16 bits, by segments of the filter; a segment's places from
   all tasks are then merged as they stream by (once: or; twice: or, plus what both had once), in the memory of one segment.
2. The filter of twice-seen bits goes to all tasks. Its size follows the bytes of the texts up to ``MOST_BITS`` (64 MB), which
   bounds what is broadcast. Beyond that it fills up and lets more lines through that are then found to be single: more rows are
   shuffled, up to one for each line, and the result stays exact.
3. Keys that pass are counted by their cryptographic digests of 128 bits (partial sums first), which confirms repeats exactly and
   chooses the document that keeps them. Documents then meet the keys they lose: keys that hold more than 1/4096 of those rows, fewer than
   4096, by a broadcast, so that a line in a third of all documents is no hot join key, all others by a shuffle.
4. Documents are joined with the hashes of the lines they lose and rewritten.

Defined results: a null or empty text is one empty line; lines that repeat inside a document count once for it; each row counts as
a document, also if ids repeat, and all rows with the chosen id keep their lines; a null id is smaller than any other, and a line
that only rows without an id hold keeps all of them; an empty table gives an empty table; further columns are carried along by
``without_repeats`` and not read by the query.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from xxhash import xxh3_64_intdigest

from veilscan.llm.shared import written

MIN_CHARS, MIN_DOCS = 20, 3
#: Bits that a key sets, bits for each 16 bytes of text, and the bounds of a filter's size.
PROBES, BYTES_A_BIT, LEAST_BITS, MOST_BITS = 2, 16, 1 << 20, 1 << 29
#: Bits of a segment, 128 KB.
SEGMENT = 1 << 20
#: Hashes that a task holds before it packs their bits.
HELD = 1 << 20
#: Keys that hold more than this part of the compared rows are joined by a broadcast; there are fewer of them than that.
HOT_PART = 4096


WHITE = b" \t\n\v\f\r"
#: Bytes that go on with a code point.
_INNER = bytes(range(0x80, 0xC0))


def is_long(key: bytes, min_chars: int) -> bool:
    """Whether a key has ``min_chars`` code points; most are decided by their bytes alone."""
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.translate(None, _INNER)) >= min_chars)


def keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The key of each line of a text, None for short ones; bytes are lowered and stripped as ASCII."""
    found = (line.strip(WHITE).lower() for line in (text or b"").split(b"\n"))
    return [k if is_long(k, min_chars) else None for k in found]


def _as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    for part in range(0, len(column), 256):
        yield from column.slice(part, 256).cast(pa.binary()).to_pylist()


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits that each hash sets, PROBES to a row."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def pack(places: np.ndarray) -> bytes:
    """Ascending places as steps of 16 bits; a longer step is told as 65535 for each 65535 of it."""
    steps = np.diff(places, prepend=-1) - 1
    over = steps // 65535
    out = np.full(len(steps) + int(over.sum()), 65535, dtype="<u2")
    out[np.arange(len(steps)) + np.cumsum(over)] = steps % 65535
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, dtype="<u2").astype(np.int64)
    real = steps != 65535
    return (np.cumsum(steps + real) - 1)[real]


def seen_bits(texts: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """Merged filters of all texts: ``segment`` and ``twice``, packed places of bits that two keys or more have set."""
    segment = min(bits, SEGMENT)

    def packed(hashes: list[int]) -> Iterator[pa.RecordBatch]:
        places = np.sort(probes(np.array(hashes, dtype=np.uint64), bits), axis=None)
        new = np.ones(len(places), dtype=bool)
        new[1:] = places[1:] != places[:-1]
        for kind, found in ((False, places[new]), (True, np.unique(places[~new]))):
            edge = np.searchsorted(found, np.arange(0, bits + 1, segment))
            which = np.flatnonzero(np.diff(edge))
            own = [pack(found[edge[k] : edge[k + 1]] - k * segment) for k in which]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([kind] * len(which), pa.bool_()), pa.array(own, pa.binary())], ["segment", "twice", "places"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        for batch in batches:
            for text in _as_bytes(batch.column(0)):
                hashes += map(xxh3_64_intdigest, {k for k in keys(text, min_chars) if k is not None})
                if len(hashes) >= HELD:
                    yield from packed(hashes)
                    hashes = []
        yield from packed(hashes)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, again, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k not in once:
                    once[k], twice[k] = (np.zeros(segment, dtype=bool) for _ in range(2))
                places = unpack(raw)
                if not again:
                    twice[k][places[once[k][places]]] = True
                    once[k][places] = True
                else:
                    twice[k][places] = True
        packed = [zlib.compress(np.packbits(v, bitorder="little").tobytes(), 1) for v in twice.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()), pa.array(packed, pa.binary())], ["segment", "bits"])

    parts = texts.mapInArrow(local, "segment int, twice boolean, places binary")
    return parts.repartition("segment").mapInArrow(merge, "segment int, bits binary")


def filter_bits(texts: DataFrame) -> int:
    """Bits of a filter for these texts: a power of two that follows their bytes, within bounds."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, int(total // BYTES_A_BIT) - 1).bit_length()))


def twice_seen(texts: DataFrame, min_chars: int) -> np.ndarray:
    """The filter of twice-seen hashes, at most MOST_BITS / 8 bytes."""
    bits = filter_bits(texts)
    segment = min(bits, SEGMENT)
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in seen_bits(texts, bits, min_chars).toLocalIterator():
        out[row.segment * segment // 8 : (row.segment + 1) * segment // 8] = np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
    return out


def suspects(source: DataFrame, seen: np.ndarray, min_chars: int) -> DataFrame:
    """``id``, ``h`` and ``key`` of the distinct keys of each row that the filter holds."""
    shared = source.sparkSession.sparkContext.broadcast(zlib.compress(seen.tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zlib.decompress(shared.value), dtype=np.uint8)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                owner, own = [], []
                for k, text in enumerate(_as_bytes(part.column(1))):
                    some = {x for x in keys(text, min_chars) if x is not None}
                    owner += [k] * len(some)
                    own += some
                hashes = np.array([xxh3_64_intdigest(x) for x in own], dtype=np.uint64)
                places = probes(hashes, 8 * len(bitmap))
                again = np.flatnonzero(((bitmap[places >> 3] >> (places & 7)) & 1).all(axis=1))
                digests = pa.array([blake2b(own[i], digest_size=16).digest() for i in again], pa.binary())
                ids = part.column(0).take(pa.array(np.array(owner, dtype=np.int64)[again]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(hashes[again].view(np.int64)), digests], ["id", "h", "key"])

    return source.mapInArrow(run, StructType([source.schema["id"], StructField("h", LongType()), StructField("key", BinaryType())]))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The lines that documents lose: ``id`` and ``lost``, the 64-bit hashes of their keys."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = twice_seen(source.select("text"), min_chars)
    found = written(suspects(source, seen, min_chars), "line-suspects")
    confirmed = written(
        found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs), "line-repeats"
    )
    often = max(1, confirmed.agg(F.sum("n")).first()[0] or 0) / HOT_PART
    both = found.join(F.broadcast(confirmed.where(F.col("n") > often).withColumnRenamed("keeper", "hot_keeper").withColumnRenamed("n", "hot_n")), "key", "left")
    hot = both.where("hot_n is not null").select("id", "h", F.col("hot_keeper").alias("keeper"))
    rest = both.where("hot_n is null").select("id", "h", "key").join(confirmed.where(F.col("n") <= often), "key").select("id", "h", "keeper")
    lost = hot.unionByName(rest).where("keeper is not null and not (id <=> keeper)")
    return lost.groupBy("id").agg(F.collect_set("h").alias("lost"))


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """All rows and columns, texts without repeated lines; ``counts`` names further columns for lines before and lines dropped."""
    own = f"_{uuid.uuid4().hex}"
    lost = repeats(docs, id_col, text_col, min_chars, min_docs).select(F.col("id").alias(f"{own}_id"), F.col("lost").alias(f"{own}_lost"))
    joined = docs.join(lost, docs[id_col].eqNullSafe(lost[f"{own}_id"]), "left").drop(f"{own}_id")
    names = docs.columns
    text_at = names.index(text_col)
    fields = [StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema.fields]
    fields += [StructField(name, LongType()) for name in counts or ()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts, n_lines, n_dropped = _cut(part.column(text_at), part.column(len(names)), min_chars)
                columns = [texts if i == text_at else part.column(i) for i in range(len(names))]
                if counts:
                    columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return joined.mapInArrow(run, StructType(fields))


def _cut(column: pa.Array, lost: pa.Array, min_chars: int) -> tuple[pa.Array, list[int], list[int]]:
    """Texts without the lines whose key's hash is listed for them, lines before, lines dropped."""
    texts, n_lines, n_dropped = [], [], []
    for text, gone in zip(_as_bytes(column), lost.to_pylist(), strict=True):
        lines = (text or b"").split(b"\n")
        n_lines.append(len(lines))
        if gone:
            some = set(gone)
            own = keys(text, min_chars)
            lines = [line for line, k in zip(lines, own, strict=True) if k is None or _signed(xxh3_64_intdigest(k)) not in some]
            text = b"\n".join(lines)
        texts.append(text)
        n_dropped.append(n_lines[-1] - len(lines))
    return pa.array(texts, pa.binary()).cast(pa.string()), n_lines, n_dropped


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole text of ``documents`` that three documents hold stay in one of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_repeats(docs, counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
    WITH lines AS (
        SELECT doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
    gone AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    judged AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM lines LEFT JOIN gone USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY doc_id"""
