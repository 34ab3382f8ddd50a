"""Benchmark decontamination by greedy string tiling, which also finds passages whose parts were put in another order.

Benchmark items are cut into words (letters and digits, without case); every run of ``LEAST`` words is a seed. Texts look up
their own runs, and a text meets an item only if the item's words under shared seeds could reach the threshold.
Then tiles are laid: the longest common run of words that no tile covers yet is marked in both, again and again
until none of ``LEAST`` words is left. Runs are found by running Karp-Rabin hashes of a falling search length and are
compared word by word. An item is in a text if tiles cover at least ``COVERAGE`` of its words.

The seeds of a block of items go with the tasks; items are dealt to as many blocks of bounded size as their total asks
for, and the texts are read once per block. Texts are looked at one by one, without a shuffle.

Defined results: null and empty texts and items, and items of fewer than ``LEAST`` words, are in no pair; rows that repeat
are reported each; of equally long runs the first in the item, then in the text, is marked first; empty tables give an
empty table; texts are read in whole; further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import words as W
from veilscan.llm.rows import filtered

LEAST, COVERAGE = 3, 0.6
#: Bytes of items whose seeds one task holds.
BLOCK_BYTES = 8 << 20

_WORD = np.ones(256, dtype=np.uint8) * 32
_WORD[np.r_[48:58, 97:123, 128:256]] = np.r_[48:58, 97:123, 128:256]
_WORD[65:91] = np.arange(97, 123)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    plain = _WORD[data]
    starts, ends, firsts = W.spans(plain, offs)
    return W.word_hashes(plain, starts, ends), starts, ends, firsts


class Seeds:
    """Runs of ``least`` words of a block of items, sorted by hash, with a bit table in front."""

    def __init__(self, texts: pa.Array, least: int):
        data, offs = W.texts(texts)
        hashes, _, _, firsts = _words(data, offs)
        self.least = least
        self.words = [hashes[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        grams = W.grams(hashes, least)
        at = np.flatnonzero(W.inside(firsts, least)[: len(grams)])
        item = W.owners(firsts)[at]
        order = np.argsort(grams[at], kind="stable")
        self.hashes, self.item, self.place = grams[at][order], item[order], (at - firsts[item])[order]
        self._bits = np.zeros(1 << 22, dtype=bool)
        self._bits[self.hashes & np.uint64((1 << 22) - 1)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair of a gram and a seed with its hash."""
        maybe = np.flatnonzero(self._bits[grams & np.uint64((1 << 22) - 1)])
        low = np.searchsorted(self.hashes, grams[maybe], "left")
        counts = np.searchsorted(self.hashes, grams[maybe], "right") - low
        at = np.repeat(maybe, counts)
        seed = np.repeat(low, counts) + np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        return at, seed


def _free(marked: np.ndarray) -> np.ndarray:
    """How many words from each place on are not marked."""
    stops = np.append(np.flatnonzero(marked), len(marked))
    return stops[np.searchsorted(stops, np.arange(len(marked)))] - np.arange(len(marked))


def tiles(item: np.ndarray, text: np.ndarray, least: int, closed: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, words) of each tile; ``closed`` text words are never tiled."""
    done_item = np.zeros(len(item), dtype=bool)
    done_text = np.zeros(len(text), dtype=bool) if closed is None else closed.copy()
    sums_item, sums_text = W.prefix(item), W.prefix(text)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(text)))
    while True:
        free_item, free_text = _free(done_item), _free(done_text)
        a, b = np.flatnonzero(free_item >= size), np.flatnonzero(free_text >= size)
        found: list[tuple[int, int, int]] = []
        if len(a) and len(b):
            places = defaultdict(list)
            for i, h in zip(a.tolist(), W.span_hash(sums_item, a, a + size).tolist(), strict=True):
                places[h].append(i)
            for j, h in zip(b.tolist(), W.span_hash(sums_text, b, b + size).tolist(), strict=True):
                for i in places.get(h, ()):
                    if i and j and not done_item[i - 1] and not done_text[j - 1] and item[i - 1] == text[j - 1]:
                        continue  # part of a run that starts earlier
                    most = int(min(free_item[i], free_text[j]))
                    unlike = np.flatnonzero(item[i : i + most] != text[j : j + most])
                    length = int(unlike[0]) if len(unlike) else most
                    if length >= size:
                        found.append((length, i, j))
        if not found:
            if size == least:
                return out
            size = max(least, size // 2)
            continue
        longest = max(f[0] for f in found)
        for length, i, j in sorted(found, key=lambda f: f[1:]):
            if length == longest and not done_item[i : i + length].any() and not done_text[j : j + length].any():
                done_item[i : i + length] = True
                done_text[j : j + length] = True
                out.append((i, j, length))


def find(seeds: Seeds, data: np.ndarray, offs: np.ndarray, coverage: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
    """For each text and item of a slice that tiles cover enough: text, item, coverage, tiles (text words counted in the slice), word spans."""
    hashes, starts, ends, firsts = _words(data, offs)
    grams = W.grams(hashes, seeds.least)
    at, seed = seeds.hits(grams)
    fits = W.inside(firsts, seeds.least)
    at, seed = at[fits[at]], seed[fits[at]]
    if not len(at):
        return
    doc, item = W.owners(firsts)[at], seeds.item[seed]
    order = np.lexsort((at, item, doc))
    doc, item, at, place = doc[order], item[order], at[order], seeds.place[seed][order]
    first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
    for a, b in zip(first, np.append(first[1:], len(doc)), strict=True):
        words = seeds.words[item[a]]
        # words of the item that shared seeds cover: tiles can't cover more
        if (b - a) * seeds.least < coverage * len(words):
            continue
        reach = np.zeros(len(words), dtype=bool)
        for k in range(seeds.least):
            reach[place[a:b] + k] = True
        if reach.sum() < coverage * len(words):
            continue
        # the text's words under shared seeds, runs apart from each other
        under = np.unique(at[a:b, None] + np.arange(seeds.least))
        gap = np.flatnonzero(np.diff(under) > 1) + 1
        where = np.insert(under, gap, -1)
        closed = where < 0
        laid = tiles(words, np.where(closed, np.uint64(0), hashes[where]), seeds.least, closed)
        share = sum(t[2] for t in laid) / len(words)
        if share >= coverage:
            yield int(doc[a]), int(item[a]), share, [(i, int(where[j]), n) for i, j, n in laid], starts, ends


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    least: int = LEAST,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per text and item found in it: id, ``item_id``, ``coverage``, ``n_tiles``, ``longest``, ``tiles``.

    ``tiles`` are (start, end) in characters of the text, ascending.
    """
    items, blocks = _blocks(benchmark, block_bytes)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = source.schema["id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    fields = f"id {kind}, item_id {item_kind}, coverage double, n_tiles int, longest int, tiles array<struct<start: long, end: long>>"
    out = docs.sparkSession.createDataFrame([], fields)
    for block in range(blocks):
        part = _block(items, blocks, block)
        run = _runner(part["text"].combine_chunks(), part["item_id"].combine_chunks(), coverage, least)
        found = source.mapInArrow(run, fields)
        out = found if blocks == 1 else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Items with a text, and to how many blocks they are dealt."""
    items = benchmark.select("item_id", "text").where("octet_length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, -(-int(total) // block_bytes)


def _block(items: DataFrame, blocks: int, block: int) -> pa.Table:
    return items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, block_bytes: int = BLOCK_BYTES, text_col: str = "text"
) -> DataFrame:
    """The rows in which no item is found, with all their columns, in the pass that reads them."""
    items, blocks = _blocks(benchmark, block_bytes)
    for block in range(blocks):
        docs = filtered(docs, text_col, _keeper(_block(items, blocks, block)["text"].combine_chunks(), coverage, least))
    return docs


def _keeper(texts: pa.Array, coverage: float, least: int):
    seeds = Seeds(texts, least)

    def keep():
        def kept(column: pa.Array) -> pa.Array:
            data, offs = W.texts(column)
            out = np.ones(len(column), dtype=bool)
            for first, _, part, cuts in W.slices(data, offs, W.SMALL):
                out[[first + found[0] for found in find(seeds, part, cuts, coverage)]] = False
            return pa.array(out)

        return kept

    return keep


def _runner(texts: pa.Array, item_ids: pa.Array, coverage: float, least: int):
    seeds = Seeds(texts, least)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["id", "item_id", "coverage", "n_tiles", "longest", "tiles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, _, part, cuts in W.slices(data, offs, W.SMALL):
                rows = []
                for doc, item, share, laid, starts, ends in find(seeds, part, cuts, coverage):
                    body = part[cuts[doc] : cuts[doc + 1]]
                    points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
                    spans = [
                        {"start": int(points[starts[j] - cuts[doc]]), "end": int(points[ends[j + n - 1] - cuts[doc]])}
                        for _, j, n in sorted(laid, key=lambda t: t[1])
                    ]
                    rows.append((doc + first, item, share, len(laid), max(t[2] for t in laid), spans))
                if rows:
                    at, item, *rest = zip(*rows, strict=True)
                    types = [pa.float64(), pa.int32(), pa.int32(), span]
                    arrays = [batch.column(0).take(pa.array(at)), item_ids.take(pa.array(item))]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(list(v), t) for v, t in zip(rest, types, strict=True)], names)

    return run


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every whole text of ``documents``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
