"""Suffix-array de-duplication: bytes of texts that stand in a long string seen earlier, by merged Burrows-Wheeler transforms.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier: in a document with a smaller id, or
further left in the same one. Strings are judged on the input.

1. **Anchors.** Every string of ``LENGTH`` bytes has one anchor, the ``GRAM`` bytes in it with the smallest hash, the leftmost of
   equals, so equal strings have equal anchors at equal places. Strings that follow each other with one anchor form a run. Runs
   are dealt by their anchor's hash; only 26 bytes of hashes and places travel for each, none of text, and of equal
   runs in a batch one. Of equal runs all but the first are removed whole. A run with nothing to share is dropped: its anchor has no other
   run, or the ``REACH`` bytes around the anchor to either side differ from those of all others.
2. **Shards.** The bytes of the runs that are left, where a repeat begins or ends, are dealt by anchor. In each task, the runs of some anchors at a time are cut into
   shards; every shard's suffixes are sorted by doubling, which gives its Burrows-Wheeler transform.
3. **Merge.** The transforms are merged by refining their interleave: it says which shard the next suffix comes from, first in any
   order, then sorted by ever longer prefixes. A step reads, for each suffix in the present order, the bytes before it from
   its shard's transform and sorts the interleave by them, stably; that lengthens the prefix it is sorted by. Suffixes
   of different shards are never compared or sorted again. Where a step keeps neighbours apart, their
   common prefix ends; after ``LENGTH`` bytes, what is still together is an interval of equal strings.
4. In each interval all strings but the earliest are removed. The spans of a document are united and cut from its text.

Equality of anchors and runs is by 64-bit hashes; what the merge finds is compared byte by byte.

Defined results: null counts as the empty text; texts shorter than ``LENGTH`` stay whole, and a text of any length is read in
whole; a null id comes before all others; of rows with one id the one with the smaller text hash comes first, and rows equal in id
and text are one document, each with its result; ids are whole numbers, others an error; an empty table gives an empty
table; further columns are not read, or carried along whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import words as W
from veilscan.llm.rows import rewritten
from veilscan.llm.shared import written

LENGTH, GRAM = 100, 24
#: Least bytes of a shard; fewer than 256 shards are merged. Bytes of anchors' runs that a task merges at a time.
SHARD, MERGED = 1 << 18, 1 << 21
_PLACE = 22
_SEPARATOR = 0xFF


# --- anchors ----------------------------------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window, from running minima of blocks in both directions."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(padded, axis=1).reshape(-1)
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: len(x) - width + 1], forward[width - 1 : len(x)])


def runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of a slice: ``doc``, ``first`` (place of the first string in its text), ``near`` and ``far`` (bytes from the last and
    the first string to the anchor), hashes of the ``anchor``, the ``run``, and the ``left`` and ``right`` surroundings."""
    if len(data) >= 1 << _PLACE:
        return _long_runs(data, offs, length, gram)
    reach = (length - gram) // 2
    n = len(data)
    names = ("doc", "first", "near", "far", "anchor", "run", "left", "right")
    if n < length:
        return {k: np.zeros(0, dtype=np.int64 if k in names[:4] else np.uint64) for k in names}
    sums = W.prefix(data.astype(np.uint64) + np.uint64(1))
    at = np.arange(n - gram + 1)
    hashes = W.span_hash(sums, at, at + gram)
    bits = np.uint64(_PLACE)
    least = _sliding_min(hashes >> bits << bits | at.astype(np.uint64), length - gram + 1)
    end_of = np.repeat(offs[1:], np.diff(offs))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= end_of)
    place = (least[start] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    if not len(head):
        return {k: np.zeros(0, dtype=np.int64 if k in names[:4] else np.uint64) for k in names}
    first, last, place = start[head], start[np.append(head[1:], len(start)) - 1], place[head]
    doc = np.searchsorted(offs, first, "right") - 1
    far = place - first
    values = (
        doc,
        first - offs[doc],
        place - last,
        far,
        hashes[place],
        W.mix(W.span_hash(sums, first, last + length) + far.astype(np.uint64)),
        W.span_hash(sums, np.maximum(place - reach, 0), place + gram),
        W.span_hash(sums, place, np.minimum(place + gram + reach, n)),
    )
    return dict(zip(names, values, strict=True))


def _long_runs(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Texts beyond the place bits in parts that overlap by one string; a run at a cut becomes two."""
    found = []
    for doc in range(len(offs) - 1):
        text = data[offs[doc] : offs[doc + 1]]
        step = 1 << (_PLACE - 1)
        for base in range(0, max(len(text) - length + 1, 1), step):
            part = text[base : base + step + length - 1]
            got = runs(part, np.array([0, len(part)]), length, gram)
            got["doc"] = got["doc"] + doc
            got["first"] = got["first"] + base
            found.append(got)
    return {k: np.concatenate([g[k] for g in found]) for k in found[0]}


# --- dealing runs by anchor ---------------------------------------------------------------------------------------

_FIELDS = np.dtype(
    [("key", "<u4"), ("run", "<u8"), ("left", "<u2"), ("right", "<u2"), ("doc", "<u4"), ("first", "<u4"), ("near", "u1"), ("far", "u1")]
)
_SENT = "part int, batch long, ids array<long>, hashes array<long>, docs array<int>, body binary, spans binary, open binary"
_SENT_NAMES = ["part", "batch", "ids", "hashes", "docs", "body", "spans", "open"]
_SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("size", "<u4")])
_OPEN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("size", "<u4"), ("key", "<u8")])


def _sent(part, batch, ids=None, hashes=None, docs=None, body=None, spans=None, open_=None) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    types = [pa.int32(), pa.int64(), longs, longs, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    values = [part, batch, ids, hashes, docs, body, spans, open_]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], _SENT_NAMES)


def _group_firsts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, the last one first, and where in it a new value of all of them begins."""
    order = np.lexsort(columns)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    return order, new


def _scan(length: int, gram: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offs = W.texts(batch.column(2))
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, part, cuts in W.slices(data, offs, 1 << 24):
                yield from _scan_slice(ids[a:b], hashes[a:b], part, cuts, number)
                number += 1

    def _scan_slice(ids, hashes, data, offs, number) -> Iterator[pa.RecordBatch]:
        # one row of each document, in document order
        order, new = _group_firsts(hashes, ids)
        kept = order[new]
        rank = np.full(len(ids), -1, dtype=np.int64)
        rank[kept] = np.arange(len(kept))
        found = []
        for a, b, part, cuts in W.slices(data, offs, W.SMALL):
            got = runs(part, cuts, length, gram)
            got["doc"] = rank[got["doc"] + a]
            found.append(got)
        all_runs = {k: np.concatenate([g[k] for g in found]) for k in found[0]}
        known = all_runs["doc"] >= 0
        all_runs = {k: v[known] for k, v in all_runs.items()}
        order, new = _group_firsts(all_runs["first"], all_runs["doc"], all_runs["run"], all_runs["anchor"])
        same = np.ones(len(order), dtype=bool)
        same[:1] = False
        for k in ("anchor", "run"):
            v = all_runs[k][order]
            same[1:] &= v[1:] == v[:-1]
        spans = np.zeros(int(same.sum()), dtype=_SPAN)
        again = order[same]
        for k, v in (("doc", all_runs["doc"]), ("start", all_runs["first"]), ("size", all_runs["far"] - all_runs["near"] + length)):
            spans[k] = v[again]
        yield _sent(number % parts, number, ids[kept].tolist(), hashes[kept].tolist(), None, None, spans.tobytes(), None)
        order = order[~same]
        anchor = all_runs["anchor"][order]
        spread = W.mix(anchor + np.uint64(5))
        place = ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        body = np.zeros(len(order), dtype=_FIELDS)
        body["key"] = (spread & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for k in ("run", "doc", "first", "near", "far"):
            body[k] = all_runs[k][order]
        for k in ("left", "right"):
            body[k] = (all_runs[k][order] & np.uint64(0xFFFF)).astype(np.uint16)
        by = np.lexsort((body["doc"], place))
        body, bounds = body[by], np.searchsorted(place[by], np.arange(parts + 1))
        for p in range(parts):
            part = body[bounds[p] : bounds[p + 1]]
            if len(part):
                docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
                yield _sent(p, number, ids[kept][docs].tolist(), hashes[kept][docs].tolist(), docs.tolist(), _columns(part))

    return run


def _columns(rows: np.ndarray) -> bytes:
    """Field after field, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(rows[k]).tobytes() for k in rows.dtype.names)


def _rows(body: bytes) -> np.ndarray:
    n = len(body) // _FIELDS.itemsize
    out, at = np.zeros(n, dtype=_FIELDS), 0
    for k in _FIELDS.names:
        size = n * _FIELDS[k].itemsize
        out[k] = np.frombuffer(body[at : at + size], dtype=_FIELDS[k])
        at += size
    return out


def _match(length: int, gram: int):
    """All runs of some anchors: later copies of a run go, runs that may share a part with another stay open."""
    reach = (length - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(5)[i].is_valid:
                    body = _rows(batch.column(5)[i].as_py())
                    heads.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *(batch.column(k)[i].values.to_numpy() for k in (2, 3, 4))))
                    held.append(body)
                else:
                    yield batch.slice(i, 1)
        if not held:
            return
        source = np.repeat(np.arange(len(held)), [len(b) for b in held])
        body = np.concatenate(held)
        held.clear()
        base = np.cumsum([0] + [len(h[2]) for h in heads])[:-1]
        slot = base[source] + body["doc"]
        ids, hashes = np.concatenate([h[2] for h in heads]), np.concatenate([h[3] for h in heads])
        local = np.concatenate([h[4] for h in heads])
        order, new = _group_firsts(hashes, ids)
        doc_rank = np.empty(len(ids), dtype=np.int64)
        doc_rank[order] = np.cumsum(new) - 1
        key = body["key"].astype(np.uint64) | np.array([h[0] for h in heads], dtype=np.uint64)[source] << np.uint64(32)
        rank = doc_rank[slot]
        order = np.lexsort((body["first"], rank, body["run"], key))
        body, key, rank, slot, source = body[order], key[order], rank[order], slot[order], source[order]
        new_key = np.ones(len(key), dtype=bool)
        new_key[1:] = key[1:] != key[:-1]
        new_run = new_key.copy()
        new_run[1:] |= body["run"][1:] != body["run"][:-1]
        # the first place of each run; the same place may come from several batches
        head = np.flatnonzero(new_run)
        which = np.cumsum(new_run) - 1
        at_first = (rank == rank[head][which]) & (body["first"] == body["first"][head][which])
        size = body["far"].astype(np.int64) - body["near"] + length
        later = ~at_first
        # runs that may share a string with another run of their anchor
        group = np.cumsum(new_key) - 1
        several = np.bincount(group[head], minlength=group[-1] + 1)[group[head]] > 1
        h = head[several]
        left = body["far"][h] >= reach
        right = body["near"][h] <= length - gram - reach
        for flag, name in ((left, "left"), (right, "right")):
            twice = W.repeated(body[name][h].astype(np.uint64) + np.uint64(1), group[h])
            flag &= twice
        keep = left | right
        h, left, right = h[keep], left[keep], right[keep]
        # strings at least ``reach`` before the anchor hold its left surroundings, the others its right ones
        far, near = body["far"][h].astype(np.int64), body["near"][h].astype(np.int64)
        most = np.where(left, far, np.minimum(far, length - gram - reach))
        least = np.where(right, near, np.maximum(near, reach))
        fit = most >= least
        h, far, most, least = h[fit], far[fit], most[fit], least[fit]
        starts = body["first"][h] + far - most
        widths = most - least + length
        by = np.argsort(source, kind="stable")
        cuts = np.searchsorted(source[by], np.arange(len(heads) + 1))
        open_by = np.argsort(source[h], kind="stable")
        open_cuts = np.searchsorted(source[h][open_by], np.arange(len(heads) + 1))
        for k, (part, number, *_) in enumerate(heads):
            mine = by[cuts[k] : cuts[k + 1]]
            mine = mine[later[mine]]
            o = open_by[open_cuts[k] : open_cuts[k + 1]]
            yield _answer(part, number, local[slot[mine]], body["first"][mine], size[mine], local[slot[h[o]]], starts[o], widths[o], key[h[o]])

    return run


def _answer(part, number, doc, first, size, open_doc, starts, widths, key) -> pa.RecordBatch:
    spans = np.zeros(len(doc), dtype=_SPAN)
    spans["doc"], spans["start"], spans["size"] = doc, first, size
    open_ = np.zeros(len(open_doc), dtype=_OPEN)
    open_["doc"], open_["start"], open_["size"], open_["key"] = open_doc, starts, widths, key
    return _sent(part, number, None, None, None, None, spans.tobytes(), open_.tobytes())


def _united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, overlapping and touching ones as one, ascending."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # ends so far in the same document: shift each document above all before it
    lift = (doc - doc[0]) * (int(end.max()) + 2)
    high = np.maximum.accumulate(end + lift)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (start + lift)[1:] > high[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], high[last] - lift[head]


def _per_batch(table: pa.Table) -> pa.Table:
    """The answers to one batch: spans and open runs of each of its documents."""
    heads = [i for i, v in enumerate(table["ids"]) if v.is_valid]
    ids, hashes = table["ids"][heads[0]].values, table["hashes"][heads[0]].values
    spans = np.concatenate([np.frombuffer(b, dtype=_SPAN) for b in table["spans"].to_pylist() if b is not None])
    opened = [np.frombuffer(b, dtype=_OPEN) for b in table["open"].to_pylist() if b is not None]
    opened = np.concatenate(opened) if opened else np.zeros(0, dtype=_OPEN)
    doc, start, end = _united(spans["doc"].astype(np.int64), spans["start"].astype(np.int64), spans["start"].astype(np.int64) + spans["size"])
    opened = opened[np.argsort(opened["doc"], kind="stable")]
    n = len(ids)
    cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    open_cuts = np.searchsorted(opened["doc"], np.arange(n + 1)).astype(np.int32)
    columns = {
        "id": ids,
        "h": hashes,
        "starts": pa.ListArray.from_arrays(cuts, pa.array(start)),
        "ends": pa.ListArray.from_arrays(cuts, pa.array(end)),
    }
    open_cuts = pa.array(open_cuts)
    columns["open_at"] = pa.ListArray.from_arrays(open_cuts, pa.array(opened["start"].astype(np.int64)))
    columns["open_size"] = pa.ListArray.from_arrays(open_cuts, pa.array(opened["size"].astype(np.int64)))
    columns["open_key"] = pa.ListArray.from_arrays(open_cuts, pa.array(opened["key"].view(np.int64)))
    out = pa.table(columns)
    some = np.diff(np.asarray(cuts)) + np.diff(np.asarray(open_cuts)) > 0
    return out.filter(pa.array(some))


# --- transforms of shards, and their merge --------------------------------------------------------------------------


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a shard in the order of their first ``depth`` bytes (the shard read in a circle), by doubling."""
    n = len(text)
    around = np.concatenate([text, np.resize(text, 7)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | around[k : k + n]
    known = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        step = np.zeros(n, dtype=np.uint64)
        step[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(step, dtype=np.uint64)
        if known >= depth or (n and int(rank.max()) == n - 1):
            return order
        key = rank << np.uint64(32) | np.roll(rank, -known % n)
        known *= 2


def _symbols(text: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes before each place, in a circle, as one number."""
    out = np.zeros(len(text), dtype=np.int64)
    for k in range(width, 0, -1):
        out = out << 8 | np.roll(text, k)
    return out


def merge(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the shards' transforms: suffixes (places in all shards put together) by their first ``length`` bytes, and a number
    that is the same for suffixes that agree in them."""
    orders = [sorted_suffixes(s, length) for s in shards]
    sizes = [len(s) for s in shards]
    base = np.cumsum([0, *sizes])[:-1]
    places = np.concatenate([o + b for o, b in zip(orders, base, strict=True)])
    turn = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    together = np.zeros(len(turn), dtype=np.int32)
    # as many bytes at a step as make at most 2**16 different symbols, so that a step is one counting sort
    width = 3
    before = [_symbols(s, width) for s in shards]
    used = np.zeros(1 << 24, dtype=bool)
    for b in before:
        used[b] = True
    dense = np.cumsum(used, dtype=np.int32) - 1
    if dense[-1] >= 1 << 16:
        width, before = 2, [_symbols(s, 2) for s in shards]
        dense = np.arange(1 << 16, dtype=np.int32)
    steps = [width] * (length // width)
    transform = np.concatenate([dense[b[o]].astype(np.uint16) for b, o in zip(before, orders, strict=True)])
    single = np.concatenate([np.roll(s, 1)[o].astype(np.uint16) for s, o in zip(shards, orders, strict=True)])
    for bytes_ in steps + [1] * (length % width):
        symbol = np.empty(len(turn), dtype=np.uint16)
        symbol[np.argsort(turn, kind="stable")] = transform if bytes_ == width else single
        order = np.argsort(symbol, kind="stable")
        turn, together, symbol = turn[order], together[order], symbol[order]
        apart = np.zeros(len(turn), dtype=np.int32)
        apart[1:] = (symbol[1:] != symbol[:-1]) | (together[1:] != together[:-1])
        together = np.cumsum(apart, dtype=np.int32)
    out = np.empty(len(turn), dtype=np.int64)
    out[np.argsort(turn, kind="stable")] = places
    return out, together


def repeats(segments: list[bytes], doc: np.ndarray, start: np.ndarray, length: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes in the segments that an earlier (document, place) equals: document and place of each."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    text = np.frombuffer(bytes([_SEPARATOR]).join(segments) + bytes([_SEPARATOR]), dtype=np.uint8)
    at = np.cumsum(sizes + 1) - sizes - 1
    # where strings start, and their order of appearance
    counts = sizes - length + 1
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    value = np.full(len(text), -1, dtype=np.int64)
    value[np.repeat(at, counts) + within] = np.repeat(doc << 32 | start, counts) + within
    least = max(shard, -(-len(text) // 255))
    bounds, cuts = np.append(at, len(text)), [0]
    while cuts[-1] < len(text):
        i = int(np.searchsorted(bounds, cuts[-1] + least))
        cuts.append(int(bounds[min(i, len(bounds) - 1)]))
    places, together = merge([text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], length)
    seen = value[places]
    known = seen >= 0
    seen, together = seen[known], together[known]
    if not len(seen):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.ones(len(seen), dtype=bool)
    new[1:] = together[1:] != together[:-1]
    first = np.minimum.reduceat(seen, np.flatnonzero(new))
    later = np.sort(seen[seen != first[np.cumsum(new) - 1]])
    return later >> 32, later & 0xFFFFFFFF


# --- the whole --------------------------------------------------------------------------------------------------------


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Removed spans of documents ``id, h, text`` that have any: ``id``, ``h``, ``starts``, ``ends`` in bytes, ascending, apart."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(_scan(length, gram, parts), _SENT).repartition(parts, "part").mapInArrow(_match(length, gram), _SENT)
    lists = ", ".join(f"{k} array<long>" for k in ("starts", "ends", "open_at", "open_size", "open_key"))
    whole = written(dealt.groupBy("batch").applyInArrow(_per_batch, f"id long, h long, {lists}"), "runs")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.texts(batch.column(2))
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                text = data[offs[i] : offs[i + 1]]
                for a, n, k in zip(*(batch.column(c)[i].values.to_pylist() for c in (3, 4, 5)), strict=True):
                    rows.append((i, k % parts, k, a, text[a : a + n].tobytes()))
            if rows:
                i, part, key, a, body = zip(*rows, strict=True)
                at = pa.array(i)
                columns = [pa.array(part, pa.int32()), pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], _SEGMENTS.names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), _SEGMENTS).sort_by("key")
        if not table.num_rows:
            return
        ids, hashes = table["id"].to_numpy(), table["h"].to_numpy()
        order, new = _group_firsts(hashes, ids)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        start = table["start"].to_numpy()
        # anchors have nothing to do with each other: some of them at a time
        key = table["key"].to_numpy()
        heads = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
        size = np.concatenate([[0], np.cumsum(pc.binary_length(table["body"]).to_numpy())])[heads]
        cuts, found = [0], []
        while cuts[-1] < len(heads) - 1:
            cuts.append(min(max(int(np.searchsorted(size, size[cuts[-1]] + MERGED)), cuts[-1] + 1), len(heads) - 1))
        for a, b in zip(heads[cuts[:-1]], heads[cuts[1:]], strict=True):
            found.append(repeats(table["body"][a:b].to_pylist(), rank[a:b], start[a:b], length))
        doc, place = (np.concatenate(c) for c in zip(*found, strict=True))
        doc, start, end = _united(doc, place, place + length)
        one = order[new]
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        lists = pa.array(np.append(cuts, len(doc)).astype(np.int32))
        owner = one[doc[cuts]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[owner]), pa.array(hashes[owner]), pa.ListArray.from_arrays(lists, pa.array(start)), pa.ListArray.from_arrays(lists, pa.array(end))],
            ["id", "h", "starts", "ends"],
        )

    opened = whole.where("size(open_at) > 0").select("id", "h", "open_at", "open_size", "open_key")
    texts = docs.join(opened, ["id", "h"]).select("id", "h", "text", "open_at", "open_size", "open_key")
    pieces = texts.mapInArrow(segments, "id long, h long, part int, key long, start long, body binary").repartition(parts, "part")
    edges = pieces.mapInArrow(solve, "id long, h long, starts array<long>, ends array<long>")
    every = whole.where("size(starts) > 0").select("id", "h", "starts", "ends").unionByName(edges)
    return every.groupBy("id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


_SEGMENTS = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("part", pa.int32()), ("key", pa.int64()), ("start", pa.int64()), ("body", pa.binary())])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: its id, ``n_bytes``, ``n_removed``, ``starts`` and ``ends`` of the removed spans (bytes), ``kept`` (binary)."""
    rows = keyed(docs, id_col, text_col)
    found = spans(rows, length, gram)
    joined = rows.join(found, ["id", "h"], "left").select("id", "text", "starts", "ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            kept, removed, all_starts, all_ends = [], [], [], []
            for i in range(batch.num_rows):
                text = data[offs[i] : offs[i + 1]]
                if not batch.column(2)[i].is_valid:
                    kept.append(text.tobytes())
                    removed.append(0)
                    all_starts.append([])
                    all_ends.append([])
                    continue
                start, end = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                _, start, end = _united(np.zeros(len(start), dtype=np.int64), start, end)
                edge = np.zeros(len(text) + 1, dtype=np.int8)
                edge[start] += 1
                edge[end] -= 1
                kept.append(text[np.cumsum(edge[:-1]) == 0].tobytes())
                removed.append(int((end - start).sum()))
                all_starts.append(start)
                all_ends.append(end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(all_starts, longs), pa.array(all_ends, longs), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "starts", "ends", "kept"],
            )

    out = joined.mapInArrow(cut, "id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary")
    kind = docs.schema[id_col].dataType
    return out.withColumn("id", F.when(F.col("id") > -(1 << 63), F.col("id")).cast(kind)).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with every text cut; a character goes if all its bytes do, so texts stay valid. Null texts stay null."""
    # names that no column of the caller has
    fresh = {c: f"_{uuid.uuid4().hex}_{c}" for c in ("id", "h", "starts", "ends")}
    found = spans(keyed(docs, id_col, text_col), length, gram).select(*(F.col(c).alias(name) for c, name in fresh.items()))
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) == F.col(fresh["id"]), F.xxhash64(F.coalesce(text_col, F.lit(""))) == F.col(fresh["h"])]
    joined = docs.join(found, own, "left").drop(fresh["id"], fresh["h"])

    def rewrite(batch: pa.RecordBatch) -> pa.Array:
        data, offs = W.texts(batch.column(0))
        gone = np.zeros(len(data) + 1, dtype=np.int32)
        starts, ends = batch.column(1), batch.column(2)
        owner = np.repeat(offs[:-1], [len(v) if v.is_valid else 0 for v in starts])
        np.add.at(gone, owner + starts.flatten().to_numpy(zero_copy_only=False), 1)
        np.add.at(gone, owner + ends.flatten().to_numpy(zero_copy_only=False), -1)
        keep = np.cumsum(gone[:-1]) == 0
        # a character with a kept byte is kept
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead):
            whole = np.maximum.reduceat(keep, lead)
            keep = np.repeat(whole, np.diff(np.append(lead, len(data))))
        cuts = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(keep, out=cuts[1:])
        body = np.ascontiguousarray(data[keep])
        text = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(cuts[offs]), pa.py_buffer(body))
        text = text.cast(pa.string())
        return pa.array(text.to_pylist(), pa.string(), mask=np.asarray(batch.column(0).is_null())) if batch.column(0).null_count else text

    return rewritten(joined, text_col, [fresh["starts"], fresh["ends"]], rewrite)


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated bytes of every whole text of ``documents``."""
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later),
grouped AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM grouped GROUP BY doc_id, g),
pieces AS (SELECT doc_id, a, b, substr(h, 2 * prior - 1, 2 * (a - prior)) AS p
    FROM (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS prior FROM spans) JOIN d USING (doc_id)),
cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n_spans, string_agg(p, '' ORDER BY a) AS front, max(b) AS rest FROM pieces GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(rest, 1) - 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
