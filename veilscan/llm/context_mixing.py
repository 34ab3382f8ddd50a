"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A word is coded as ``BITS`` binary decisions, the bits of its class (a hash of the word), and then as itself within its
class. Each bit is predicted by several tables of counts, looked up by a hash of a context and of the bits
so far: no context, the word before, the two words before, the last short word, and what the text itself has
shown. The predictions, as logits, are mixed with weights that the position of the bit selects; the mixed
probability is refined by an adaptive map. Weights, map and the text's own counts are adapted along each text, after its first,
second, fourth and eighth word and then every ``RUN`` words, starting anew with every text, so a score depends on the text and the
tables alone. First weights and first map are learned: one training text of ``SHARE``, picked by its content, is mixed with what
the other training texts say (Newton steps on the summed gradients, then the map), before its own counts are added to the tables.
Within a class, a word has (c + 1) / (C + V + 1), with c its count and C, V the class's counts and distinct words; the rest
is for words never seen. The sum over the text, in bits per byte or as log10, is a proper probability.

What is gathered from the corpus: exact counts of every word (summed per task, then by Spark, written as a table that
grows with the corpus), and the context tables (fixed size, summed from every task over all training text). Words are looked
up in two ways: the most frequent, at most ``TIER``, go with the tasks (16 bytes each, so the broadcast is bounded); all
other words are joined with the table of counts, of each text only its distinct rare words.

Words are 64-bit hashes; two of n words share one with probability near n**2 / 2**65.

Defined results: null counts as the empty text, which has the end token alone; rows that repeat are scored each and learned
from each; rows of one id are told apart; a null id is learned from; without training rows every count is 0; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import words as W
from veilscan.llm.shared import written

BITS = 12
NODES = 1 << BITS
#: Slots of the context tables: none, the word before, two words before, the last short word.
SLOTS = (NODES, 1 << 18, 1 << 18, 1 << 18)
#: A word of so few bytes counts as short.
SHORT = 3
#: Words between two adaptations, at most.
RUN = 8
#: Words that go with the tasks at most.
TIER = 1 << 20
#: Words whose counts a task holds before it hands them over.
HELD = 1 << 19
#: Texts mixed side by side, and bytes of texts that are put side by side by size: the more of them, the fewer runs.
WIDE, MIXED = 512, 1 << 23
#: Weights of the five predictions before any text is seen, step of their adaptation, strength of the map's values.
WEIGHTS = (0.15, 0.15, 0.1, 0.45, 0.35)
RATE, MAP_STRENGTH = 0.002, 30.0
#: One of so many training texts teaches weights and map, in so many steps; what WEIGHTS count against it.
SHARE, STEPS, PRIOR = 16, 2, 50.0
_GRID = np.linspace(-8, 8, 33).astype(np.float32)
_END = np.uint64(0xC2B2AE3D27D4EB4F)
_CELLS = 4096


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of each text of a slice with the end token, where each text's tokens start, and which are short."""
    data = W.lower(data)
    starts, ends, firsts = W.spans(data, offs)
    hashes = np.insert(W.word_hashes(data, starts, ends), firsts[1:], _END)
    short = np.insert(ends - starts <= SHORT, firsts[1:], False)
    return hashes, firsts + np.arange(len(firsts)), short


def _pieced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of a large slice, a small part of it in memory at a time."""
    found = [tokens(part, where) for _, _, part, where in W.slices(data, offs, W.SMALL)]
    sizes = np.concatenate([np.zeros(1, dtype=np.int64), *(np.diff(at) for _, at, _ in found)])
    return np.concatenate([h for h, _, _ in found]), np.cumsum(sizes), np.concatenate([s for _, _, s in found])


def contexts(hashes: np.ndarray, at: np.ndarray, short: np.ndarray) -> list[np.ndarray]:
    """A 64-bit value per token for each of the three contexts; the start of a text is a context of its own."""
    place = np.arange(len(hashes))
    first = np.repeat(at[:-1], np.diff(at))
    before = np.where(place > first, np.roll(hashes, 1), np.uint64(1))
    twice = np.where(place > first + 1, np.roll(hashes, 2), np.uint64(2))
    last = np.maximum.accumulate(np.where(short, place, -1))
    last = np.concatenate([[-1], last[:-1]])[: len(place)]
    word = np.where(last >= first, hashes[last], np.uint64(3))
    return [W.mix(before + np.uint64(11)), W.mix(before * np.uint64(3) + W.mix(twice)), W.mix(word + np.uint64(13))]


def slots(classes: np.ndarray, ctx: list[np.ndarray]) -> list[np.ndarray]:
    """Slots of the four tables for each bit of each token, the bits along the last axis but one; those of the first are the nodes."""
    down = np.arange(BITS, 0, -1, dtype=np.int32)[:, None]
    classes, ctx = classes[..., None, :], [c[..., None, :] for c in ctx]
    nodes = (np.int32(NODES) >> down) | (classes >> down)
    spread = nodes * np.int32(40503)
    spread ^= spread >> 9
    out = [nodes]
    for table in (1, 2):
        out.append((ctx[table - 1].astype(np.uint32).view(np.int32) ^ spread) & np.int32(SLOTS[table] - 1))
    out.append(((ctx[2] >> np.uint64(58)).astype(np.int32) << BITS) | nodes)
    return out


def class_bits(classes: np.ndarray) -> np.ndarray:
    """The bits of each class, along the last axis but one."""
    return ((classes[..., None, :] >> np.arange(BITS - 1, -1, -1, dtype=np.int32)[:, None]) & np.int32(1)).astype(bool)


@dataclass
class Tables:
    """What the corpus says: logits of the context tables, counts of classes and of frequent words."""

    logits: list[np.ndarray]
    chances: np.ndarray
    class_mass: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    complete: bool
    total: int
    distinct: int
    #: First weights (predictions x bits) and first map (bits x grid); None: WEIGHTS and the identity.
    weights: np.ndarray | None = None
    curve: np.ndarray | None = None

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        weights = np.tile(np.array(WEIGHTS)[:, None], (1, BITS)) if self.weights is None else self.weights
        curve = np.tile(1 / (1 + np.exp(-_GRID)), (BITS, 1)) if self.curve is None else self.curve
        return weights.astype(np.float32), curve.astype(np.float32)


def logits_of(zeros: np.ndarray, ones: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Logits of all tables from summed counts; the tables of single contexts lean on the one without context where they can."""
    cuts = np.cumsum((0, *SLOTS))
    parts = [(zeros[a:b].astype(np.float64), ones[a:b].astype(np.float64)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    chance = (parts[0][1] + 0.4) / (parts[0][0] + parts[0][1] + 0.8)
    out = [np.log(chance / (1 - chance))]
    for z, o in parts[1:3]:
        p = (o + 0.4) / (z + o + 0.8)
        out.append(np.log(p / (1 - p)))
    z, o = parts[3]
    p = (o + 2 * np.tile(chance, SLOTS[3] // NODES)) / (z + o + 2)
    out.append(np.log(p / (1 - p)))
    return [x.astype(np.float32) for x in out], chance.astype(np.float32)


def mix_texts(tables: Tables, hashes: np.ndarray, at: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Natural log of the probability of all class bits of each text."""
    out = np.zeros(len(at) - 1)
    for group, classes, ctx, first, sizes in _groups(hashes, at, short):
        out[group] = _mix_group(tables, classes, ctx, first, sizes)
    return out


def _groups(hashes: np.ndarray, at: np.ndarray, short: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Numbers of the texts that go side by side, classes and contexts of all tokens, first token and size of each of these texts."""
    classes = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
    ctx = contexts(hashes, at, short)
    sizes = np.diff(at)
    order = np.argsort(sizes, kind="stable")
    for k in range(0, len(order), WIDE):
        group = order[k : k + WIDE]
        yield group, classes, ctx, at[:-1][group], sizes[group]


def _runs(
    tables: Tables, classes: np.ndarray, ctx: list[np.ndarray], first: np.ndarray, sizes: np.ndarray
) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Texts side by side, ascending by size, some words at a time: the first text that goes on, the five logits, the bits, which are words.

    The texts' own counts are adapted between runs. Axes are words, bits, texts, so that steps go over neighbouring texts.
    """
    texts = len(first)
    # bits seen in the upper half, ones among them in the lower half
    seen = np.zeros(NODES * texts, dtype=np.int64)
    start, longest = 0, int(sizes.max(initial=0))
    while start < longest:
        run = min(RUN, max(1, start))
        live = int(np.searchsorted(sizes, start, "right"))
        words = start + np.arange(run)[:, None]
        place = first[live:] + np.minimum(words, sizes[live:] - 1)
        mask = words < sizes[live:]
        own = classes[place]
        where = slots(own, [c[place] for c in ctx])
        bit = class_bits(own)
        cell = where[0] * np.int64(texts) + np.arange(live, texts)
        both = seen.take(cell)
        chance = ((both & 0xFFFFFFFF).astype(np.float32) + (2 * tables.chances).take(where[0])) / ((both >> 32).astype(np.float32) + 2)
        inputs = [t.take(w) for t, w in zip(tables.logits, where, strict=True)]
        inputs.append(np.log(chance / (1 - chance)))
        yield live, inputs, bit, mask
        step = bit.astype(np.int64)
        step += 1 << 32
        step *= mask[:, None, :]
        np.add.at(seen, cell.reshape(-1), step.reshape(-1))
        start += run


def _squash(inputs: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed logits, their probabilities, and the place in the map: point below and the part of the way to the next."""
    z = sum(x * w for x, w in zip(inputs, weights, strict=True))
    np.clip(z, -7.99, 7.99, out=z)
    step = (z + 8) * 2
    below = np.floor(step)
    return z, 1 / (1 + np.exp(-z)), below.astype(np.int32), step - below


def _mix_group(tables: Tables, classes: np.ndarray, ctx: list[np.ndarray], first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts side by side, ascending by size, with weights and a map for each."""
    texts = len(first)
    total = np.zeros(texts)
    weights, curve = tables.first()
    weights = np.repeat(weights[:, :, None], texts, axis=2)
    # points of the map, bits, texts
    flat = np.repeat(curve.T.reshape(-1), texts)
    point = BITS * texts
    for live, inputs, bit, mask in _runs(tables, classes, ctx, first, sizes):
        _, p, low, part = _squash(inputs, [w[:, live:] for w in weights])
        # the adaptive map: what bits turned out to be at such a probability
        entry = low * np.int64(point) + (np.arange(BITS)[:, None] * texts + np.arange(live, texts))
        mapped = flat.take(entry) * (1 - part) + flat.take(entry + point) * part
        final = 0.5 * (p + mapped)
        logs = np.log(np.where(bit, final, 1 - final))
        total[live:] += (logs.sum(axis=1, dtype=np.float64) * mask).sum(axis=0)
        # adapt
        miss = (bit - p) * mask[:, None, :]
        for x, w in zip(inputs, weights, strict=True):
            w[:, live:] += RATE * (miss * x).sum(axis=0)
        entry += point * (part > 0.5)
        # an entry that several bits of a run meet moves by the sum of their steps, at most RUN / (MAP_STRENGTH + 1) of the way
        move = ((bit - flat.take(entry)) / (MAP_STRENGTH + 1)).astype(np.float32) * mask[:, None, :]
        np.add.at(flat, entry.reshape(-1), move.reshape(-1))
    return total


# --- what the corpus says ---------------------------------------------------------------------------------------


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([c for _, c in held])).astype(np.int64)


def _gather(docs: DataFrame) -> DataFrame:
    """Per task: words with counts (``block`` -1), and cells of the context tables in blocks."""
    size = sum(SLOTS)
    cuts = np.cumsum((0, *SLOTS))
    names = ["block", "h", "c", "body"]

    def words(held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        n = len(held[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, -1, np.int32)), pa.array(held[0].view(np.int64)), pa.array(held[1]), pa.nulls(n, pa.binary())], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((2, size), dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            data, offs = W.texts(batch.column(0))
            for _, _, part, where in W.slices(data, offs):
                hashes, at, short = tokens(part, where)
                held.append(np.unique(hashes, return_counts=True))
                if sum(len(h) for h, _ in held) > 2 * HELD:
                    held = [_merge(held)]
                    if len(held[0][0]) > HELD:
                        yield words(held.pop())
                classes = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
                found = slots(classes, contexts(hashes, at, short))
                bit = class_bits(classes)
                for k, slot in enumerate(found):
                    # zeros and ones of a slot next to each other
                    cells[:, cuts[k] : cuts[k + 1]] += np.bincount((slot << 1 | bit).reshape(-1), minlength=2 * SLOTS[k]).reshape(-1, 2).T
        if held:
            yield words(_merge(held))
        for block in range(0, size, _CELLS):
            part = cells[:, block : block + _CELLS]
            if part.any():
                one = [pa.array([block // _CELLS], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
                yield pa.RecordBatch.from_arrays([*one, pa.array([part.astype(np.int64).tobytes()], pa.binary())], names)

    return docs.select("text").mapInArrow(run, "block int, h long, c long, body binary")


def _summed(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all tasks, added up; what reaches the driver has the size of the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(body, dtype=np.int64)
                held[block] = held[block] + cells if block in held else cells
        if held:
            bodies = pa.array([b.tobytes() for b in held.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), bodies], ["block", "body"])

    parts = max(1, min(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(SLOTS) // _CELLS))
    table = blocks.select("block", "body").repartition(parts, "block").mapInArrow(run, "block int, body binary").toArrow()
    cells = np.zeros((2, sum(SLOTS)), dtype=np.int64)
    for block, body in zip(table["block"].to_pylist(), table["body"].to_pylist(), strict=True):
        part = np.frombuffer(body, dtype=np.int64).reshape(2, -1)
        cells[:, block * _CELLS : block * _CELLS + part.shape[1]] += part
    return cells[0], cells[1]


def _lessons(docs: DataFrame, tables: Tables) -> np.ndarray:
    """Sums over all texts, per bit: gradient and curvature of the weights, bits and ones at each point of the map."""
    n, grid = len(WEIGHTS), len(_GRID)
    size = BITS * (n + n * n + 2 * grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, bend, points = np.zeros((BITS, n)), np.zeros((BITS, n, n)), np.zeros((2, BITS * grid))
        weights, _ = tables.first()
        for batch in batches:
            data, offs = W.texts(batch.column(0))
            for _, _, part, where in W.slices(data, offs, MIXED):
                for _, *group in _groups(*_pieced(part, where)):
                    for _, inputs, bit, mask in _runs(tables, *group):
                        _, p, low, way = _squash(inputs, [w[:, None] for w in weights])
                        # of each bit, the words of all texts one after another
                        flat = np.stack(inputs).transpose(2, 0, 1, 3)[:, :, mask].astype(np.float64)
                        bit, p = bit.transpose(1, 0, 2)[:, mask], p.transpose(1, 0, 2)[:, mask].astype(np.float64)
                        slope += np.einsum("bik,bk->bi", flat, bit - p)
                        bend += (flat * (p * (1 - p))[:, None, :]) @ flat.transpose(0, 2, 1)
                        near = (np.arange(BITS)[:, None] * grid + (low + (way > 0.5)).transpose(1, 0, 2)[:, mask]).reshape(-1)
                        points[0] += np.bincount(near, minlength=BITS * grid)
                        points[1] += np.bincount(near, weights=bit.reshape(-1), minlength=BITS * grid)
        sums = np.concatenate([slope.reshape(-1), bend.reshape(-1), points.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(sums)], ["k", "v"])

    table = docs.select("text").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[table["k"].to_numpy()] = table["v"].to_numpy()
    return out


def _taught(docs: DataFrame, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """First weights and first map, from texts that the tables have not seen."""
    n, grid = len(WEIGHTS), len(_GRID)
    for _ in range(STEPS):
        sums = _lessons(docs, tables)
        slope, bend = sums[: BITS * n].reshape(BITS, n), sums[BITS * n : BITS * (n + n * n)].reshape(BITS, n, n)
        weights = tables.first()[0].T.astype(np.float64)
        pull = slope - PRIOR * (weights - np.array(WEIGHTS))
        weights = weights + np.linalg.solve(bend + PRIOR * np.eye(n), pull[:, :, None])[:, :, 0]
        # sums of floats depend on their order in the last digits
        tables = replace(tables, weights=np.round(weights.T, 5))
    points = _lessons(docs, tables)[BITS * (n + n * n) :].reshape(2, BITS, grid)
    identity = 1 / (1 + np.exp(-_GRID.astype(np.float64)))
    return tables.first()[0], (points[1] + MAP_STRENGTH * identity) / (points[0] + MAP_STRENGTH)


def learn(docs: DataFrame, text_col: str = "text") -> tuple[Tables, DataFrame]:
    """Tables for the tasks, and the counts of all words (``h``, ``c``)."""
    texts = docs.select(F.col(text_col).alias("text"))
    # by content, so that copies are on one side
    teaches = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0, F.lit(False))
    others, teachers = texts.where(~teaches), texts.where(teaches)
    parts = [_gather(part).withColumn("teaches", F.lit(flag)) for part, flag in ((others, False), (teachers, True))]
    gathered = written(parts[0].unionByName(parts[1]), "gathered")
    counts = written(gathered.where("block = -1").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    cells = [np.stack(_summed(gathered.where("block >= 0").where(F.col("teaches") == flag))) for flag in (False, True)]
    none = np.zeros(0, dtype=np.uint64)
    weights, curve = _taught(teachers, Tables(*logits_of(*cells[0]), np.ones(NODES), none, none.view(np.int64), True, 0, 0))
    logits, chances = logits_of(*(cells[0] + cells[1]))
    classes = counts.groupBy(F.shiftrightunsigned("h", 64 - BITS).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    mass = np.ones(NODES)
    mass[classes["k"].to_numpy()] += classes["c"].to_numpy() + classes["v"].to_numpy()
    sizes = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).agg(F.count("*").alias("v")).collect()
    # the most frequent words, by powers of two of the count, as far as they fit
    floor, room = 64, TIER
    for row in sorted(sizes, reverse=True):
        room -= row["v"]
        if room < 0:
            break
        floor = row["k"]
    tier = counts.where(F.floor(F.log2("c")) >= floor).toArrow().sort_by("h")
    words = tier["h"].to_numpy().view(np.uint64)
    order = np.argsort(words, kind="stable")
    total, distinct = int(sum(classes["c"].to_pylist())), int(sum(classes["v"].to_pylist()))
    return Tables(logits, chances, mass, words[order], tier["c"].to_numpy()[order], len(words) == distinct, total, distinct, weights, curve), counts


# --- scores -----------------------------------------------------------------------------------------------------


def _score_tasks(docs: DataFrame, tables: Tables) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()
    names = ["row", "id", "n_tokens", "n_bytes", "known", "top", "bottom", "bits", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, end, part, where in W.slices(data, offs, MIXED):
                hashes, at, short = _pieced(part, where)
                n = end - first
                bits = mix_texts(tables, hashes, at, short) / np.log(10)
                own = np.repeat(np.arange(n), np.diff(at))
                unique, back = np.unique(hashes, return_inverse=True)
                count = np.zeros(len(unique), dtype=np.int64)
                if len(tables.words):
                    place = np.minimum(np.searchsorted(tables.words, unique), len(tables.words) - 1)
                    count = np.where(tables.words[place] == unique, tables.counts[place], 0)
                count = count[back]
                classes = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
                # words that are not with the task, once per text
                rest = np.flatnonzero(count == 0) if not tables.complete else np.zeros(0, dtype=np.int64)
                order = rest[np.lexsort((hashes[rest], own[rest]))]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (own[order][1:] != own[order][:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(order)))
                cuts = pa.array(np.searchsorted(own[order][start], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        batch.column(0)[first:end],
                        pa.array(np.diff(at)),
                        pa.array(np.diff(where)),
                        pa.array(np.bincount(own, weights=count > 0, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(own, weights=np.log10(count + 1), minlength=n)),
                        pa.array(np.bincount(own, weights=np.log10(tables.class_mass[classes]), minlength=n)),
                        pa.array(bits),
                        pa.ListArray.from_arrays(cuts, pa.array(hashes[order][start].view(np.int64))),
                        pa.ListArray.from_arrays(cuts, pa.array(times)),
                    ],
                    names,
                )
                row += n

    fields = f"row long, id {kind}, n_tokens long, n_bytes long, known long, top double, bottom double, bits double, rare array<long>, times array<long>"
    return docs.mapInArrow(run, fields)


def score(docs: DataFrame, tables: Tables, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``n_known``, ``base_score`` (word counts alone), ``score`` (log10) and ``bits_per_byte``."""
    scored = written(_score_tasks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tables), "scored")
    rows = scored.drop("rare", "times")
    if tables.complete:
        full = rows.withColumns({"more": F.lit(0), "also": F.lit(0.0)})
    else:
        rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("row", F.col("z.rare").alias("h"), F.col("z.times").alias("t"))
        found = rare.join(counts, "h").groupBy("row").agg(F.sum("t").alias("more"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("also"))
        full = rows.join(found, "row", "left").fillna({"more": 0, "also": 0.0})
    top = F.col("top") + F.col("also")
    value = F.col("bits") + top - F.col("bottom")
    base = top - F.col("n_tokens") * float(np.log10(tables.total + tables.distinct + 1))
    return full.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.col("more")).alias("n_known"),
        base.alias("base_score"),
        value.alias("score"),
        (-value * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``, learned from those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out: Column = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    tables, counts = learn(docs.where(~held_out))
    return score(docs, tables, counts).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tables.total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte"
    )
