"""N-gram Jaccard self-join through a token-group matrix.

A document is the set of its word shingles. Similar documents are put into groups, the matrix says which tokens the
members of each group have between them, and a document is held against the members of a group only if enough of
its tokens are in the group's union. All links are found, whatever the data:

1. **Sets that can't link** leave first. A set of n tokens has a partner only if at least ``ceil(share * n)`` of its
   tokens occur in another set, so n - ceil(share * n) + 1 tokens that no other row has rule it out. Half of the token
   universe (by hash) is counted for this: every batch sends each of its tokens once to the task of that hash range,
   merged over its rows, so a token in a third of all rows travels once per batch; the answer comes back as
   counts per row. Rows with equal sets (copies) are one set from then on.
2. **Groups.** Of the rest, sets that share a minimum under one of a few hash functions are checked against the one
   of them that shares most minima with other sets; linked ones get its label. Members of a group are connected, so pairs inside are of no interest.
3. **Matrix.** Tokens are ordered by how many sets have them, rarest first. Two linking sets share at least L tokens
   among the first ``n - ceil(share * n) + L`` of each. The matrix holds those tokens and the groups that have
   them; tokens of one group alone are left out.
4. **Bound and opening.** For a set and another group, the set's tokens in the group's union are counted; only
   from L on (or its whole requirement, if smaller) the group is opened: members whose size and sketch allow a
   link (a lower bound of the tokens that only one of the two has) are compared token by token. Of two groups, the members of the smaller one ask.

Components of all links give the result. Tokens are 64-bit hashes of word hashes; two different shingles of one pair of
texts share one with probability near 2**-64 per pair of shingles. Equal sets are found by 128 bits of sums.

Defined results: null and empty texts, and texts without words, have no tokens and link with nothing, their
component is their own id; rows that share an id count as one document with that id; a null id stays null and only takes
the component of equal texts; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import words as W
from veilscan.llm.components import components
from veilscan.llm.shared import written

SHINGLE = 5
SHARE = Fraction(80, 100)
#: Tokens that must be shared before a group is opened, and hash functions that propose groups.
LEAST, HASHES = 3, 12
#: 64-bit words of a set's sketch.
SKETCH = 16


def token_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a slice, ascending: tokens, and where each text's tokens start."""
    data = W.lower(data)
    starts, ends, firsts = W.spans(data, offs)
    hashes = W.word_hashes(data, starts, ends)
    counts = np.diff(firsts)
    owner = W.owners(firsts)
    grams = W.grams(hashes, size)
    at = np.flatnonzero(W.inside(firsts, size)[: len(grams)])
    tokens, texts = grams[at], owner[at]
    # fewer words than a shingle: the whole sequence is the one token
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            tokens = np.concatenate([tokens, W.grams(hashes, n)[firsts[short]]])
            texts = np.concatenate([texts, short])
    order = np.lexsort((tokens, texts))
    tokens, texts = tokens[order], texts[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (texts[1:] != texts[:-1])
    tokens, texts = tokens[new], texts[new]
    return tokens, np.searchsorted(texts, np.arange(len(counts) + 1))


def _pieced(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``token_sets`` of a large slice, a small part of it in memory at a time."""
    tokens, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
    for _, _, part, cuts in W.slices(data, offs, W.SMALL):
        got, at = token_sets(part, cuts, size)
        tokens.append(got)
        counts.append(np.diff(at))
    return np.concatenate(tokens), np.cumsum(np.concatenate(counts))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=run[1:])
    return run[cuts[1:]] - run[cuts[:-1]]


def _need(n: np.ndarray, share: Fraction) -> np.ndarray:
    """The fewest tokens that a set of n shares with a partner."""
    return -(-n * share.numerator // share.denominator)


def facts(docs: DataFrame, size: int, share: Fraction) -> DataFrame:
    """Per row ``id``, ``n`` tokens, ``s1``, ``s2`` (equal for equal sets) and ``alone``: it can have no partner."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["id"].dataType.simpleString()
    fields = f"part int, batch long, ids array<{kind}>, ns array<long>, s1 array<long>, s2 array<long>, tokens binary, rows binary"
    names = ["part", "batch", "ids", "ns", "s1", "s2", "tokens", "rows"]
    halves = np.uint64(1) << np.uint64(63)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, end, part, cuts in W.slices(data, offs, 1 << 24):
                got, at = _pieced(part, cuts, size)
                n = np.diff(at)
                spread = W.mix(got)
                sums = [_sums(W.mix(got + np.uint64(k)), at).view(np.int64).tolist() for k in (1, 2)]
                ids = batch.column(0)[first:end]
                yield _record([[number % parts], [number], [ids.to_pylist()], [n.tolist()], [sums[0]], [sums[1]], [b""], [b""]], ids.type)
                row = np.repeat(np.arange(len(n)), n)
                low = spread < halves
                key, row = spread[low], row[low]
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = key[1:] != key[:-1]
                many = np.zeros(len(key), dtype=bool)
                many[:-1] |= ~new[1:]
                # a token once per batch; with its row if that is the only one, which the order of rows says
                key, row, many = key[new], row[new], many[new]
                place = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)
                low32 = (W.mix(key) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                bounds = np.searchsorted(place, np.arange(parts + 1))
                for p in range(parts):
                    a, b = bounds[p], bounds[p + 1]
                    if a < b:
                        rows = np.where(many[a:b], len(n), row[a:b]).astype(np.uint16 if len(n) < 65535 else np.uint32)
                        order = np.argsort(rows, kind="stable")
                        packed = low32[a:b][order].tobytes()
                        counts = np.bincount(rows, minlength=len(n) + 1).astype(np.uint32)
                        yield _record([[p], [number], [None], [None], [None], [None], [packed], [_sparse(counts)]], ids.type)
                number += 1

    def _record(values: list, id_type: pa.DataType) -> pa.RecordBatch:
        longs = pa.list_(pa.int64())
        types = [pa.int32(), pa.int64(), pa.list_(id_type), longs, longs, longs, pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All tokens of some hash ranges: which of them one row alone has."""
        parts_of, batch_of, keys, lone = [], [], [], []
        for batch in batches:
            own = np.array([n is None for n in batch.column(2).to_pylist()], dtype=bool)
            if (~own).any():
                yield batch.filter(pa.array(~own))
            for i in np.flatnonzero(own):
                part = batch.column(0)[i].as_py()
                low = np.frombuffer(batch.column(6)[i].as_py(), dtype=np.uint32).astype(np.uint64)
                keys.append(low | np.uint64(part) << np.uint64(32))
                rows, counts = _dense(batch.column(7)[i].as_py())
                lone.append(np.repeat(rows, counts).astype(np.uint32))
                parts_of.append(part)
                batch_of.append(batch.column(1)[i].as_py())
        if not keys:
            return
        sizes = [len(k) for k in keys]
        every = np.concatenate(keys)
        keys.clear()
        order = np.argsort(every, kind="stable")
        found = every[order]
        same = found[1:] == found[:-1]
        shared = np.zeros(len(every), dtype=bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        at = 0
        for part, number, size_, rows in zip(parts_of, batch_of, sizes, lone, strict=True):
            single = rows[~shared[at : at + size_]]
            at += size_
            counts = np.bincount(single).astype(np.uint32)
            yield _record([[part], [number], [None], [None], [None], [None], [b""], [_sparse(counts)]], id_type)

    def judge(table: pa.Table) -> pa.Table:
        """One batch: the answers of all ranges, added up per row."""
        whole = np.array([n is not None for n in table["ids"].to_pylist()], dtype=bool)
        head = table.filter(pa.array(whole))
        n = np.array(head["ns"][0].as_py(), dtype=np.int64)
        single = np.zeros(len(n) + 1, dtype=np.int64)
        for packed in table.filter(pa.array(~whole))["rows"].to_pylist():
            rows, counts = _dense(packed)
            single[rows] += counts
        alone = single[: len(n)] >= n - _need(n, share) + 1
        return pa.table([head["ids"][0].values, pa.array(n), head["s1"][0].values, head["s2"][0].values, pa.array(alone)], ["id", "n", "s1", "s2", "alone"])

    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    sent = docs.select("id", "text").mapInArrow(scan, fields).repartition(parts, "part")
    return sent.mapInArrow(count, fields).groupBy("batch").applyInArrow(judge, f"id {kind}, n long, s1 long, s2 long, alone boolean")


def _sparse(counts: np.ndarray) -> bytes:
    """Rows with a count, and the counts; ``_dense`` gives both back."""
    rows = np.flatnonzero(counts).astype(np.uint32)
    return np.concatenate([rows, counts[rows].astype(np.uint32)]).tobytes()


def _dense(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, dtype=np.uint32).astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _tokens(docs: DataFrame, size: int, hashes: int) -> DataFrame:
    """``id, n, tokens`` (ascending array), ``mins`` (the smallest value of each hash function) and ``sketch``.

    The sketch holds for each of its bits whether an odd number of tokens falls on it. Two sketches differ in at most
    as many bits as tokens are in one set alone.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, end, part, cuts in W.slices(data, offs, W.SMALL):
                got, at = token_sets(part, cuts, size)
                full = np.flatnonzero(np.diff(at) > 0)
                mins = np.stack([np.minimum.reduceat(W.mix(got + np.uint64(k + 11)), at[full]) for k in range(hashes)], axis=1) if len(full) else got
                ids = batch.column(0)[first:end].take(pa.array(full))
                arrays = [
                    ids,
                    pa.array(np.diff(at)[full]),
                    pa.ListArray.from_arrays(pa.array(np.append(at[full], len(got)).astype(np.int32)), pa.array(got.view(np.int64))),
                    pa.FixedSizeListArray.from_arrays(pa.array(mins.reshape(-1).view(np.int64)), hashes).cast(pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(_sketches(got, at)[full].reshape(-1)), SKETCH).cast(pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "tokens", "mins", "sketch"])

    return docs.mapInArrow(run, f"id {kind}, n long, tokens array<long>, mins array<long>, sketch array<long>")


def _sketches(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``SKETCH`` 64-bit words per text."""
    texts, width = len(at) - 1, SKETCH * 64
    cell = np.repeat(np.arange(texts), np.diff(at)) * width + (W.mix(tokens + np.uint64(99)) % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(cell, minlength=texts * width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(texts, SKETCH)


def _near_enough(share: Fraction) -> str:
    """Condition that sets ``na, sa`` and ``nb, sb`` must meet to link: sizes, and the bits in which the sketches differ."""
    num, den = share.numerator, share.denominator
    apart = " + ".join(f"bit_count(sa[{k}] ^ sb[{k}])" for k in range(SKETCH))
    return f"na * {num} <= nb * {den} AND nb * {num} <= na * {den} AND ({apart}) * {den + num} <= (na + nb) * {den - num}"


def _linked(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Of the pairs ``a, b``, those whose sets link. Sizes and sketches are compared before any tokens move."""
    brief = sets.select("id", "n", "sketch")
    a, b = brief.toDF("a", "na", "sa"), brief.toDF("_b", "nb", "sb")
    fit = pairs.distinct().join(a, "a").join(b, (F.col("b") == F.col("_b")) & F.expr(_near_enough(share))).select("a", "b")
    kept = sets.select("id", "tokens")
    both = fit.join(kept.toDF("a", "ta"), "a").join(kept.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    common = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("c"), (F.size("ta") + F.size("tb")).cast("long").alias("t"))
    return common.where(f"c * {share.denominator} >= (t - c) * {share.numerator}").select("a", "b")


def links(docs: DataFrame, size: int = SHINGLE, share: Fraction = SHARE, least: int = LEAST, hashes: int = HASHES) -> DataFrame:
    """Links ``a, b`` that connect all documents with ``id, text`` that are reachable from each other.

    ``docs`` should hold each set once. Links inside a group beyond those to its first member are not listed.
    """
    num, den = share.numerator, share.denominator
    sets = written(_tokens(docs, size, hashes), "token-sets")

    # groups: sets that share a minimum are compared with the one of them that shares most minima with others,
    # which stands in the middle of its near copies
    mins = sets.select("id", F.posexplode("mins").alias("k", "m"))
    counts = mins.groupBy("k", "m").agg(F.count("*").alias("c")).where("c > 1")
    shared = mins.join(counts, ["k", "m"])
    central = shared.groupBy("id").agg(F.sum("c").alias("mass"))
    best = F.max_by("id", F.struct(F.col("mass"), -F.col("id"))).alias("lead")
    leaders = shared.join(central, "id").groupBy("k", "m").agg(best)
    near = mins.join(leaders, ["k", "m"]).where("lead <> id").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    inner = written(_linked(near, sets, share), "links")
    heads = inner.select(F.col("a").alias("b"), "a").distinct()
    label = inner.unionByName(heads).groupBy("b").agg(F.min("a").alias("g")).withColumnRenamed("b", "id")
    up = label.select(F.col("id").alias("g"), F.col("g").alias("top"))
    label = label.join(up, "g", "left").select("id", F.coalesce("top", "g").alias("g"))
    # the sketch folded to a quarter, which is a sketch as well
    folds = [f"f{k}" for k in range(4)]
    folded = [F.expr(" ^ ".join(f"sketch[{i}]" for i in range(k, SKETCH, 4))).alias(f"f{k}") for k in range(4)]
    grouped = sets.select("id", "n", *folded).join(label, "id", "left").select("id", "n", F.coalesce("g", "id").alias("g"), *folds)
    members = written(grouped, "groups")

    # prefixes: the rarest tokens of each set, tokens of one set alone only as a number
    rows = sets.select("id", F.explode("tokens").alias("token"))
    common = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(common, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"))
    own = F.col("n") - F.size("found")
    length = f"n - CAST(ceil(n * {num} / {den}) AS BIGINT) + {least} - own"
    prefix = ranked.join(members, "id").withColumn("own", own).select(
        "id", "n", "g", "own", *folds, F.explode(F.expr(f"slice(found.token, 1, CAST(greatest(0, least(size(found), {length})) AS INT))")).alias("token")
    )
    prefix = written(prefix, "prefixes")

    # the matrix: tokens that more than one group has, with the groups
    sizes = members.groupBy("g").agg(F.count("*").alias("gn"))
    ones = [F.max(f).alias(f"o{f}") for f in folds]
    cells = prefix.groupBy("token", "g").agg(F.min("own").alias("least"), F.max("n").alias("most"), *ones)
    wide = cells.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    matrix = cells.join(wide, "token").join(sizes, "g").select("token", F.col("g").alias("other"), F.col("gn").alias("on"), "least", "most", *(f"o{f}" for f in folds))
    asking = prefix.join(wide, "token").join(sizes, "g").select("token", "id", "n", "own", "g", "gn", *folds)
    # tokens that one set alone has are in the difference of any two: too many of them rule a group out, as does the
    # sketch of a group of one
    apart = " + ".join(f"bit_count({f} ^ o{f})" for f in folds)
    possible = f"greatest(own + least, IF(on = 1, {apart}, 0)) * {den + num} <= (n + most) * {den - num}"
    asked = asking.join(matrix, (asking["token"] == matrix["token"]) & F.expr(f"(gn < on OR (gn = on AND g < other)) AND {possible}"))
    hits = asked.groupBy("id", "n", "other").agg(F.count("*").alias("hits"))
    opened = hits.where(f"hits >= least({least}, CAST(ceil(n * {num} / {den}) AS BIGINT))").select("id", "other")
    brief = sets.select("id", "n", "sketch")
    asks = opened.join(brief, "id").select(F.col("id").alias("a"), "other", F.col("n").alias("na"), F.col("sketch").alias("sa"))
    answers = members.select("id", "g").join(brief, "id").select("g", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    outer = asks.join(answers, (F.col("other") == F.col("g")) & F.expr(_near_enough(share))).select("a", "b")
    return inner.unionByName(_linked(outer, sets, share))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, share: Fraction = SHARE) -> DataFrame:
    """Per row: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = written(facts(source, size, share), "facts")
    copies = known.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min("alone").alias("alone"))
    open_ids = copies.where("NOT alone AND rep IS NOT NULL").select(F.col("rep").alias("id")).distinct()
    part = source.join(open_ids, "id", "left_semi")
    edges = links(part, size, share)
    # rows of one id with different texts are one document
    same = known.where("n > 0").join(copies.drop("alone"), ["n", "s1", "s2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    labels = components(edges.unionByName(same))
    return known.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id")
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, share: Fraction = SHARE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; rows without an id stay if their class has no other."""
    found = classes(docs, id_col, text_col, size, share).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    chosen = found.select(F.col(id_col).alias("_chosen")).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen["_chosen"]), "left_semi")


def op6_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every whole text of ``documents``."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, low AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""
