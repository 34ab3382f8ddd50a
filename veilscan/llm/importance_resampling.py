"""Importance resampling: draw documents whose hashed n-grams look like those of a target, by CRCs of substrings.

A document's words are joined by one separator, so that every run of consecutive words is one substring of its bytes. Each
document is scanned once, which leaves the CRC of every prefix; the CRC of any n-gram then follows from the prefixes at its two
ends, as what stands before it cancels once it is shifted over the n-gram (see ``crc``). That CRC modulo the number of buckets
is the feature. A bucket's gain is the logarithm of how much more often the target has it than the documents; a document's
weight is the mean gain of its features, and the draw without replacement takes the highest weights plus Gumbel noise.

Data flow: one narrow pass counts the buckets of all documents (at most ``buckets`` counters leave a task), a second one weighs
them; between them the gains, one number a bucket, go to all tasks. Ranks need no sort of the whole table in one place: scores are
integers of a bounded range, so a table of counts by score tells where each score's rows begin, and rows are numbered within
their score. Noise differs by document, so no score holds more than a small share of the rows.

Defined results: a null or empty text, and one without words, has no features and weight 0 and, if ``min_words`` allows, is
drawn like the others; a row without an id takes the noise of an empty id and comes before others of equal score; rows
that repeat are counted and drawn one by one; an empty table gives an empty table, and an empty target leaves its counts at 0;
further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.llm import crc
from veilscan.llm import words as W
from veilscan.llm.shared import written

#: Bytes between words, once A-Z are lowered: all but digits, a-z and those of other code points.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LENGTHS, BUCKETS, PERCENT, MIN_WORDS, SEED = (1, 2), 10_000, 25, 20, 7


def features(data: np.ndarray, offs: np.ndarray, lengths: Sequence[int], buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of the first word of each text, and for each n-gram length the words where one starts and its bucket."""
    data = W.lower(data)
    starts, ends, firsts = W.spans(data, offs, BETWEEN)
    text, cuts = W.packed(data, starts, ends, gap=1)
    text[cuts[1:] - 1] = 0x20
    starts, ends = cuts[:-1], cuts[1:] - 1
    sums = crc.running(text)
    out = []
    for n in lengths:
        at = np.flatnonzero(W.inside(firsts, n))
        out.append((at, crc.between(sums, starts[at], ends[at + n - 1]) % np.uint32(buckets)))
    return firsts, out


def bucket_counts(texts: DataFrame, text_col: str = "text", lengths: Sequence[int] = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """How many features of all texts fall in each bucket: ``bucket`` and ``n``, buckets without any left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, part, cuts in W.slices(*W.texts(batch.column(0))):
                for _, of in features(part, cuts, lengths, buckets)[1]:
                    total += np.bincount(of, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, lengths: Sequence[int], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of target to documents, for every bucket; ``buckets`` numbers whatever the input."""
    both = bucket_counts(docs, text_col, lengths, buckets).withColumn("side", F.lit(0)).unionByName(
        bucket_counts(target, target_col, lengths, buckets).withColumn("side", F.lit(1))
    )
    counts = np.zeros((2, buckets), dtype=np.int64)
    for row in both.collect():
        counts[row.side, row.bucket] = row.n
    (s_all, t_all), (s_own, t_own) = counts.sum(axis=1).tolist(), counts.tolist()
    ratios = (float(t + 1) * (s_all + buckets) / (float(s + 1) * (t_all + buckets)) for s, t in zip(s_own, t_own, strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """Per row: its id, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, end, part, cuts in W.slices(data, offs):
                firsts, found = features(part, cuts, lengths, len(gain))
                n = np.zeros(end - first, dtype=np.int64)
                total = np.zeros(end - first, dtype=np.int64)
                for at, of in found:
                    sums = np.zeros(len(at) + 1, dtype=np.int64)
                    np.cumsum(gain[of], out=sums[1:])
                    edge = np.searchsorted(at, firsts)
                    n += np.diff(edge)
                    total += np.diff(sums[edge])
                columns = [np.diff(firsts), n, total // np.maximum(n, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], *(pa.array(c, pa.int64()) for c in columns)], ["id", "n_words", "n_features", "weight"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> F.Column:
    """Thousandths of Gumbel noise, from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Add ``rank`` to the ``percent`` of rows of at least ``min_words`` words that score highest; ``scored`` is read twice."""
    fit = F.col("n_words") >= min_words
    # as many rows as there are scores, integers from the least to the highest gain plus noise
    steps = scored.where(fit).groupBy(F.col("score").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    places = (
        steps.withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0)))
        .withColumn("drawn", F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100))
        .where("before < drawn")
        .select("step", "before", "drawn")
    )
    placed = scored.join(F.broadcast(places), fit & (F.col("score") == F.col("step")), "left")
    number = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("id")))
    some = placed.where("before is not null").withColumn("number", number)
    none = placed.where("before is null").withColumn("number", F.lit(None).cast("long"))
    both = some.unionByName(none)
    return both.withColumn("rank", F.when(F.col("number") <= F.col("drawn"), F.col("number")).cast("long")).drop("step", "before", "drawn", "number")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    lengths: Sequence[int] = LENGTHS,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Per row: its id, ``n_words``, ``n_features``, ``weight``, ``score``, and ``rank`` among those drawn (else null)."""
    gain = gains(docs, target, text_col, target_col, lengths, buckets)
    weighed = weights(docs, gain, id_col, text_col, lengths)
    scored = written(weighed.withColumn("score", F.col("weight") + noise("id", seed)), "weights")
    return ranked(scored, percent, min_words).withColumnRenamed("id", id_col)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, a quarter of them drawn for their likeness with ``benchmark``."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 bit by bit over the bytes of each distinct feature.
SQL = f"""
    WITH words AS (
        SELECT 's' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        UNION ALL SELECT 't', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
    grams AS (
        SELECT side, id, unnest(w) AS f FROM words
        UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM words)),
    counted AS (SELECT side, id, f, count(*) AS n FROM grams GROUP BY ALL),
    hexed AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM counted),
    coded AS (SELECT f, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))
        )) % {BUCKETS} AS b FROM hexed),
    hits AS (SELECT side, id, b, sum(n) AS n FROM counted JOIN coded USING (f) GROUP BY ALL),
    totals AS (SELECT coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t_all FROM hits),
    gain AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS})))) AS g
        FROM (SELECT b, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM hits GROUP BY b), totals),
    weighed AS (SELECT id, sum(n)::BIGINT AS n, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM hits JOIN gain USING (b) WHERE side = 's' GROUP BY id),
    scored AS (SELECT doc_id, coalesce(weighed.n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
        FROM documents JOIN words ON side = 's' AND id = doc_id LEFT JOIN weighed ON weighed.id = doc_id),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n_words >= {MIN_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * fit // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
