"""Quality rules by repetition coverage: how many characters of a text stand inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths are taken in numpy over whole Arrow batches. A word is covered at
length n when a window of n words that holds it is found twice or more in the text (the first one counts
as well, unless told otherwise); coverage is the share of the text's word characters in covered words. A text
whose coverage at any length, or in repeated lines, is over that rule's limit is rejected.

Each text is looked at by itself, so this is one narrow pass: no shuffle, memory in proportion to a few
megabytes of text or to the longest single text.

Defined results: a null or empty text has no words, so it fails ``min_words``; rows that repeat and ties
are looked at one by one; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import words as W
from veilscan.llm.rows import filtered

#: The highest share of word characters inside repeated n-grams, by n.
NGRAM_LIMITS: Mapping[int, float] = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: The highest share of word characters in lines that an earlier line equals.
LINE_LIMIT = 0.30
MIN_WORDS = 20
REPEAT_PERCENT, REPEAT_WORDS = 30, 8
SYMBOLS = b"#*$%&|<>"


def _totals(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive ``cuts``."""
    run = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=run[1:])
    return run[cuts[1:]] - run[cuts[:-1]]


def covered(hashes: np.ndarray, firsts: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each n-gram length, ascending, the words inside windows that are found twice or more in their text.

    A window repeats only if both shorter windows in it repeat, so each length looks at what the one before left.
    """
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(len(hashes))
    owner = W.owners(firsts)
    alive, reach = None, 0
    for n in lengths:
        grams = W.grams(hashes, n)
        at = np.flatnonzero(left[: len(grams)] >= n)
        if alive is not None:
            step = n - reach
            at = at[alive[at] & alive[at + step]]
        twice = at[W.repeated(grams[at], owner[at])]
        edge = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + n, -1)
        alive, reach = np.zeros(len(hashes), dtype=bool), n
        alive[twice] = True
        yield n, np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray, lengths: list[int]) -> dict[str, np.ndarray]:
    """Counts and coverage of each text of a slice."""
    starts, ends, firsts = W.spans(data, offs)
    sums = W.prefix(data.astype(np.uint64) + np.uint64(1))
    hashes = W.span_hash(sums, starts, ends)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    is_symbol = np.zeros(256, dtype=bool)
    is_symbol[list(SYMBOLS)] = True
    out = {
        "n_words": np.diff(firsts),
        "word_chars": _totals(chars, firsts),
        "n_symbols": _totals(is_symbol[data], offs),
    }

    # lines: from the start of a text or behind a \n up to the next one
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offs] = True
    begins[1:] |= data == 10
    line_starts = np.flatnonzero(begins[:-1])
    line_ends = np.append(line_starts[1:], len(data))[: len(line_starts)]
    line_ends = line_ends - (data[line_ends - 1] == 10)
    word_at = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = word_at[1] > word_at[0]
    line_starts, line_ends = line_starts[full], line_ends[full]
    first_word, end_word = word_at[0][full], word_at[1][full]
    line_owner = np.searchsorted(offs, line_starts, "right") - 1
    key = W.span_hash(sums, line_starts, line_ends) ^ W.mix(line_owner.astype(np.uint64) + np.uint64(77))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[first] = False
    texts = len(offs) - 1
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=texts)
    run = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars, out=run[1:])
    in_lines = run[end_word[again]] - run[first_word[again]]
    out["line_chars"] = np.bincount(line_owner[again], weights=in_lines, minlength=texts).astype(np.int64)

    for n, flag in covered(hashes, firsts, lengths):
        out[f"chars_{n}"] = _totals(np.where(flag, chars, 0), firsts)
        out[f"words_{n}"] = _totals(flag, firsts)
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Mapping[int, float] = NGRAM_LIMITS) -> DataFrame:
    """Per row: its id, counts, and characters and words inside repeated n-grams of each length.

    Columns: the id; ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``line_chars``; for each length
    n ``chars_n`` and ``words_n``, all long. Null text: all zero.
    """
    ns = sorted({*lengths, REPEAT_WORDS})
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "line_chars"] + [f"{k}_{n}" for n in ns for k in ("chars", "words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, end, part, cuts in W.slices(data, offs, W.SMALL):
                got = measure(part, cuts, ns)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], *(pa.array(got[k], pa.int64()) for k in names)], ["id", *names])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, ", ".join([f"id {kind}", *(f"{k} long" for k in names)]))
    return out.withColumnRenamed("id", id_col)


def judge(counts: DataFrame, limits: Mapping[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Add ``n_repeat_words``, ``base_failed``, ``coverage`` (the highest share of its limit) and ``kept``."""
    most = [F.col(f"chars_{n}") / (F.col("word_chars") * F.lit(float(limit))) for n, limit in sorted(limits.items())]
    most.append(F.col("line_chars") / (F.col("word_chars") * F.lit(float(line_limit))))
    coverage = F.when(F.col("word_chars") > 0, F.greatest(*most)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (
        counts.withColumn("n_repeat_words", F.col(f"words_{REPEAT_WORDS}"))
        .withColumn("base_failed", failed)
        .withColumn("coverage", coverage)
        .withColumn("kept", ~F.col("base_failed") & (F.col("coverage") <= 1.0))
    )


def kept_rows(docs: DataFrame, text_col: str = "text", limits: Mapping[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns, in the pass that reads them."""
    ns = sorted({*limits, REPEAT_WORDS})

    def keep():
        def kept(column: pa.Array) -> pa.Array:
            data, offs = W.texts(column)
            out = [np.zeros(0, dtype=bool)]
            for _, _, part, cuts in W.slices(data, offs, W.SMALL):
                got = measure(part, cuts, ns)
                some = np.maximum(got["word_chars"], 1)
                good = (got["n_words"] >= MIN_WORDS) & (100 * got[f"words_{REPEAT_WORDS}"] <= REPEAT_PERCENT * got["n_words"])
                for n, limit in limits.items():
                    good &= got[f"chars_{n}"] <= limit * some
                out.append(good & (got["line_chars"] <= line_limit * some))
            return pa.array(np.concatenate(out))

        return kept

    return filtered(docs, text_col, keep)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition of every whole text of ``documents``, and whether it is kept."""
    judged = judge(repetition(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, *(f"chars_{n}" for n in sorted(NGRAM_LIMITS)), "line_chars")


def _sql() -> str:
    grams = "\n".join(
        f"""
    , g{n} AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {n - 1}), ' ')) AS g FROM pos WHERE i + {n - 1} <= n),
    r{n} AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}) WHERE c > 1),
    c{n} AS (SELECT doc_id, sum(length(w[p])) AS chars, count(*) AS wds FROM
        (SELECT DISTINCT doc_id, i + unnest(range({n})) AS p FROM r{n}) JOIN docs USING (doc_id) GROUP BY doc_id)"""
        for n in sorted(NGRAM_LIMITS)
    )
    over = " OR ".join(f"coalesce(c{n}.chars, 0) > {limit} * word_chars" for n, limit in sorted(NGRAM_LIMITS.items()))
    chars = ", ".join(f"CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS chars_{n}" for n in sorted(NGRAM_LIMITS))
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in sorted(NGRAM_LIMITS))
    return rf"""
    WITH docs AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    pos AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM docs)
    {grams},
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
    dup AS (SELECT doc_id, sum(k - 1) AS lines, sum((k - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
        FROM (SELECT doc_id, line, count(*) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
    base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM docs),
    all_of AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup.lines, 0) AS n_dup_lines,
        coalesce(c8.wds, 0) AS n_repeat_words, coalesce(dup.chars, 0) AS line_chars, {chars},
        {over} OR coalesce(dup.chars, 0) > {LINE_LIMIT} * word_chars AS over
        FROM base LEFT JOIN dup USING (doc_id) {joins}),
    failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM all_of)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
        CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
        NOT base_failed AND NOT over AS kept, {', '.join(f'chars_{n}' for n in sorted(NGRAM_LIMITS))}, CAST(line_chars AS BIGINT) AS line_chars
    FROM failed"""


SQL = _sql()
