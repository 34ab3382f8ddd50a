"""Spelling variants: frequent words that differ by one code point, each led back to the more frequent form it stands for.

1. Words are counted over all texts (distinct words leave a task with their counts, Spark sums them). The registered query first
   plants known misspellings, by the CRC of id and word.
2. Two words that are one inserted, deleted or replaced code point apart share their beginning or their end: cut the shorter one
   (of length L) after L // 2 code points; the edit leaves one of the halves in both. So a word stands in four groups: by the
   length L that the shorter word would have (its own, or one less), and the half at its beginning or at its end.
3. Groups are compared densely: the words of a block are rows of a padded matrix of code points, once aligned left and once right,
   and all pairs of two blocks are compared at once. With the common prefix p and the common suffix s, two words are one edit
   apart if p + s reaches the longer length minus one. Pairs with p >= L // 2 count in the group of the beginning, others in that
   of the end, so each pair is found once. A group above ``BLOCK`` words is cut into blocks, and each pair of blocks is a tile of its
   own, dealt to any task; tasks hold one tile at a time.
4. A word's form is its most frequent near word if that is ``RATIO`` times as frequent or more; forms are followed to the last
   by joining the table with itself, which doubles the steps each time. Counts grow by RATIO a step, so few rounds suffice.

Defined results: null and empty texts have no words; rows that repeat are counted each; a null id is written as nothing
before the colon of the planting rule; equal counts go to the smaller word in code-point order; an empty table gives an empty
table; further columns are not read; very long words are compared in smaller pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.llm import crc
from veilscan.llm import words as W
from veilscan.llm.shared import written

MIN_CHARS, MIN_COUNT, RATIO, PLANTED = 6, 5, 5, 199
#: Words of a block, and cells of the largest three-dimensional array that is compared at once.
BLOCK, CELLS = 1024, 1 << 21
#: Words of a block of small groups, and words for each comparing task.
SMALL, TASK_WORDS = 96, 20_000


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, whose first UTF-8 byte is always C3, as ``words.spans``."""
    letter = ((data | np.uint8(32)) >= 97) & ((data | np.uint8(32)) <= 122)
    lead = data == 0xC3
    letter |= lead
    letter[1:] |= lead[:-1]
    return W.runs(letter, offs)


def misspelt(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, ids: list[bytes], part: int) -> dict[int, str]:
    """Words that lose a code point, by the planting rule: their place among the spans, and what is left."""
    text, cuts = W.packed(lowered, starts, ends)
    own = crc.between(crc.running(text), cuts[:-1], cuts[1:])
    heads, places = W.packed(np.frombuffer(b"".join(ids), dtype=np.uint8), *_edges(ids))
    before = crc.between(crc.running(heads), places[:-1], places[1:])
    h = crc.joined(before[owner], own, ends - starts)
    out = {}
    for k in np.flatnonzero(h % np.uint32(part) == 0).tolist():
        word = lowered[starts[k] : ends[k]].tobytes().decode()
        at = int(h[k]) % len(word)
        out[k] = word[:at] + word[at + 1 :]
    return out


def _edges(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, planted: int | None = None) -> DataFrame:
    """``word`` and ``n`` of all texts, lower-cased words of ``min_chars`` code points or more.

    ``planted``: a word of a document whose CRC is divisible by it loses a code point before it is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            names = batch.column(0).to_pylist() if planted else []
            for first, end, part, cuts in W.slices(data, offs, most=1 << 23):
                starts, ends, firsts = word_spans(part, cuts)
                lowered = W.lower(part)
                owner = W.owners(firsts)
                points = np.zeros(len(part) + 1, dtype=np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                full = points[ends] - points[starts] >= min_chars
                starts, ends, owner = starts[full], ends[full], owner[full]
                hashes = W.word_hashes(lowered, starts, ends)
                if not len(starts):
                    continue
                if planted:
                    # one row for each word of each document, as the rule depends on nothing else
                    order = np.lexsort((hashes, owner))
                    new = np.ones(len(order), dtype=bool)
                    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                    n = np.diff(np.append(np.flatnonzero(new), len(order)))
                    one = order[new]
                    heads = [f"{'' if x is None else x}:".encode() for x in names[first:end]]
                    changed = misspelt(lowered, starts[one], ends[one], owner[one], heads, planted)
                    told = np.fromiter(changed, dtype=np.int64, count=len(changed))
                    changed = [(w, int(n[k])) for k, w in changed.items() if len(w) >= min_chars]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in changed], pa.string()), pa.array([k for _, k in changed], pa.int64())], ["word", "n"])
                    keep = np.ones(len(one), dtype=bool)
                    keep[told] = False
                    one, n = one[keep], n[keep]
                else:
                    one, n = np.arange(len(starts)), np.ones(len(starts), dtype=np.int64)
                _, at, of = np.unique(hashes[one], return_index=True, return_inverse=True)
                total = np.bincount(of, weights=n, minlength=len(at)).astype(np.int64)
                words = W.strings(lowered, starts[one[at]], ends[one[at]]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(total)], ["word", "n"])

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, padded to one width: aligned left, aligned right, and their lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    width = int(lengths.max())
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.zeros((len(words), width), dtype=np.uint32)
    right = np.zeros((len(words), width), dtype=np.uint32)
    left[row, column] = flat
    right[row, column + np.repeat(width - lengths, lengths)] = flat
    return left, right[:, ::-1], lengths


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every row of ``a`` and every row of ``b`` the number of columns from the left that agree."""
    differ = a[:, None, :] != b[None, :, :]
    out = differ.argmax(axis=2)
    out[~differ.any(axis=2)] = a.shape[1]
    return out


def near_pairs(words: list[str], tile: np.ndarray, side: np.ndarray, short: np.ndarray, at_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i < j, of one tile, not of the same block if it has two, that are one edit apart and count in this group.

    ``tile``, ``side``, ``short`` (the length L of the group) and ``at_start`` (its half is the beginning) are those of each row.
    """
    own = np.arange(len(words))
    two = side.all() and tile[0] == tile[-1]
    first, second = (own[side == 1], own[side == 2]) if two else (own, own)
    left, right, lengths = matrices(words)
    width = left.shape[1]
    across = max(1, min(len(second), CELLS // width))
    step = max(1, CELLS // (width * across))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(first), step):
        a = first[i : i + step]
        least = short[a][:, None]
        for j in range(0, len(second), across):
            b = second[j : j + across]
            longer = np.maximum(lengths[a][:, None], lengths[b][None, :])
            hit = (tile[a][:, None] == tile[b][None, :]) & (a[:, None] < b[None, :])
            hit &= (side[a][:, None] == 0) | (side[a][:, None] != side[b][None, :])
            hit &= np.minimum(lengths[a][:, None], lengths[b][None, :]) == least
            if not hit.any():
                continue
            # padding agrees with padding only, behind the end of both words
            prefix = np.minimum(common(left[a], left[b]), least)
            suffix = np.minimum(common(right[a], right[b]), least)
            hit &= (prefix + suffix >= longer - 1) & (prefix < longer)
            hit &= (prefix >= least // 2) == at_start[a][:, None]
            x, y = np.nonzero(hit)
            found.append((a[x], b[y]))
    i, j = zip(*found, strict=True)
    return np.concatenate(i), np.concatenate(j)


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, in tables that end where a tile ends; a tile's rows arrive together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        tile = table.column("tile").to_numpy()
        change = np.flatnonzero(tile[1:] != tile[:-1]) + 1
        if len(change):
            yield table.slice(0, int(change[-1]))
            held = table.slice(int(change[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each word within the tiles, both ways."""
    for table in _whole_tiles(batches):
        if not table.num_rows:
            continue
        words = table.column("word").to_pylist()
        n, tile, side, short, start = (table.column(c).to_numpy() for c in ("n", "tile", "side", "short", "at_start"))
        edges = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])
        at = 0
        while at < len(edges) - 1:
            # small tiles share matrices, a larger one has its own
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + SMALL, "right")) - 1)
            rows = slice(int(edges[at]), int(edges[to]))
            i, j = near_pairs(words[rows], tile[rows], side[rows], short[rows], start[rows])
            i, j = np.concatenate([i, j]) + rows.start, np.concatenate([j, i]) + rows.start
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in i], pa.string()), pa.array([words[k] for k in j], pa.string()), pa.array(n[j])], ["word", "near", "near_n"])
            at = to


def tiles(words: DataFrame) -> DataFrame:
    """Each word once for every tile that it takes part in: ``word``, ``n``, ``short``, ``at_start``, ``tile``, ``side``.

    ``side``: 0 where all pairs of the tile are compared, else 1 and 2 for the words of its first and second block.
    """
    size = F.length("word")

    def group(short, at_start):
        half = F.substr("word", F.lit(1), F.floor(short / 2).cast("int")) if at_start else F.substr("word", -(short - F.floor(short / 2)).cast("int"))
        return F.struct(short.cast("int").alias("short"), F.lit(at_start).alias("at_start"), half.alias("half"))

    groups = words.select("word", "n", F.explode(F.array(*(group(short, side) for short in (size, size - 1) for side in (True, False)))).alias("g")).select("word", "n", "g.*")
    key = ("short", "at_start", "half")
    numbered = groups.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("members > 1")
    numbered = numbered.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("word")) - 1) / BLOCK).cast("int"))
    dealt = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("members") - 1) / BLOCK).cast("int"))))
    tile = F.xxhash64(*key, F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return dealt.select("word", "n", "short", F.col("at_start").cast("int").alias("at_start"), tile.alias("tile"), side.alias("side"))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: every word with each word that is one edit away; ``words`` has ``word`` and ``n``, each word once."""
    # comparing costs far more than moving, so the number of tasks follows the words and is not coalesced
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, words.count() // TASK_WORDS)
    dealt = tiles(words).repartition(tasks, "tile").sortWithinPartitions("short", "tile", "side")
    return dealt.mapInArrow(compare, "word string, near string, near_n long")


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of a table of words and counts, each word once."""
    best = near_words(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    stands = -F.col("best.less") >= ratio * F.col("n")
    judged = written(
        counted.join(best, "word", "left").select(
            "word",
            F.when(stands, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(stands, -F.col("best.less")).cast("long").alias("form_n"),
        ),
        "spelling-forms",
    )
    # counts grow by the ratio with each form, so the longest chain follows from the largest and the smallest count
    most, least = judged.agg(F.max("n"), F.min("n")).first()
    steps = 0
    while most and least * ratio ** (steps + 1) <= most:
        steps += 1
    roots = judged.where("form is not null").select("word", F.col("form").alias("root"))
    done = 1
    while done < steps:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        done *= 2
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, planted: int | None = None
) -> DataFrame:
    """All words of ``min_chars`` code points or more that are found ``min_count`` times or more, each with its form and root."""
    counted = count_words(docs, id_col, text_col, min_chars, planted).where(F.col("n") >= min_count)
    return variants(written(counted, "spelling-words"), ratio)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents``, some of them misspelt by rule, with their forms and roots."""
    return group_spellings(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted=PLANTED)


#: CRC-32 bit by bit; near words share what is left when one code point is taken out of one or both.
SQL = f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
        WHERE length(run) >= {MIN_CHARS} GROUP BY ALL),
    hexed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs),
    coded AS (SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1))))) AS h FROM hexed),
    planted AS (SELECT CASE WHEN h % {PLANTED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM coded),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM planted WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
    cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, max(near_n) AS top_n FROM pairs GROUP BY word),
    top AS (SELECT word, any_value(n_near) AS n_near, any_value(top_n) AS top_n, min(near) AS top FROM best JOIN pairs USING (word) WHERE near_n = top_n GROUP BY word),
    forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= {RATIO} * n THEN top END AS form,
        CASE WHEN top_n >= {RATIO} * n THEN top_n END AS form_n FROM words LEFT JOIN top USING (word)),
    walk AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON walk.next = forms.word)
    SELECT word, form, root, n, n_near, form_n FROM walk JOIN forms USING (word) WHERE next IS NULL"""
