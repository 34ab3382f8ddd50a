"""Token ids in files: canonical length-limited Huffman codes from global counts, in independent blocks.

Format: a folder with two Parquet tables. ``code`` has one row: the code length of every id (one byte each, 0: the
id does not occur). Codes are canonical: ascending by length, then by id. ``blocks`` has a row per block: ``file``
and ``block`` (order of the blocks), ``doc_ids`` and ``doc_tokens`` of the whole documents in it, ``bits`` (the codes one
after another, most significant bit first, each document from a byte of its own on) and ``checkpoints`` (bits of each run
of 64 ids of a document, unsigned 16-bit little-endian), from which the bit offset of each run follows. A block is decoded by itself: all its runs at once, each
step looking up the next bits in one table.

Files are in ascending order of the document id. Texts are encoded where they are read, the ids written once, counted
(one row per id and task, summed by Spark; the vocabulary bounds what reaches the driver), then coded and
ordered by range. Blocks hold about 65536 ids, or one longer document.

Words are encoded once per task and slice: no token of the given tokenizer crosses ASCII white space.

Defined results: null counts as the empty text, which has the end id alone; equal ids of documents stand next to each
other; null ids come first; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.llm import words as W
from veilscan.llm.shared import folder, written

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Ids between two checkpoints, ids of a block, and the longest code in bits.
RUN, BLOCK, LONGEST = 64, 1 << 16, 18
#: Ids of a file, about 20 MB.
FILE_TOKENS = 1 << 24
#: Words that a task remembers with their ids.
REMEMBERED = 700_000


# --- tokens -----------------------------------------------------------------------------------------------


class Words:
    """Ids of words by a tokenizer file, with a bounded memory of earlier words and parts of words.

    Words of printable Latin-1 characters are put in lower case and split here, as the file's own steps would, and their
    parts go straight to the library's model; all other words, and all words if the file has other steps, go through
    the library's whole pipeline.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model.tokenize
        self._ids: dict[bytes, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._plain = regex.compile("[!-~\u00a1-\u00ff]+").fullmatch
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # bytes that stand for themselves, and characters for the rest
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        self._mapped = {b: chr(256 + k) for k, b in enumerate(rest)}
        self._table = "".join(self._mapped.get(b, chr(b)) for b in range(256))
        probes = ["Word,", "don't", "a1b22", "\u00c9t\u00e9...", "stra\u00dfe!!", "x\u00b2", "<b>", "'LL"]
        self._fast = all(self._pieces(w) == self._whole([w])[0] for w in probes)

    def _whole(self, words: list[str]) -> list[bytes]:
        coded = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(c.ids, dtype="<u4").tobytes() for c in coded]

    def _pieces(self, word: str) -> bytes:
        out = b""
        for part in self._split(word.lower()):
            ids = self._parts.get(part)
            if ids is None:
                spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self._mapped)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self._model(spelled)])
                self._parts[part] = ids
            out += ids
        return out

    def ids_of(self, units: list[bytes], whole: list[bool]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each unit: a word, if ``whole``, else a part in lower case."""
        if len(self._ids) > REMEMBERED:
            self._ids.clear()
            self._parts.clear()
        known, model, table, slow = self._ids, self._model, self._table, []
        for unit, word in zip(units, whole, strict=True):
            if unit in known:
                continue
            if not word:
                text = unit.decode("ascii") if unit.isascii() else charmap_decode(unit, "strict", table)[0]
                known[unit] = array("I", [t.id for t in model(text)]).tobytes()
            else:
                text = unit.decode()
                if self._fast and self._plain(text) and "<|" not in text:
                    known[unit] = self._pieces(text)
                else:
                    slow.append(unit)
        if slow:
            known.update(zip(slow, self._whole([w.decode() for w in slow]), strict=True))
        return [known[u] for u in units]

    def split(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units of words: bytes in lower case (of whole words as they are), their starts, the word each begins with, and which are whole."""
        if not self._fast:
            return data, starts, np.arange(len(starts)), np.ones(len(starts), dtype=bool)
        before = np.concatenate([[np.uint8(32)], data[:-1]])
        second = (before == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)
        first = np.zeros(len(data), dtype=bool)
        first[:-1] = second[1:]
        odd = ~(_KIND[data] > 0) & ~second & ~first | (data == 0x7C) & (before == 0x3C)
        run = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(odd & ~W.SPACE[data], out=run[1:])
        whole = run[ends] > run[starts]
        kind = np.where(second | first, np.uint8(1), _KIND[data])
        lowered = np.where(second & (data <= 0x9E), data + np.uint8(32), W.lower(data))
        edge = np.zeros(len(data), dtype=bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        np.add.at(inside, starts[whole], 1)
        np.add.at(inside, ends[whole], -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        edge &= ~inside & ~W.SPACE[data]
        edge[starts] = True
        at = np.flatnonzero(edge)
        begins = np.searchsorted(at, starts)
        flags = np.zeros(len(at), dtype=bool)
        flags[begins[whole]] = True
        return np.where(inside, data, lowered), at, begins, flags


#: Kinds of bytes in words that are split here: letters, digits, marks; an apostrophe and the rest need the pattern.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[np.r_[0x41:0x5B, 0x61:0x7B]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 0


def encode_slice(words: Words, data: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice, each with the end id, and where each text's ids start."""
    starts, ends, firsts = W.spans(data, offs)
    body, at, begins, whole = words.split(data, starts, ends)
    # units follow each other without the white space
    kept = ~W.SPACE[data]
    shift = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kept, out=shift[1:])
    cuts = np.append(shift[at], shift[-1])
    body = np.ascontiguousarray(body[kept])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(body)])
    column = column.dictionary_encode()
    codes = column.indices.to_numpy().astype(np.int64)
    flags = np.zeros(len(column.dictionary), dtype=bool)
    flags[codes[whole]] = True
    coded = words.ids_of(column.dictionary.to_pylist(), flags.tolist()) + [end.to_bytes(4, "little")]
    # the end id stands behind the last unit of each text
    first_units = np.append(begins, len(at))[firsts]
    codes = np.insert(codes, first_units[1:], len(coded) - 1)
    # ids of the distinct units one after another, from where they are taken for every unit
    known = np.frombuffer(b"".join(coded), dtype="<u4")
    sizes = np.array([len(c) >> 2 for c in coded], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = sizes[codes]
    run = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(counts, out=run[1:])
    place = np.repeat(begins[codes] - run[:-1], counts)
    place += np.arange(len(place))
    return known.take(place), run[first_units + np.arange(len(firsts))]


def tokenise(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``ids`` (binary, unsigned little-endian, 16 bits each if the vocabulary allows, else 32)."""
    kind = _width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, stop, part, cuts in W.slices(data, offs, 1 << 23):
                ids, at = encode_slice(words, part, cuts, end)
                raw = ids.astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:stop], _binary(at * raw.itemsize, raw)], ["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids binary")


def _binary(offs: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, buffers).cast(pa.binary())


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


# --- code ---------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 for ids that do not occur."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    if len(used) <= 1:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    merged, single = weights, [np.ones(len(used), dtype=bool)]
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        single.append(order < len(used))
    lengths, take = np.zeros(len(used), dtype=np.int64), 2 * len(used) - 2
    for flags in reversed(single):
        n = int(flags[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, ascending by length, then by id."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    code = last = 0
    for i in used[np.argsort(lengths[used], kind="stable")]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        out[i] = code
        code += 1
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next bits, the id and its length; and how many bits that are."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    bits = int(lengths.max()) if len(used) else 1
    spans = np.int64(1) << (bits - lengths[order].astype(np.int64))
    ids = np.zeros(1 << bits, dtype=np.uint32)
    ids[: spans.sum()] = np.repeat(order, spans)
    return ids, lengths[ids].astype(np.int64), bits


def pack(ids: np.ndarray, cuts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the codes of several documents, each from a byte of its own on, and their checkpoints.

    ``cuts`` says where each document's ids start. Gives bytes, where each document's bytes start, bits of each run, where
    each document's runs start.
    """
    counts = np.diff(cuts)
    sizes = lengths[ids].astype(np.int64)
    total = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(sizes, out=total[1:])
    starts = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum((np.diff(total[cuts]) + 7) >> 3, out=starts[1:])
    at = total[:-1] + np.repeat(starts[:-1] * 8 - total[cuts[:-1]], counts)
    shifted = codes[ids] << (64 - (at & 31) - sizes).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((int(starts[-1]) >> 2) + 2, dtype=np.uint64)
    if len(ids):
        out[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    run_cuts = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(-(-counts // RUN), out=run_cuts[1:])
    within = np.arange(int(run_cuts[-1])) - np.repeat(run_cuts[:-1], np.diff(run_cuts))
    heads = np.repeat(cuts[:-1], np.diff(run_cuts)) + within * RUN
    tails = np.minimum(heads + RUN, np.repeat(cuts[1:], np.diff(run_cuts)))
    return out.astype(">u4").view(np.uint8)[: starts[-1]], starts, (total[tails] - total[heads]).astype("<u2"), run_cuts


def unpack(bits: bytes, checkpoints: bytes, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block; every run is decoded from its own bit offset, all runs side by side."""
    ids, sizes, width = table
    raw = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.int64)
    four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    runs = np.frombuffer(checkpoints, dtype="<u2").astype(np.int64)
    per_doc = -(-counts // RUN)
    ends = np.cumsum(per_doc)
    bit_ends = np.concatenate([[0], np.cumsum(runs)])
    doc_bits = bit_ends[ends] - bit_ends[ends - per_doc]
    doc_starts = np.cumsum((doc_bits + 7) >> 3) - ((doc_bits + 7) >> 3)
    at = bit_ends[:-1] + np.repeat(doc_starts * 8 - bit_ends[ends - per_doc], per_doc)
    out = np.zeros((RUN, len(runs)), dtype=np.uint32)
    for step in range(RUN):
        window = (four[np.minimum(at >> 3, len(four) - 1)] << (at & 7) & 0xFFFFFFFF) >> (32 - width)
        out[step] = ids[window]
        at = at + sizes[window]
    within = np.arange(len(runs)) - np.repeat(ends - per_doc, per_doc)
    left = np.minimum(np.repeat(counts, per_doc) - within * RUN, RUN)
    return out.T[np.arange(RUN) < left[:, None]]


# --- files --------------------------------------------------------------------------------------------------


def _counts(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs in all rows; at most one row per id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, _, part, _ in W.slices(*W.texts(batch.column(0)), 1 << 20):
                total += np.bincount(part.view(kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["token", "n"])

    table = tokens.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[table["token"].to_numpy()] = table["n"].to_numpy()
    return out


def _bounds(tokens: DataFrame, files: int) -> list:
    """The largest id of each file but the last, from the column of ids alone."""
    ranges = tokens.select("id").repartitionByRange(files, "id")
    tops = ranges.groupBy(F.spark_partition_id().alias("file")).agg(F.max("id").alias("top")).orderBy("file")
    return [r.top for r in tops.collect() if r.top is not None][:-1]


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts to the folder ``path``, in ascending order of the id column."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size, kind = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1), _width(tokenizer)
    tokens = written(tokenise(docs, tokenizer, end, id_col, text_col), "tokens")
    counts = _counts(tokens, size, kind)
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    id_kind = tokens.schema["id"].dataType.simpleString()
    fields = "file int, block int, doc_ids array<{0}>, doc_tokens array<long>, n_tokens long, bits binary, checkpoints binary".format(id_kind)

    bounds = _bounds(tokens, max(spark.sparkContext.defaultParallelism, int(counts.sum()) // FILE_TOKENS))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Code every row by itself before it moves: coded ids are the smallest form."""
        for batch in batches:
            raw, offs = W.texts(batch.column(1))
            files = pa.array([0 if x is None else bisect_left(bounds, x) for x in batch.column(0).to_pylist()], pa.int32())
            for first, stop, part, cuts in W.slices(raw, offs, 1 << 20):
                at = cuts // np.dtype(kind).itemsize
                bits, starts, runs, run_starts = pack(part.view(kind), at, lengths, codes)
                yield pa.RecordBatch.from_arrays(
                    [files[first:stop], batch.column(0)[first:stop], pa.array(np.diff(at)), _binary(starts, bits), _binary(run_starts * 2, runs)],
                    ["file", "id", "n", "bits", "checkpoints"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Put coded rows together to blocks."""
        file, block, n = 0, 0, 0
        docs, counts, bits, checkpoints = [], [], [], []

        def close() -> pa.RecordBatch:
            values = [[file], [block], [docs], [counts], [n], [b"".join(bits)], [b"".join(checkpoints)]]
            types = [pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            names = ["file", "block", "doc_ids", "doc_tokens", "n_tokens", "bits", "checkpoints"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            id_type = batch.column(1).type
            for own, doc, count, body, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != file:
                    if docs:
                        yield close()
                    docs, counts, bits, checkpoints, n, file, block = [], [], [], [], 0, own, 0
                docs.append(doc)
                counts.append(count)
                bits.append(body)
                checkpoints.append(runs)
                n += count
                if n >= BLOCK:
                    yield close()
                    docs, counts, bits, checkpoints, n, block = [], [], [], [], 0, block + 1
        if docs:
            yield close()

    coded = tokens.mapInArrow(code, f"file int, id {id_kind}, n long, bits binary, checkpoints binary")
    # rows know their file, so nothing is coded only to be sampled for ranges
    ordered = coded.repartitionById(len(bounds) + 1, "file").sortWithinPartitions("file", "id", "n", "bits")
    ordered.mapInArrow(blocks, fields).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder: ``file``, ``block``, ``at`` (ids before it in its block), ``doc_id``, ``ids`` (32-bit little-endian)."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], dtype=np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    id_kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                docs, counts = batch.column(2)[row].values, batch.column(3)[row].values.to_numpy()
                cuts = np.concatenate([[0], np.cumsum(counts)])
                ids = unpack(batch.column(5)[row].as_py(), batch.column(6)[row].as_py(), counts, table).astype("<u4")
                same = [pa.array(np.full(len(docs), batch.column(k)[row].as_py(), dtype=np.int32)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(cuts[:-1]), docs, _binary(cuts * 4, ids)], ["file", "block", "at", "doc_id", "ids"])

    return blocks.mapInArrow(run, f"file int, block int, at long, doc_id {id_kind}, ids binary")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block`` and how many ids stand before that block in all files."""
    blocks = spark.read.parquet(f"{path}/blocks").select("file", "block", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before.orderBy("file")), F.lit(0)).alias("first")
    )
    inner = F.coalesce(F.sum("n_tokens").over(before.partitionBy("file").orderBy("block")), F.lit(0))
    return blocks.withColumn("inner", inner).join(files, "file").select("file", "block", (F.col("first") + F.col("inner")).alias("first"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` through token files and back."""
    import public_tokenizers

    path = folder(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path(TOKENIZER))
    docs = read(spark, path).select(
        "file", "block", "at", "doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    return docs.join(starts(spark, path), ["file", "block"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
