"""Byte-level BPE encoding and decoding through a sentencepiece model made from a vocabulary of ranks.

The model file is written here, field by field, from the rank file: every vocabulary entry becomes a piece in
which each byte stands as one character, with minus its rank as score, so that sentencepiece merges the pair
with the lowest rank first, the leftmost on ties, just as merging by ranks does. Normalisation is the
identity; no prefix, no white space handling. A pre-token that is itself an entry takes that entry's rank.
Ids are decoded by the inverse mapping, from ids to pieces to bytes.

A text is cut before each single space that follows or starts a run of white space; the pattern's matches never
cross such a cut, so equal pieces between cuts are encoded once. A text with white space beyond ASCII is
matched in one piece. Each text is encoded by itself: one narrow pass, no shuffle. What is remembered of
earlier pieces is bounded and only saves time.

Defined results: null counts as the empty text, which has no ids; special tokens' strings are ordinary text;
an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import words as W

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a task remembers with their ids; forgotten together when there are more.
REMEMBERED = 500_000
#: Which characters are letters is settled below this one.
_STABLE = "\u0250"
#: Where bytes stand as characters in the model's pieces.
SHIFT = 0x100
_MAPPED = {b: chr(SHIFT + b) for b in range(256)}


def load_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    entries = {int(rank): base64.b64decode(entry) for entry, rank in pairs}
    if sorted(entries) != list(range(len(entries))):
        raise ValueError(f"{path}: ranks are not consecutive")
    return [entries[rank] for rank in range(len(entries))]


def mapped(entry: bytes) -> str:
    """The characters that stand for bytes."""
    return entry.decode("latin-1").translate(_MAPPED)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ``rank + 1`` is the entry of that rank; piece 0 is the unknown one."""
    out = [_message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))]
    for rank, entry in enumerate(entries):
        out.append(_message(1, _message(1, mapped(entry).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)))
    trainer = _number(3, 2) + _number(4, len(entries) + 1)
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _message(2, trainer) + _message(3, normaliser)


class Codec:
    """Encodes and decodes slices of texts."""

    def __init__(self, entries: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise(entries))
        self._find = regex.compile(pattern).findall
        self._wide = regex.compile(r"[^\S\x20\x09-\x0D]").search
        self._rank = {entry: rank for rank, entry in enumerate(entries)}
        # the inverse mapping: piece -> characters -> bytes
        pieces = [self._model.id_to_piece(i + 1).encode("utf-16-le") for i in range(len(entries))]
        low = [(np.frombuffer(p, dtype="<u2") - SHIFT).astype(np.uint8) for p in pieces]
        self._lens = np.array([len(p) for p in low], dtype=np.int64)
        self._at = np.concatenate([[0], np.cumsum(self._lens)])
        self._bytes = np.concatenate(low)
        self._pieces: dict[bytes, bytes] = {}
        # whether a run of letters behind one space at most is always one match
        self._plain = all(self._find(t) == [t] for t in (" a", "a", " \u00e9b", "\u00dfA"))

    def _learn(self, missing: list[bytes]) -> None:
        """Encode pieces not seen yet."""
        joined = b"".join(missing)
        # every byte as one character, so that pre-tokens are slices of this
        wide = (np.frombuffer(joined, dtype=np.uint8).astype("<u2") + SHIFT).tobytes().decode("utf-16-le")
        parts: list[bytes | int] = []
        bounds, items, at = [0], [], 0
        for piece in missing:
            text = piece.decode()
            body = text[1:] if text[0] == " " else text
            # letters of the first blocks of Unicode, behind one space at most, are one match of the pattern
            tokens = (piece,) if self._plain and body.isalpha() and max(body) < _STABLE else [t.encode() for t in self._find(text)]
            for token in tokens:
                rank = self._rank.get(token)
                if rank is None:
                    parts.append(len(items))
                    items.append(wide[at : at + len(token)])
                else:
                    parts.append(rank.to_bytes(4, "little"))
                at += len(token)
            bounds.append(len(parts))
        coded = self._model.encode(items, out_type=int, num_threads=1)
        cuts = np.zeros(len(coded) + 1, dtype=np.int64)
        np.cumsum([len(c) for c in coded], out=cuts[1:])
        flat = (np.fromiter(chain.from_iterable(coded), dtype=np.int64, count=int(cuts[-1])) - 1).astype("<u4").tobytes()
        cuts = (cuts * 4).tolist()
        parts = [p if isinstance(p, bytes) else flat[cuts[p] : cuts[p + 1]] for p in parts]
        for piece, a, b in zip(missing, bounds, bounds[1:]):
            self._pieces[piece] = parts[a] if b == a + 1 else b"".join(parts[a:b])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's ids start."""
        space = W.SPACE[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[:-1] = data == 32
        cut[:-1][:-1] &= ~space[1:]
        # the last byte of a text has no next one: what follows is another text
        cut[offs[1:] - 1] = False
        high = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(data >= 0x80, out=high[1:])
        for i in np.flatnonzero(high[offs[1:]] > high[offs[:-1]]):
            a, b = offs[i], offs[i + 1]
            if self._wide(data[a:b].tobytes().decode()):
                cut[a:b] = False
        cut[offs] = True
        bounds = np.flatnonzero(cut)
        sizes = np.diff(bounds)
        keep = sizes > 0
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        pieces = column.dictionary.to_pylist()
        if len(self._pieces) > REMEMBERED:
            self._pieces.clear()
        missing = [p for p in pieces if p and p not in self._pieces]
        if missing:
            self._learn(missing)
        coded = [self._pieces[p] if p else b"" for p in pieces]
        codes = column.indices.to_numpy()
        counts = np.array([len(c) >> 2 for c in coded], dtype=np.int64)[codes] if len(coded) else np.zeros(0, np.int64)
        ids = np.frombuffer(b"".join([coded[c] for c in codes[keep].tolist()]), dtype="<u4")
        run = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(np.where(keep, counts, 0), out=run[1:])
        return ids, run[np.searchsorted(bounds, offs)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and where the bytes of each id start."""
        sizes = self._lens[ids]
        starts = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(sizes, out=starts[1:])
        at = np.repeat(self._at[ids] - starts[:-1], sizes)
        at += np.arange(len(at))
        return self._bytes[at], starts


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (binary, little-endian unsigned 32-bit), ``decoded`` (binary), both of the whole text."""
    entries = load_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(entries, pattern)
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, end, part, cuts in W.slices(data, offs, 2 * W.SMALL):
                ids, at = codec.encode(part, cuts)
                raw, starts = codec.decode(ids)
                columns = [
                    _binary(at * 4, ids.astype("<u4").view(np.uint8)),
                    _binary(starts[at], raw),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], *columns], ["id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def _binary(offs: np.ndarray, data: np.ndarray) -> pa.Array:
    wide = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return wide.cast(pa.binary())


def digest(coded: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and digests of encoded rows; computed by Spark on the operator's binary columns."""
    return coded.select(
        id_col,
        *keep,
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )



def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))
