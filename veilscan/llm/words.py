"""Words and hashes of many texts at once, on the bytes of an Arrow column.

All functions work on ``data`` (the UTF-8 bytes of the texts one after another) and ``offs`` (where each
text starts, one more than there are texts). Words are ``[^\\x20\\x09-\\x0D]+``; no word crosses a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Bytes of a slice whose steps hold many wide numbers for each byte: a worker keeps what its largest step took.
SMALL = 1 << 19


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut into runs of whole texts of about ``most`` bytes (or one longer text): first, end, data, offs."""
    first, n = 0, len(offs) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of the first word (one more at the end).

    ``space`` tells for each byte whether it stands between words.
    """
    return runs(~space[data], offs)


def runs(word: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``spans``, of the maximal runs of True bytes within texts."""
    edge = np.zeros(len(word) + 1, dtype=bool)
    edge[offs] = True
    first = word & edge[:-1]
    first[1:] |= word[1:] & ~word[:-1]
    last = word & edge[1:]
    last[:-1] |= word[:-1] & ~word[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, each followed by ``gap`` zeros, and where each starts (one more at the end)."""
    lengths = ends - starts
    cuts = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths + gap, out=cuts[1:])
    out = np.zeros(int(cuts[-1]), dtype=np.uint8)
    inside = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out[np.arange(len(inside)) + np.repeat(gap * np.arange(len(starts)), lengths)] = data[inside]
    return out, cuts


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings."""
    out, cuts = packed(data, starts, ends)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(out))


def prefix(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers the first i values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, from running sums; equal spans have equal hashes wherever they stand."""
    h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word. Different words share one with probability near 2**-64."""
    return span_hash(prefix(data.astype(np.uint64) + np.uint64(1)), starts, ends)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of the n-word windows that start at each word, also across texts (filter those out)."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[k : k + count]
    return mix(out + np.uint64(n))


def inside(firsts: np.ndarray, n: int) -> np.ndarray:
    """True at words where an n-word window starts that stays in its text; firsts as from ``spans``."""
    total = int(firsts[-1])
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(total)
    return left >= n


def owners(firsts: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def repeated(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """True where another entry of the same group has the same key (both 64 bits, mixed into one)."""
    both = keys ^ mix(groups.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
