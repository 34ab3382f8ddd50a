"""CRC-32 of any substrings of a byte array, from running CRCs: one scan, then two look-ups for each substring.

The CRC of ``AB`` is the CRC of ``A``, shifted over the bits of ``B``, plus (xor) the CRC of ``B``. So with the running
CRCs at both ends of a substring its own CRC is the later one plus the earlier one shifted by the substring's length:
what stood before cancels. Shifting is multiplication by a power of x in GF(2)[x] modulo the CRC's polynomial, linear in
the bits, and is done by four look-ups, one for each byte of a CRC.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: The polynomial of CRC-32 (ISO-HDLC, as in zlib), lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320
#: Bytes of a lane; all lanes of an array are scanned side by side.
LANE = 64


@cache
def _bytes_table() -> np.ndarray:
    """The CRC register after one byte, for each low byte of the register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1)).astype(np.uint32)
    return table


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Apply a linear map that is given as one table for each byte of its argument."""
    out = tables[0][crc & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _units() -> np.ndarray:
    """The identity as tables: entry (k, b) is byte b at place k."""
    return np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]


@cache
def _doubling(power: int) -> np.ndarray:
    """Tables that shift a CRC over 2**power bytes."""
    if power == 0:
        units = _units()
        return _bytes_table()[units & np.uint32(255)] ^ (units >> np.uint32(8))
    half = _doubling(power - 1)
    return _through(half, half)


@cache
def _short() -> np.ndarray:
    """Tables that shift a CRC over 0, 1, ... LANE - 1 bytes, as one array (LANE, 4, 256)."""
    out = [_units()]
    for _ in range(LANE - 1):
        out.append(_through(_doubling(0), out[-1]))
    return np.stack(out)


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC shifted over as many bytes as ``lengths`` says."""
    lengths = lengths.astype(np.int64)
    near, far = lengths % LANE, lengths // LANE
    tables = _short()
    out = tables[near, 0, crc & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[near, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    power = LANE.bit_length() - 1
    while far.any():
        at = np.flatnonzero(far & 1)
        if len(at):
            out[at] = _through(_doubling(power), out[at])
        far, power = far >> 1, power + 1
    return out


def running(data: np.ndarray) -> np.ndarray:
    """CRC-32 of data[:i] for every i from 0 to len(data).

    Lanes of LANE bytes are scanned side by side, each from nothing; their CRCs are then summed up along the array in
    steps that double, and every entry gets the CRC of all lanes before its own, shifted to its place.
    """
    n = len(data)
    lanes = n // LANE + 1
    padded = np.zeros(lanes * LANE, dtype=np.uint8)
    padded[:n] = data
    columns = padded.reshape(lanes, LANE).T.copy()
    inside = np.empty((LANE + 1, lanes), dtype=np.uint32)
    inside[0] = 0xFFFFFFFF
    table = _bytes_table()
    for k in range(LANE):
        state = inside[k]
        inside[k + 1] = table[(state ^ columns[k]) & np.uint32(255)] ^ (state >> np.uint32(8))
    inside ^= np.uint32(0xFFFFFFFF)
    before = np.zeros(lanes, dtype=np.uint32)
    before[1:] = inside[LANE, :-1]
    step, power = 1, LANE.bit_length() - 1
    while step < lanes:
        # entry k covers the lanes from k - step to k - 1; the step before it is shifted over them
        added = _through(_doubling(power), before[:-step])
        before[step:] ^= added
        step, power = step * 2, power + 1
    short = _short()
    out = np.empty((lanes, LANE), dtype=np.uint32)
    for k in range(LANE):
        out[:, k] = inside[k] ^ _through(short[k], before)
    return out.reshape(-1)[: n + 1]


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end], ``sums`` from ``running``."""
    return sums[ends] ^ shift(sums[starts], ends - starts)


def joined(first: np.ndarray, second: np.ndarray, second_lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings one after another, from the CRC of each."""
    return shift(first, second_lengths) ^ second
