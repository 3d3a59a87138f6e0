"""Vectorised words and word hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240229)
#: One random 64-bit value for each byte, and an odd multiplier for the position.
_BYTE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of words: everything but ASCII white space, or ASCII letters, digits and all beyond ASCII.
NOT_SPACE = np.array([b not in (0x20, *range(0x09, 0x0E)) for b in range(256)])
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0][:n], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a slice of texts: byte spans, a hash each, and where each text's words begin."""

    def __init__(self, values: pa.Array, kind: np.ndarray, lower: bool = True):
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        whole = values.buffers()[2]
        self.data = bytes(memoryview(whole)[int(offsets[0]) : int(offsets[-1])]) if whole is not None else b""
        if lower:
            self.data = self.data.translate(LOWER)
        offs = offsets - offsets[0]
        raw = np.frombuffer(self.data, np.uint8)
        inside = kind[raw]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offs[(offs > 0) & (offs < len(raw))]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offs)  # of each text, and past the last
        power, inverse = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
        self.hashes = mixed((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; the last n-1 of the slice have none."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        out = self.hashes[:count].copy()
        for j in range(1, n):
            out *= _STEP
            out += self.hashes[j : j + count]
        return mixed(out)

    def phrase(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[s:e] for s, e in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist()))
