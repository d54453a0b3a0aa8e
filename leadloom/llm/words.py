"""Words of whole texts as numpy arrays, for use inside Arrow batches.

A text column is read as its UTF-8 bytes, some documents at a time, so that no Python string is made
per word.  A word is a run of bytes outside space and 09-0D; words never cross documents.
"""

import numpy as np
import pyarrow as pa

#: Arrays made of a chunk take some 100 bytes for each of its bytes, in every Python worker.
CHUNK_BYTES = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_U = np.uint64
_PART = 1 << 14
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is no letter; bytes of longer characters count as letters.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> _U(32))) * _MULT
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def top_bits(h: np.ndarray, add: int, bits: int) -> np.ndarray:
    """The first ``bits`` (at most 32) bits of ``mix(h + add)``, some numbers at a time so that they stay in the processor's cache."""
    made = np.empty(len(h), np.uint32)
    for i in range(0, len(h), _PART):
        part = h[i:i + _PART] + _U(add)
        part ^= part >> _U(32)
        part *= _MULT
        part ^= part >> _U(29)
        part *= _U(0xBF58476D1CE4E5B9)
        part >>= _U(64 - bits)
        made[i:i + _PART] = part
    return made


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = _BASE if kind == "up" else _U(pow(int(_BASE), -1, 1 << 64))
        full = np.full(max(n, CHUNK_BYTES + 1), step, np.uint64)
        full[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.cumprod(full, dtype=np.uint64)
    return _powers[kind][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each text in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):  # 32-bit offsets; the bytes are read where they are
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, places, data = column.buffers()
    offsets = np.zeros(1, np.int64) if places is None or not places.size else (
        np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64))
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, last row, bytes, offsets) of consecutive rows with about ``limit`` bytes; a longer text is one chunk."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, last, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


class Words:
    """Words of some texts: start and end byte, row of the text, and counts per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = SPACE):
        self.data, self.offsets = LOWER[data] if lower else data, offsets
        self.texts = len(offsets) - 1
        n = len(data)
        inside = np.empty(n + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(gaps[data], out=inside[1:-1])
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut)) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut)) if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)  # number of words before each text
        self.count = np.diff(self.first)
        self._sums = None

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.count)

    def sums(self) -> np.ndarray:
        """Prefix sums from which the hash of any byte range follows."""
        if self._sums is None:
            n = len(self.data)
            with np.errstate(over="ignore"):
                self._sums = np.zeros(n + 1, np.uint64)
                np.cumsum((self.data.astype(np.uint64) + _U(1)) * _power("up", n), out=self._sums[1:])
        return self._sums

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        sums = self.sums()
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * _power("down", len(self.data) + 1)[start])

    def hashes(self) -> np.ndarray:
        return self.hashed(self.start, self.end)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and the number per text; a text of fewer words is one run."""
    h = words.hashes()
    runs = np.where(words.count >= n, words.count - n + 1, np.minimum(words.count, 1))
    where = np.repeat(words.first[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    left = np.repeat(words.first[1:], runs)
    out = np.zeros(len(where), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            there = where + k < left
            out = (out + np.where(there, h[np.minimum(where + k, max(len(h) - 1, 0))] if len(h) else _U(0), _U(k + 1))) * _MULT
            out ^= out >> _U(31)
        return mix(out), runs


def sorted_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in order, and their number per text."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.bincount(row[new], minlength=len(counts))
