"""Ids of many texts at once: words are found, lowered and hashed in numpy, and only words not met before are encoded.

Most pieces between white space are letters, or letters and one sign; their words are known by the lowered bytes.  Any other
piece is known as it stands and encoded in the plain way.  What is known is kept in flat arrays: a 64-bit hash, the
length and the first eight bytes tell words apart.  A text in which two words share a hash but not the rest, or that
holds white space beyond ASCII or the start of an added token, is encoded by itself in the plain way.
"""

import numpy as np

from leadloom.llm.bpe import Bpe
from leadloom.llm.words import LOWER, SPACE, Words

#: Words and ids that are kept from text to text (at most some 60 MB together); beyond, all are forgotten.
KNOWN, IDS = 1_000_000, 5_000_000
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_OTHER = np.uint64(0x5851F42D4C957F2D)  # tells whole pieces from words
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class _Grown:
    """A flat array that grows."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1024, kind), 0

    def extend(self, values) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)


class BatchEncoder:
    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self._forget()

    def _forget(self) -> None:
        """Only the single signs are known, in the places of their bytes."""
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.start, self.count = _Grown(np.uint32), _Grown(np.int64), _Grown(np.int32)
        self.size, self.head = _Grown(np.int32), _Grown(np.uint64)
        signs = [self.bpe.piece_ids(chr(b)) if _SIGN[b] and not SPACE[b] else [] for b in range(128)]
        self._add(signs, [1] * 128, [0] * 128)

    def _add(self, ids: list[list[int]], size, head) -> np.ndarray:
        """The places of newly encoded words."""
        first, count = self.start.n, np.array(list(map(len, ids)), np.int64)
        self.start.extend(self.ids.n + np.cumsum(count) - count)
        self.count.extend(count)
        self.size.extend(size)
        self.head.extend(head)
        self.ids.extend([i for one in ids for i in one])
        return np.arange(first, first + len(ids), dtype=np.int32)

    def _places(self, keys: np.ndarray, first: np.ndarray, new) -> np.ndarray:
        """The place of each of the sorted keys; ``new`` gives (ids, sizes, heads) of those not known."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        out = np.empty(len(keys), np.int32)
        out[known] = self.place[at[known]]
        if not known.all():
            out[~known] = self._add(*new(first[~known]))
            merged = np.concatenate([self.keys, keys[~known]])
            order = np.argsort(merged, kind="stable")  # two sorted runs
            self.keys, self.place = merged[order], np.concatenate([self.place, out[~known]])[order]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.keys) > KNOWN or self.ids.n > IDS:
            self._forget()
        low, letter = _lowered(data)
        raw, words = Words(data, offsets), Words(low, offsets)
        if not len(raw.start):
            return [b""] * (len(offsets) - 1) if not _odd(data, offsets).any() else self._plainly(data, offsets)
        start, end = raw.start, raw.end
        others = np.concatenate([np.zeros(1, np.int32), np.cumsum(~letter, dtype=np.int32)])
        others = others[end] - others[start]
        signed = (others == 1) & _SIGN[data[end - 1]] & (end - start > 1)
        whole = (others > 0) & ~signed
        stop = end - signed
        keys = words.hashed(start, stop)
        keys[whole] = raw.hashed(start[whole], end[whole]) ^ _OTHER
        size = stop - start
        head = np.where(whole, _heads(data)[start], _heads(low)[start]) & _MASKS[np.minimum(size, 8)]

        def new(rows: np.ndarray):
            made = []
            for s, e, w in zip(start[rows].tolist(), stop[rows].tolist(), whole[rows].tolist()):
                made.append(self.bpe.piece_ids(data[s:e].tobytes().decode()) if w else self.bpe.word_ids(low[s:e].tobytes()))
            return made, size[rows], head[rows]

        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        place = self._places(unique, first, new)[back]
        plain = ~_odd(data, offsets)
        wrong = (self.size.data[place] != size) | (self.head.data[place] != head)
        if wrong.any():
            plain[raw.row[wrong]] = False
        # A piece is one unit, or a word and its sign.
        units = np.cumsum(1 + signed) - (1 + signed)
        every = np.empty(units[-1] + 1 + signed[-1], np.int32)
        every[units] = place
        every[units[signed] + 1] = data[end[signed] - 1]
        count = self.count.data[every].astype(np.int64)
        ends = np.cumsum(count)
        flat = self.ids.data[np.repeat(self.start.data[every] - (ends - count), count) + np.arange(ends[-1])].astype("<u4", copy=False)
        before = np.concatenate([units, [len(every)]])[raw.first]  # units before each text
        borders = np.concatenate([np.zeros(1, np.int64), ends])[before]
        return [flat[borders[k]:borders[k + 1]].tobytes() if plain[k] else self._alone(data, offsets, k) for k in range(len(plain))]

    def _alone(self, data: np.ndarray, offsets: np.ndarray, k: int) -> bytes:
        return np.array(self.bpe.encode(data[offsets[k]:offsets[k + 1]].tobytes().decode()), "<u4").tobytes()

    def _plainly(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        return [self._alone(data, offsets, k) for k in range(len(offsets) - 1)]


def _heads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case and whether each belongs to a letter, for ASCII and the Latin letters of two bytes from C3."""
    low, letter = LOWER[data], _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    after = data[lead + 1]
    fine = lead[(after != 0x97) & (after != 0xB7)]
    letter[fine] = letter[fine + 1] = True
    capital = fine[data[fine + 1] <= 0x9E]
    low[capital + 1] += 0x20
    return low, letter


def _odd(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts with white space beyond ASCII or with the start of an added token."""
    odd = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero((data == 0x3C) | (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(at):
        return odd
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    found = (((a == 0x3C) & (b == 0x7C)) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
             | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
             | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))
    odd[np.searchsorted(offsets, at[found], "right") - 1] = True
    return odd
