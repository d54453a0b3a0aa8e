"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can end its encoding: a vocabulary token that is a suffix of
the prefix, and that may stand after the last token of the prefix before it.  An automaton of the vocabulary gives the
suffixes, a test on pairs of tokens the rest, and back-pointers from the whole word give the ids.  A pair may
stand side by side if undoing the merges of both, latest first, never shows a pair at their border that the
merge list would have joined earlier.

Text is prepared as the vocabulary file says: NFC, lower case per character, then contractions, runs of letters, single
digits and runs of other signs, each a word with an end mark.  Strings of the added tokens in a text are those
tokens.  Null counts as empty; an empty text has no ids.  Repeated rows are encoded row by row.
"""

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leadloom.llm.tables import per_text, texts

CACHED = 300_000
CACHED_LENGTH = 64
_END = "\n"
# White space as the file's patterns mean it, and the file's word pattern.
_WHITE = "\t\n\v\f\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
_GAPS = re.compile(f"[{_WHITE}]+")
#: str.split() also cuts at these, the patterns don't.
_OTHER_GAPS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where Latin-1 prints it, else one from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder of one vocabulary; ``view`` is what is kept and joined of each piece of text."""

    def __init__(self, file: bytes, view: Callable[[list[int], "Bpe"], object], cached: int = CACHED):
        spec = json.loads(file)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        names = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.decimals = [str(i) for i in range(len(self.names))]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")")
        self._letters = {b: letter for b, letter in enumerate(_byte_letters())}
        self._view, self._cached = view, cached
        # parts and rank of the merge that makes a token; a token without merge is a letter.
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        self._split: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[left + right]
            self._merge.setdefault((vocab[left], vocab[right]), (rank, made))
            self._split.setdefault(made, (vocab[left], vocab[right], rank))
        self._automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            whole = text[:-len(suffix)] + _END if text.endswith(suffix) and text != suffix else text
            letters = len(whole) - whole.endswith(_END)
            if letters == 1 or i in self._split:
                self._automaton.add_word(whole, (i, len(whole)))
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._words: dict[str, list[int]] = {}
        self._pieces: dict[str, object] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their letters stand side by side."""
        split, merge = self._split, self._merge
        # Ranks of the merges that take the tokens at the border into larger ones; none yet.
        left_by = right_by = 1 << 30
        while True:
            rank = merge.get((left, right), (1 << 30,))[0]
            # Of equal merges the leftmost is done first: the border comes after the left one, before the right one.
            if rank < left_by and rank <= right_by and rank < 1 << 30:
                return False
            a, b = split.get(left), split.get(right)
            if a is None and b is None:
                return True
            # Undo the later merge; of equal ones the right, which was done last.
            if b is None or a is not None and a[2] > b[2]:
                left, left_by = a[1], a[2]
            else:
                right, right_by = b[0], b[2]

    def word(self, letters: str) -> list[int]:
        """Ids of one word, its bytes as letters."""
        text = letters + _END
        last = [0] * (len(text) + 1)  # the token that ends the encoding of each prefix
        length = [0] * (len(text) + 1)
        known = self._fits
        for end, (token, size) in self._automaton.iter(text):
            stop = end + 1
            if length[stop]:
                continue
            start = stop - size
            if start:
                # Only the prefix that lacks the word's end mark alone has no last token.
                if not length[start]:
                    continue
                key = last[start] << 20 | token
                fit = known.get(key)
                if fit is None:
                    if len(known) > 4 * self._cached:
                        known.clear()
                    fit = known[key] = self.fits(last[start], token)
                if not fit:
                    continue
            last[stop], length[stop] = token, size
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= length[at]
        out.reverse()
        return out

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one lowered word, given as its bytes."""
        return self.word(word.decode("latin-1").translate(self._letters))

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of a stretch without white space."""
        if piece.isascii():
            piece = piece.lower()
        else:
            piece = "".join([c.lower() for c in unicodedata.normalize("NFC", piece)])
        # Mostly a piece is letters, or letters and one sign; isalpha() and isalnum() are the classes of the pattern.
        if piece.isalpha():
            words = (piece,)
        elif piece[:-1].isalpha() and not piece[-1].isalnum():
            words = (piece[:-1], piece[-1])
        else:
            words = _WORD.findall(piece)
        out: list[int] = []
        for word in words:
            ids = self._words.get(word)
            if ids is None:
                ids = self.word_ids(word.encode())
                if len(word) <= CACHED_LENGTH:
                    if len(self._words) >= self._cached:
                        self._words.clear()
                    self._words[word] = ids
            out += ids
        return out

    def views(self, text: str) -> list:
        """The views of the pieces of a text, in order."""
        out = []
        known = self._pieces
        for part in self._added.split(text) if "<|" in text else (text,):
            if part in self.added:
                out.append(self._view([self.added[part]], self))
                continue
            for piece in filter(None, _GAPS.split(part)) if _OTHER_GAPS.search(part) else part.split():
                view = known.get(piece)
                if view is None:
                    view = self._view(self.piece_ids(piece), self)
                    if len(piece) <= CACHED_LENGTH:
                        if len(known) >= self._cached:
                            known.clear()
                        known[piece] = view
                out.append(view)
        return out

    def encode(self, text: str) -> list[int]:
        """All ids of a text; needs the view ``as_ids``."""
        return [i for ids in self.views(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so the tokens are joined by spaces; ids outside the vocabulary are left out."""
        names = self.names
        return " ".join([names[i] for i in ids if i < len(names)])


def as_ids(ids: list[int], _: Bpe) -> list[int]:
    return ids


def as_text(ids: list[int], bpe: Bpe) -> tuple[int, str, str]:
    """Number of ids, the ids in decimal, and their decoded text."""
    decimals, names = bpe.decimals, bpe.names
    return len(ids), " ".join([decimals[i] for i in ids]), " ".join([names[i] for i in ids])


_made: dict[tuple, Bpe] = {}


def encoder(file: bytes, view: Callable, cached: int = CACHED) -> Bpe:
    """One encoder per Python worker, so words met before are not encoded again."""
    key = (hash(file), view.__name__, cached)
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(file, view, cached)
    return _made[key]


def shared_file(docs: DataFrame, path: str):
    """The vocabulary file (some megabytes, whatever the data) as a broadcast."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _digests(column: pa.Array, bpe: Bpe) -> dict:
    n, ids, decoded = array("q"), [], []
    for text in column:
        counts, decimal, names = zip(*views) if (views := bpe.views(text.as_py() or "")) else ((), (), ())
        n.append(sum(counts))
        ids.append(hashlib.sha256(" ".join(decimal).encode()).hexdigest())
        decoded.append(hashlib.sha256(" ".join(names).encode()).hexdigest())
    return {"n_tokens": np.array(n, np.int64), "ids_sha256": ids, "decoded_sha256": decoded}


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text of every document."""
    docs = texts(docs)
    file = shared_file(docs, path)

    def work(column):
        bpe = encoder(file.value, as_ids)
        ids = [bpe.encode(t.as_py() or "") for t in column]
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(map(bpe.decode, ids), pa.string())}

    return per_text(docs, "ids array<int>, decoded string", work)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal and of the decoded text, without shipping either."""
    docs = texts(docs)
    file = shared_file(docs, path)
    return per_text(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                    lambda column: _digests(column, encoder(file.value, as_text)))
