"""Quality rules: a hashed n-gram likelihood ratio between trusted texts and the raw corpus.

Every run of four bytes of a lower-cased text falls in one of 2**16 buckets.  Two multinomials are counted: over
the texts that labels call good (trusted target) and over all texts (raw corpus).  A text's score is the
mean of log(target/raw) over its n-grams, in whole micro-nats, so it is the same in any order of work.  ``score``
counts every row; ``distinct_score`` counts each distinct text once, so that no group of copies can move other texts,
and texts whose distinct_score is below a fixed threshold are rejected.  Plain rules come first: at least 50 words, and at most half of the
words in word triples that repeat.

Nulls and empty texts have no words and fail the plain rules.  Texts under four bytes score 0.  Repeated rows and
ties are judged row by row.  With no trusted text the ratio is 0 everywhere, and only the plain rules reject.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tables import distinct_texts, kept_rows, labelled, per_text, texts
from leadloom.llm.words import LOWER, Words, chunks, shingles

GRAM = 4
BUCKETS = 1 << 16
MIN_WORDS = 50
MAX_REPEATED = 50
THRESHOLD = -0.2
MICRO = 1_000_000
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPACED = np.isin(np.arange(256), [0x20, *range(9, 14)])
_FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, distinct_score double"


def _buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; the last three places have none."""
    low = LOWER[data].astype(np.uint32)
    if len(low) < GRAM:
        return np.zeros(0, np.uint32)
    gram = low[:-3] | (low[1:-2] << 8) | (low[2:-1] << 16) | (low[3:] << 24)
    return ((gram ^ (gram >> 15)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _per_text(running: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sums over [start, stop) of each text from running sums with a leading zero."""
    return running[np.maximum(stop, start)] - running[start]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            found = _buckets(data)
            # An n-gram that starts in the last three bytes of a text would cross into the next one.
            whole = np.ones(len(data), bool)
            for back in range(1, GRAM):
                ends = offsets[1:] - back
                whole[ends[ends >= 0]] = False
            total += np.bincount(found[whole[:len(found)]], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def ratios(docs: DataFrame, labels: DataFrame, once: bool) -> np.ndarray:
    """log(target/raw) for each bucket in micro-nats, over all documents or ``once`` for each distinct text; 2**16 numbers
    reach the driver."""
    def counted(df, name):
        return df.mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))

    good = labelled(docs, labels, "quality", F.min).where("label = 1").select("text")
    raw, good = (distinct_texts(docs), distinct_texts(good)) if once else (docs.select("text"), good)
    rows = counted(raw, "raw").join(counted(good, "target"), "bucket", "left").collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target or 0
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    # One part in 20 of the raw share smooths the target, so a rare n-gram is never far from even.
    share = raw / raw.sum()
    wanted = 0.95 * target / target.sum() + 0.05 * share
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(raw > 0, np.log(wanted / share), 0.0)
    return np.round(out * MICRO).astype(np.int64)


def features(column: pa.Array, *weights: np.ndarray) -> dict:
    """The plain counts of each text, and its score by each table of weights."""
    parts: list[tuple] = []
    for _, _, data, offsets in chunks(column):
        words = Words(data, offsets)
        row, n = words.row, words.texts
        spaced = _SPACED[data]
        chars = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~spaced)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
        found = _buckets(data)
        start, stop = offsets[:-1], offsets[1:]
        grams = np.maximum(stop - start - GRAM + 1, 0)
        scores = []
        for each in weights:
            weight = np.zeros(len(data) + 1, np.int64)
            np.cumsum(each[found], out=weight[1:len(found) + 1])
            scores.append(_per_text(weight, start, start + grams) / np.maximum(grams, 1) / MICRO)
        parts.append((words.count, _per_text(chars, start, stop), _per_text(symbols, start, stop),
                      _repeated_lines(words), _repeated_words(words, row, n),
                      *scores))
    names = [c.split()[0] for c in _FEATURES.split(", ")][:5] + ["score", "distinct_score"][-len(weights):]
    if not parts:
        return {n: np.zeros(0, np.float64 if n.endswith("score") else np.int64) for n in names}
    return {n: np.concatenate(x) for n, x in zip(names, zip(*parts))}


def _repeated_lines(words: Words) -> np.ndarray:
    """Lines that hold a word and equal an earlier line of their text."""
    breaks = np.flatnonzero(words.data == 10)
    start = np.unique(np.concatenate([breaks + 1, words.offsets[:-1]]))
    start = start[start < len(words.data)]
    row = np.searchsorted(words.offsets, start, "right") - 1
    # A line ends at the next break or with its text.
    end = np.append(breaks, len(words.data))[np.searchsorted(breaks, start)]
    end = np.minimum(end, words.offsets[row + 1])
    holds = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[holds], end[holds], row[holds]
    h = words.hashed(start, end)
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=words.texts)


def _repeated_words(words: Words, row: np.ndarray, texts_: int) -> np.ndarray:
    """Words that stand in a run of three words found at least twice in their text."""
    runs, _ = shingles(words, 3)
    first = np.flatnonzero((np.arange(len(row)) + 2) < words.first[1:][row])
    whole = np.repeat(words.count >= 3, np.where(words.count >= 3, words.count - 2, np.minimum(words.count, 1)))
    runs = runs[whole]
    order = np.lexsort((runs, row[first]))
    value, place = runs[order], row[first][order]
    same = (value[1:] == value[:-1]) & (place[1:] == place[:-1])
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(row) + 2, bool)
    for k in range(3):
        marked[first[twice] + k] = True
    return np.bincount(row[marked[:len(row)]], minlength=texts_)


def _failed(made: dict) -> np.ndarray:
    return (made["n_words"] < MIN_WORDS) | (100 * made["n_repeat_words"] > MAX_REPEATED * made["n_words"])


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score, base_failed and kept of every document."""
    docs = texts(docs)
    weights = ratios(docs, labels, once=False), ratios(docs, labels, once=True)

    def work(column):
        made = features(column, *weights)
        failed = _failed(made)
        return made | {"base_failed": failed, "kept": ~failed & (made["distinct_score"] >= threshold)}

    return per_text(docs, _FEATURES + ", base_failed boolean, kept boolean", work)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, that the rules keep."""
    weights = ratios(texts(docs), labels, once=True)

    def keep(column):
        made = features(column, weights)
        return ~_failed(made) & (made["distinct_score"] >= threshold)

    return kept_rows(docs, "text", keep)
