"""The arrays that the language model is counted and scored with."""

import tracemalloc

import numpy as np
import pyarrow as pa

from leadloom.llm import lm_scoring
from leadloom.llm.words import _BASE, mix

TEXTS = ["The cat  sat\non THE mat", "", " \t", "a", "ab", "abc de f", "Grüße an alle", "x" * 40 + " y", None, "the cat sat"]


def stream_of(texts):
    raw = [(t or "").encode() for t in texts]
    return lm_scoring.Stream(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))


def hashed(word: bytes) -> int:
    return sum((b + 1) * int(_BASE) ** i for i, b in enumerate(word)) % (1 << 64)


def mixed(value: int) -> int:
    return int(mix(np.array([value % (1 << 64)], np.uint64))[0])


def plain_contexts(text):
    """Slots of each byte's three contexts and its place in the word, byte by byte."""
    words = [w.lower() for w in (text or "").encode().split()]
    line = b" ".join(words) + b"\n"
    before, word, at = 0, b"", 0
    for i, byte in enumerate(line):
        four = int.from_bytes((b"\n" * 4 + line[:i])[-4:], "big")
        own = hashed(word)
        made = (four, own, own + mixed(before + 99))
        yield [mixed(c + k + 1) >> 64 - lm_scoring.BITS[k] for k, c in enumerate(made)] + [min(at, 15)]
        word, at = word + bytes([byte]), at + 1
        if byte in b" \n":
            before, word, at = hashed(word[:-1]), b"", 0


def test_contexts_against_plain_python():
    stream = stream_of(TEXTS).prepare()
    wanted = [row for t in TEXTS for row in plain_contexts(t)]
    assert list(zip(*(c.tolist() for c in stream.contexts), stream.letters.tolist())) == [tuple(r) for r in wanted]
    assert (stream.hashes() == stream.words.hashes()).all() and len(stream.hashes()) == stream.words.count.sum()


def test_counts_against_decisions_one_by_one():
    stream = stream_of(TEXTS).prepare()
    tree = lm_scoring.Tree.of(np.bincount(stream.pairs(), minlength=1 << 16))
    counts = [np.zeros(2 << bits, np.int64) for bits in lm_scoring.BITS]
    for i, pair in enumerate(stream.pairs()):
        for decision in tree.decision[tree.start[pair]:][:tree.length[pair]].tolist():
            for k, bits in enumerate(lm_scoring.BITS):
                slot = (int(stream.contexts[k][i]) + (decision & 0xFFFF)) % (1 << bits)
                counts[k][2 * slot + (decision >> 24)] += 1
    wanted = np.concatenate(counts)
    made = np.zeros(len(wanted), np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["text"])
    for blocks in lm_scoring._context_counts(tree)(iter([batch])):
        for block, small in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist()):
            start = 2 * block * lm_scoring.BLOCK
            made[start:start + 2 * lm_scoring.BLOCK] = np.frombuffer(lm_scoring.zlib.decompress(small), np.uint8)
    assert (made == wanted).all()


def test_look_ups_need_no_conversion():
    """numpy looks up and counts by index-wide numbers several times faster than by narrower ones."""
    stream = stream_of(TEXTS).prepare()
    tree = lm_scoring.Tree.of(np.ones(1 << 16, np.int64))
    at = np.arange(len(stream.data))
    _, gate, _, slots = stream.decisions(tree, at)
    assert {a.dtype for a in (gate, *slots, *stream.outcomes(tree, at))} == {np.dtype(np.intp)}


def test_counting_holds_its_tables_and_little_else():
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(100_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 4)], ["text"])
    tree = lm_scoring.Tree.of(np.ones(1 << 16, np.int64))
    tracemalloc.start()
    for _ in lm_scoring._context_counts(tree)(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tables = 4 * 2 * lm_scoring._TOP[-1]
    assert peak < tables + 100_000_000  # 287 MB when decisions were gathered and counted into a second table
