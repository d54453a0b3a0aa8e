"""Ids of batches against the tokenizer library, text by text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leadloom.llm import bpe, bpe_batches
from leadloom.llm.words import chunks

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a b x", "<|endoftext|> hi", "", " ", " \x1c x\x1f", "é ü “q” x", "　a", "a b", "<| a", "a" * 100_000, "é é", "\x85", "É", "ÀÉß× x÷y Éa.",
       "ab. c, d; (x) it's 12a a1 ñÑ!", "é", "Áb Ç.", "x\x00y\x7f", "\xa0", "İI ıi ŞẞΣς", "漢字 かな。 \U0001F600!", "don't 'S we'LL", "...", "a.b", "ª µ"]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def ids(encoder, texts, limit=1 << 20):
    return [np.frombuffer(one, "<u4").tolist() for _, _, data, offsets in chunks(pa.array(texts, pa.string()), limit) for one in encoder.encode(data, offsets)]


def test_against_the_library(docs, library):
    texts = [r.text for r in docs.collect()] + ODD
    random.seed(8)
    signs = "aZé ÉßñÑ.,'’-–×9²\t\n\x1d́​漢<|"
    texts += ["".join(random.choices(signs, k=random.randrange(30))) for _ in range(3000)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = bpe_batches.BatchEncoder(bpe.Bpe(open(PATH, "rb").read(), bpe.as_ids, 500))
    for limit in (1 << 20, 3000):
        got = ids(encoder, texts, limit)
        assert [t for t, a, b in zip(texts, got, want) if a != b] == []
    assert ids(encoder, [None, ""]) == [[], []] and ids(encoder, []) == []


def test_registered_digests(spark, docs, library):
    """Both digests of the registered path against the library's ids and decoded text."""
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(docs, PATH).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_forgetting_and_equal_hashes(docs, library, monkeypatch):
    texts = [r.text for r in docs.limit(60).collect()]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe_batches, "KNOWN", 50)
    encoder = bpe_batches.BatchEncoder(bpe.Bpe(open(PATH, "rb").read(), bpe.as_ids))
    assert ids(encoder, texts, 2000) == want
    # Hashes of which only a few bits are left: the length and the first bytes tell most words apart, the rest goes the plain way.
    monkeypatch.setattr(bpe_batches.Words, "hashed", lambda self, start, end: (end - start).astype(np.uint64))
    assert ids(bpe_batches.BatchEncoder(bpe.Bpe(open(PATH, "rb").read(), bpe.as_ids)), texts, 2000) == want
