"""Results against plain Python over the small tables."""

import gzip
import io
import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from leadloom.llm import bpe, components, jaccard_join, lm_scoring, packing, quality_classifier, quality_rules, toxicity, vector_dedup, warc
from leadloom.llm.queries import QUERIES, SQL
from leadloom.llm.words import Words, chunks, shingles
from oracle import compare

PATH = public_tokenizers.path("word_bpe_49k.json")
GAP = re.compile("[\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return [w for w in GAP.split(text or "") if w]


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, folder, name):
    assert compare.differences(QUERIES[name](spark, folder), compare.connect(folder), SQL[name]) == []


def test_words(docs):
    column = pa.array([r.text for r in docs.collect()] + [None, "", " x", "a b c d e"], pa.string())
    texts = column.to_pylist()
    seen = {}
    for first, last, data, offsets in chunks(column, 50_000):
        words = Words(data, offsets)
        found = [bytes(data[s:e]).decode() for s, e in zip(words.start, words.end)]
        assert found == [w for t in texts[first:last] for w in split(t)]
        for word, h in zip(found, words.hashes().tolist()):
            assert seen.setdefault(word, h) == h
        runs, count = shingles(words, 5)
        assert count.tolist() == [max(len(split(t)) - 4, min(len(split(t)), 1)) for t in texts[first:last]]
    assert len(set(seen.values())) == len(seen)


def test_bands():
    for similarity in (0.5, 0.8, 0.9):
        bands, rows = jaccard_join.choose_bands(similarity, 0.999)
        assert 1 - (1 - similarity ** rows) ** bands >= 0.999 and bands * rows <= jaccard_join.MAX_HASHES


def brute_links(texts, similarity=0.8):
    sets = {}
    for i, t in texts.items():
        w = split(lower(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return {(a, b) for a in sets for b in sets if a < b and sets[a]
            and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}


def test_jaccard_blocks(spark, monkeypatch):
    """A hot group of different texts, in many blocks, keeps every link."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 16)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            words[k] = f"x{i}_{k}"
        texts[i] = " ".join(words)
    texts |= {1000 + i: f"other text {i} " * 9 for i in range(20)} | {2000: texts[3], 2001: texts[3].upper()}
    links = brute_links(texts)
    rows = jaccard_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    degree = Counter(x for pair in links for x in pair)
    assert {r.doc_id: r.n_links for r in rows} == {i: degree[i] for i in texts}
    reach = dict(zip(texts, texts))
    for _ in range(10):
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert {r.doc_id: r.class_id for r in rows} == reach


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 300), (200, 300), (5, 5)]
    rows = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bpe_ids_and_text(docs):
    library = Tokenizer.from_file(PATH)
    own = bpe.Bpe(open(PATH, "rb").read(), bpe.as_ids)
    rng = np.random.default_rng(5)
    names = [n for n in own.names if n]
    signs = list("abcdefgh '’.,!?ÄÖüßéèñ\u0301\u0308\n\t\u00a0\u3000Σσ中あ한١٢𝟙𝔸ﬀǆİ\x1c\x85")
    texts = [r.text or "" for r in docs.collect()]
    texts += ["".join(rng.choice(signs, rng.integers(1, 120))) for _ in range(800)]
    texts += ["".join(rng.choice(names, 5)).replace("</w>", "") for _ in range(1500)]
    texts += ["", "x<|endoftext|>y<|startoftext|>", "<|endoftext|", "a" * 5000, "don't 'the 'S we'll"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:60]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_pairs():
    """Two tokens fit exactly if the library gives them back for their joined letters."""
    own = bpe.Bpe(open(PATH, "rb").read(), bpe.as_ids)
    library = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(8)
    plain = [i for i, n in enumerate(own.names) if n.isascii() and n.removesuffix("</w>").isalpha() and n.islower()]
    left = [i for i in plain if not own.names[i].endswith("</w>")]
    right = [i for i in plain if own.names[i].endswith("</w>")]
    for a, b in zip(rng.choice(left, 3000), rng.choice(right, 3000)):
        word = own.names[a] + own.names[b].removesuffix("</w>")
        assert own.fits(a, b) == (library.encode(word, add_special_tokens=False).ids == [a, b])


def test_packing_pieces(docs):
    library = Tokenizer.from_file(PATH)
    rows = packing.packed(docs.repartition(3), PATH).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = library.encode(texts[doc], add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing_keeps_few_windows():
    packer = packing.Packer(0, window=64, windows=3)
    rng = np.random.default_rng(1)
    for doc in range(500):
        packer.add(doc, bytes(4 * int(rng.integers(1, 200))))
        assert len(packer.gaps) <= 3
    packer.finish()
    fill = Counter()
    for r in packer.rows:
        fill[r[5]] += r[2]
    assert all(n == 64 or n & (n - 1) == 0 for n in fill.values()) and sum(n < 64 for n in fill.values()) <= 6


def test_lm_base_and_model(docs):
    rows = {r.doc_id: r for r in lm_scoring.lm_scoring(docs).collect()}
    texts = {r.doc_id: split(lower(r.text)) + ["\n"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = Counter(w for i in texts if not held[i] for w in texts[i])
    n, v = sum(count.values()), len(count)
    for i, words in texts.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(words), n)
        assert r.n_known == sum(count[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert r.score < 0
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)


def test_lm_is_a_distribution():
    """Over all bytes that can come next the model's chances add up to one, whatever its tables hold."""
    rng = np.random.default_rng(2)
    tree = lm_scoring.Tree.of(rng.integers(0, 50, 1 << 16) * (rng.random(1 << 16) < 0.3))
    assert all(np.isclose((0.5 ** tree.length.reshape(256, 256)[b]).sum(), 1) for b in range(256))
    mixer = lm_scoring.Mixer(tree, rng.integers(-900, 900, lm_scoring._TOP[-1]).astype(np.int16),
                             rng.random((len(lm_scoring.BITS), lm_scoring.GATES)).astype(np.float32))
    # One-byte words: "x\n" for each byte, all but white space and capitals, against the same beginning.
    letters = [b for b in range(128) if not lm_scoring.SPACE[b] and not 65 <= b <= 90]
    data = np.array(letters, np.uint8)
    stream = lm_scoring.Stream(data, np.arange(len(letters) + 1)).prepare()
    first = stream.first
    logs = np.zeros(len(letters))
    for k, at in enumerate(first):
        _, gate, bit, slots = stream.decisions(tree, np.array([at]))
        z = sum(mixer.weight[j][gate] / 256 * x for j, x in enumerate(mixer.inputs(slots)))
        logs[k] = -np.log1p(np.exp(-np.where(bit, z, -z))).sum()
    assert 0 < np.exp(logs).sum() <= 1 + 1e-6


def test_lm_long_text_in_parts():
    """The score of a text doesn't depend on the texts around it."""
    rng = np.random.default_rng(4)
    tree = lm_scoring.Tree.of(np.ones(1 << 16, np.int64))
    mixer = lm_scoring.Mixer(tree, rng.integers(-900, 900, lm_scoring._TOP[-1]).astype(np.int16),
                             np.full((len(lm_scoring.BITS), lm_scoring.GATES), 0.3, np.float32))
    texts = [b"short", b"", bytes(rng.integers(97, 103, 150_000, dtype=np.uint8)), b"a b c " * 900]
    data = np.frombuffer(b"".join(texts), np.uint8)
    together, _, _ = mixer.score(data, np.cumsum([0] + [len(t) for t in texts]))
    for text, score in zip(texts, together):
        alone, _, _ = mixer.score(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert alone[0] == pytest.approx(score, rel=1e-6)


def test_rule_counts(docs, labels):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for d in docs.collect():
        text, words = d.text or "", split(d.text)
        runs = Counter(zip(words, words[1:], words[2:]))
        repeated = set()
        for k in range(len(words) - 2):
            if runs[tuple(words[k:k + 3])] > 1:
                repeated |= {k, k + 1, k + 2}
        lines = [line for line in text.split("\n") if split(line)]
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r.kept and r.base_failed)


def test_rule_ratio(docs, labels):
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {r.doc_id for r in labels.where("quality = 0").collect()}
    raw, target = Counter(), Counter()

    def grams(text):
        data = lower(text).encode()
        return quality_rules._buckets(np.frombuffer(data, np.uint8)).tolist()

    rows = docs.collect()
    for d in rows:
        raw.update(grams(d.text))
        if d.doc_id in good:
            target.update(grams(d.text))
    n, m = sum(raw.values()), sum(target.values())
    made = {r.doc_id: r.score for r in quality_rules.quality_rules(docs, labels).collect()}
    for d in rows[:60]:
        found = grams(d.text)
        want = np.mean([np.log(0.95 * target[g] / m / (raw[g] / n) + 0.05) for g in found]) if found else 0
        assert made[d.doc_id] == pytest.approx(want, abs=2e-6)


@pytest.fixture(scope="module")
def larger(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


def test_quality_held_out(larger):
    made = quality_classifier.quality_classifier(*larger)
    rows = made.join(larger[1], "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert sum(r.predicted for r in rows if r.quality) / sum(r.quality for r in rows) > 0.98


def test_votes_against_brute_force(spark, docs, labels):
    """Every score from cosines and votes worked out one by one; a held-out row is never a neighbour."""
    model = quality_classifier.fit(docs, labels)
    column = pa.array([r.text for r in docs.orderBy("doc_id").collect()] + [None, "", "tie " * 90], pa.string())
    count = np.concatenate([quality_classifier.counts(data, offsets) for _, _, data, offsets in chunks(column, 1)])
    latent = model.latent(count.astype(np.float32))
    wanted = []
    for row, x in zip(count, latent):
        cosine = [float(np.float32(c)) for c in (x[None] @ model.vectors.T)[0]]
        near = sorted(range(len(cosine)), key=lambda k: (-cosine[k], k))[:quality_classifier.NEIGHBOURS]
        votes = [max(cosine[k], 0) ** 4 * float(model.weight[k]) for k in near]
        total = sum(votes)
        wanted.append(sum(v * float(model.label[k]) for v, k in zip(votes, near)) / total if total > 0 and row.any() else model.prior)
    got = {r.doc_id: r.score for r in quality_classifier.quality_classifier(docs, labels).collect()}
    assert np.allclose([got[r.doc_id] for r in docs.orderBy("doc_id").collect()], wanted[:-3], atol=2e-3)
    made = np.concatenate([model.score(data, offsets) for _, _, data, offsets in chunks(column)])
    assert np.allclose(made, wanted, atol=2e-3) and made[-3] == made[-2] and abs(made[-3] - model.prior) < 1e-6


def test_copies_do_not_fill_the_sample(larger, monkeypatch):
    """Nine thousand copies of one labelled row are one row of the sample."""
    docs, labels = larger
    one = labels.where("quality = 0 and crc32(cast(doc_id as string)) % 5 <> 0").first().doc_id
    monkeypatch.setattr(quality_classifier, "TRAIN_ROWS", 400)
    copies = docs.where(F.col("doc_id") == one).crossJoin(docs.sparkSession.range(9000)).drop("id")
    model = quality_classifier.fit(docs.union(copies), labels)
    assert len(model.label) <= 400 and (model.label == 0).sum() == 200


def test_toxic_and_clean(larger):
    rows = toxicity.toxicity(*larger).join(larger[1].withColumnRenamed("toxic", "label"), "doc_id").collect()
    assert sum(r.toxic for r in rows if r.label) / sum(r.label for r in rows) > 0.95
    assert sum(r.toxic for r in rows if not r.label) / sum(not r.label for r in rows) < 0.01
    assert all(0 <= r.severity <= 3 and r.toxic == (r.toxic_chance > toxicity.REJECT_ABOVE) for r in rows)


def with_copies(docs, labels, doc_id, copies, **given):
    """The tables with ``copies`` more rows of one document, labelled if ``given``."""
    ids = docs.sparkSession.range(copies).select((F.col("id") + 10 ** 9).alias("doc_id"))
    more = docs.where(F.col("doc_id") == doc_id).drop("doc_id").crossJoin(ids).select(*docs.columns)
    if given:
        labels = labels.unionByName(ids.select("doc_id", *(F.lit(v).alias(k) for k, v in given.items())), allowMissingColumns=True)
    return docs.unionByName(more), labels


@pytest.mark.parametrize("given", [{}, {"quality": 1}])
def test_rules_with_a_third_of_copies(larger, given):
    """Copies of one text, without labels or all labelled good, move no document over the bar."""
    docs, labels = larger
    before = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    assert sum(before.values()) > 5000
    one = min(r.doc_id for r in labels.where("quality = 1").collect() if before[r.doc_id])
    rows = quality_rules.quality_rules(*with_copies(docs, labels, one, 5000, **given)).collect()
    assert {r.doc_id: r.kept for r in rows if r.doc_id in before} == before
    assert all(r.kept for r in rows if r.doc_id not in before)


def test_toxic_with_skewed_labels(larger):
    """Toxic texts are found where half of the labels are toxic, and where copies of one long toxic text are half of them."""
    docs, labels = larger
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}

    def recall(docs, labels):
        return sum(r.toxic for r in toxicity.toxicity(docs, labels).collect() if r.doc_id in toxic) / len(toxic)

    assert recall(docs, labels.where("toxic = 1 or crc32(cast(doc_id as string)) % 8 = 0")) > 0.95
    longest = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").orderBy(F.length("text").desc()).first().doc_id
    assert recall(*with_copies(docs, labels, longest, 2000, toxic=1)) > 0.95


def test_vectors_found(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 1500)] + rng.standard_normal((1500, 24)) * 0.22).astype(np.float32)
    x[::50] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    rows = {r.vec_id: r for r in vector_dedup.vector_dedup(table).collect()}
    assert [rows[i].n_links for i in range(1500)] == near.sum(axis=1).tolist()
    reach = np.arange(1500)
    for _ in range(60):
        reach = np.minimum(reach, np.where(near, reach[None, :], 1500).min(axis=1))
    assert [rows[i].component_id for i in range(1500)] == reach.tolist()


def test_vector_recall_at_the_threshold(spark, monkeypatch):
    """Random vectors in 78 lists, each with a neighbour whose cosine is 0.95 to 0.96."""
    monkeypatch.setattr(vector_dedup, "LIST_ROWS", 64)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((2500, 64))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.96, (2500, 1))
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine ** 2) * away])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    rows = vector_dedup.vector_dedup(table).collect()
    assert sum(r.n_links for r in rows) >= 0.98 * 5000


def test_vector_hot_cluster(spark, monkeypatch):
    """A third of the rows are distinct vectors of one tight cluster, spread over some thirty lists; no link is lost."""
    monkeypatch.setattr(vector_dedup, "LIST_ROWS", 32)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 64))
    x[::3] = x[0] + rng.standard_normal((1000, 64)) * 0.15
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 500_000
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r.n_links for r in vector_dedup.vector_dedup(table).collect()}
    assert [rows[i] for i in range(3000)] == near.sum(axis=1).tolist()


@pytest.mark.parametrize("margin, least", [(None, 0.98), (1.0, 1.0)])
def test_vector_recall_beyond_the_sample(spark, monkeypatch, margin, least):
    """Margins learned from a fifteenth of the rows; near copies lie in eight dimensions of 64; counts are symmetric."""
    monkeypatch.setattr(vector_dedup, "LIST_ROWS", 64)
    monkeypatch.setattr(vector_dedup, "TRAIN_ROWS", 400)
    rng = np.random.default_rng(21)
    plane = rng.standard_normal((8, 64))
    x = rng.standard_normal((3000, 64))
    near = x + rng.standard_normal((3000, 8)) @ plane * 0.1 * np.linalg.norm(x, axis=1, keepdims=True) / 8
    both = np.concatenate([x, near])
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r.n_links for r in vector_dedup.vector_dedup(table, margin=margin).collect()}
    found = np.array([rows[i] for i in range(6000)])
    assert close.sum() > 2000 and (found <= close.sum(axis=1)).all() and found.sum() >= least * close.sum()
    assert found[:3000].sum() == found[3000:].sum()


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x.com/{i}\r\nEvil: 1", "é<p>" * (300 if i % 3 else 2)) for i in range(30)],
                                  "page_id long, url string, html string").repartition(2)
    whole, target = f"{tmp_path}/whole", f"{tmp_path}/split"
    first = warc.written(pages, whole).collect()
    second = warc.normalised(spark.createDataFrame(first), whole, target).collect()
    assert sum(r.n for r in second) == 30
    for r in second:
        data = open(f"{target}/{r.archive}", "rb").read()
        index = [json.loads(line) for line in open(f"{target}/{r.archive}.idx")]
        assert sum(length for _, length, _ in index) == len(data)
        members = [gzip.decompress(data[offset:offset + length]) for offset, length, _ in index]
        assert b"".join(members) == gzip.decompress(data)
        for member, (_, _, name) in zip(members, index):
            head, payload = warc.parsed(member)
            assert head["WARC-Record-ID"] == name and "Evil" not in head and member.startswith(b"WARC/1.1\r\n")
            assert payload == b"" or head["WARC-Type"] == "response"


def test_inflated_members_and_cuts():
    data = b"".join(warc.record(i, None, b"x" * i * 400, "d", None) for i in range(9))
    for packed in (gzip.compress(data), gzip.compress(data[:900]) + gzip.compress(data[900:])):
        assert b"".join(warc.inflated(io.BytesIO(packed), 64)) == data
        assert len(list(warc.records(warc.inflated(io.BytesIO(packed), 50)))) == 9
    with pytest.raises(ValueError):
        list(warc.records(iter([data[:-10]])))


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    mild = stages["toxicity"](spark, docs, folder)
    rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).where("toxic").collect()}
    assert rejected and {r.doc_id for r in mild.collect()} == {r.doc_id for r in docs.collect()} - rejected
    good = stages["quality_rules"](spark, mild, folder)
    kept = {r.doc_id for r in quality_rules.quality_rules(mild, labels).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    different = stages["ngram_jaccard_join"](spark, good, folder)
    texts = {r.doc_id: r.text for r in good.collect()}
    later = {b for _, b in brute_links(texts)}
    left = {r.doc_id for r in different.collect()}
    assert left == set(texts) - later and different.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == left


def test_verdicts_of_quality_rules_against_brute_force(docs, labels):
    """Score by distinct texts and verdict of every document, gram by gram."""
    rows = docs.collect()
    marks = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            marks[r.doc_id] = min(marks.get(r.doc_id, 1), r.quality)
    bucket = {}

    def grams(text):
        data = text.encode()
        out = [data[k:k + quality_rules.GRAM] for k in range(len(data) - quality_rules.GRAM + 1)]
        for g in out:
            if g not in bucket:
                bucket[g] = int(quality_rules._buckets(np.frombuffer(g, np.uint8))[0])
        return [bucket[g] for g in out]

    raw, target = Counter(), Counter()
    for t in {r.text or "" for r in rows}:
        raw.update(grams(t))
    for t in {r.text or "" for r in rows if marks.get(r.doc_id) == 1}:
        target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    weight = {b: round(float(np.log((0.95 * target[b] / m + 0.05 * raw[b] / n) / (raw[b] / n))) * quality_rules.MICRO) for b in raw}
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for r in rows:
        found = grams(r.text or "")
        score = sum(weight[b] for b in found) / max(len(found), 1) / quality_rules.MICRO
        assert abs(got[r.doc_id].distinct_score - score) < 2e-6
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and got[r.doc_id].distinct_score >= quality_rules.THRESHOLD)
