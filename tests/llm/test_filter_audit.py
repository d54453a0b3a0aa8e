"""The filter audit against plain Python, its trie by itself, and odd rows."""

import itertools
import os
import random
import re
from collections import Counter

import pytest

from leadloom.llm import filter_audit

GAP = re.compile("[\x20\x09-\x0d]+")


def plain(docs, labels):
    """Rows of the audit, filter by filter and order by order."""
    first = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    seen = []
    for r in docs:
        text = r.text or ""
        words = [w for w in GAP.split(text) if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": r.doc_id is not None and first[text] < r.doc_id}
        seen.append((r.lang or "", {k for k, v in fails.items() if v}, r.doc_id in good, r.doc_id in toxic))
    rows, shares = {}, Counter()
    for part in {s[0] for s in seen}:
        for order in itertools.permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = set(order[:k])
                mine = [s for s in seen if s[0] == part]
                removed = [s for s in mine if letter in s[1] and not s[1] & before]
                rows[part, "".join(order), k + 1] = [
                    sum(not s[1] & (before | {letter}) for s in mine), len(removed), sum(letter in s[1] and bool(s[1] & before) for s in mine),
                    sum(s[1] == {letter} for s in mine), sum(s[2] for s in removed), sum(s[3] for s in removed)]
                shares[part, letter] += len(removed)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def audited(docs, labels):
    rows = filter_audit.filter_audit(docs, labels).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_odd_rows(odd_docs, odd_labels):
    assert audited(odd_docs, odd_labels) == plain(odd_docs.collect(), odd_labels.collect())
    assert audited(odd_docs, odd_labels.limit(0)) == plain(odd_docs.collect(), [])
    assert audited(odd_docs.limit(0), odd_labels) == {}


@pytest.mark.parametrize("parts", [1, 7])
def test_many_buckets(spark, docs, labels, monkeypatch, parts):
    """Small buckets, cuts that are equal, hash parts and tries emitted early don't change a count."""
    monkeypatch.setattr(filter_audit, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(filter_audit, "MAX_CUTS", 9)
    monkeypatch.setattr(filter_audit, "COMBINE_BYTES", 5000)
    rows = docs.select("doc_id", "text", "lang").collect()
    copies = [(10_000 + k, rows[3].text, "en") for k in range(200)] + [(20_000 + k, "The same long start of many texts, " * 4 + str(k % 90), "de")
                                                                       for k in range(300)]
    more = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(copies, "doc_id long, text string, lang string")).repartition(parts)
    assert len(filter_audit.cuts(more)[0]) == 8 and filter_audit.cuts(more)[1] > 1
    assert audited(more, labels) == plain(more.collect(), labels.collect())


def test_trie():
    random.seed(5)
    texts = ["".join(random.choices("ab", k=random.randrange(12))).encode() for _ in range(2000)] + [os.urandom(50) for _ in range(50)]
    texts += [t[:k] + b"x" for t in texts[-20:] for k in (0, 1, 49, 50)]
    trie, count = filter_audit.Trie(), Counter(texts)
    for t in texts:
        node = trie.terminal(t)
        node[2] = (node[2] or 0) + 1
    assert dict(trie.walk()) == count

    def edges(node):
        assert node is trie.root or node[0] and (node[2] is not None or len(node[1]) > 1)  # compressed
        for child in node[1].values():
            edges(child)
    edges(trie.root)


def test_buckets_keep_copies_together():
    at = [b"a", b"c", b"c", b"c", b"f"]
    for text in (b"", b"a", b"b", b"c", b"cz", b"d", b"f", b"zz"):
        assert filter_audit._bucket(text, at, 3) == filter_audit._bucket(bytes(text), at, 3)
    assert len({filter_audit._bucket(b"c%d" % k, at, 1) for k in range(50)}) == 3
