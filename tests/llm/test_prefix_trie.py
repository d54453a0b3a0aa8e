"""The prefix trie against plain Python: odd rows, long and repeated conversations, and splits of every size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leadloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """{(conv_id, depth): ...} from whole prefixes; turns of a conversation differ in ``turn``."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted(((r[0], (r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] is not None)):
        own[conv].append((role, text))
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(own):
        h = zlib.crc32(str(conv).encode()) % 4
        base = int(abs(conv) // 20 * 20) * (1 if conv >= 0 else -1)
        turns = own.get(base, [])[:h] + own[conv][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        words = len([w for w in re.split("[\x20\x09-\x0d]+", node[-1][1]) if w]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * words
    return {(c[0], len(n)): (members[n[:-1]][0] if n else None, len(c), children[n], leaves[n], saved[n],
                             hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, c in members.items()}


def built(df):
    rows = prefix_trie.prefix_trie(df).collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def turns(count, seed, words=("a", "b")):
    random.seed(seed)
    return [(c, t, random.choice(["user", "assistant", None]), random.choice([*words, None, ""])) for c in range(count) for t in range(random.randrange(1, 7))]


@pytest.mark.parametrize("task_nodes, parts", [(1, 3), (6, 1), (20_000, 4)])
def test_against_plain(spark, monkeypatch, task_nodes, parts):
    """Few texts, so that paths branch at every depth and several conversations end at a node."""
    monkeypatch.setattr(prefix_trie, "TASK_NODES", task_nodes)
    monkeypatch.setattr(prefix_trie, "DIGESTED", 3)
    rows = turns(160, 1) + [(c, 0, "user", "the one turn") for c in range(1000, 1060)] + [(-25, 1, "user", "x y"), (-3, 1, "user", "a"), (77_777, 1, "user", "z")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert built(df) == plain(rows)


def test_long_conversation(spark, monkeypatch):
    """One conversation holds most rows: its turns are numbered and folded over several groups, its path is split."""
    monkeypatch.setattr(prefix_trie, "FOLD", 16)
    monkeypatch.setattr(prefix_trie, "TASK_NODES", 50)
    rows = [(40, t, "user", f"w {t % 7}") for t in range(300)] + [(41, t, "user", f"w {t % 7}") for t in range(200)] + turns(30, 2)
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(8)) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "a " * 40_000), (2, 1, "", ""), (None, 1, "user", "no id"), (20, 5, "user", "x"), (20, 9, "x", "y  z\t"),
            (21, 1, "user", "x"), (39, 1, "user", "only"), (39, 2, "a", "b"), (0, 1, "r", "t")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x")).withColumn("depth", F.lit(1.5)).withColumn("part", F.lit(True))
    assert built(df) == plain(rows)
    assert built(df.limit(0)) == {} and built(df.where("conv_id is null")) == {}
    # Rows that repeat are turns of their own, whatever their partitions.
    repeated = spark.createDataFrame([(60, 1, "user", "same")] * 9, SCHEMA)
    assert len(built(repeated)) == 10 and built(repeated.repartition(3)) == built(repeated.coalesce(1))


def test_balanced_on_shapes():
    """Paths, stars and random trees against sums from the leaves up."""
    random.seed(3)
    shapes = [[None, *range(99)], [None] + [0] * 99, [None, *(random.randrange(k) for k in range(1, 300))], [None], [None, 0, 1, 1, 0, 4, 4, 4]]
    for parent in shapes:
        n = len(parent)
        leaf, saved = [random.randrange(3) for _ in parent], [random.randrange(100) for _ in parent]
        size, want_leaf, want_saved = [1] * n, leaf[:], saved[:]
        for k in range(n - 1, 0, -1):
            for x in (size, want_leaf, want_saved):
                x[parent[k]] += x[k]
        got = [0] * n, [0] * n
        prefix_trie.balanced(parent, size, leaf, saved, *got)
        assert got == (want_leaf, want_saved)
