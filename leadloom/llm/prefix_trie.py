"""The trie of conversation prefixes, with roll-ups by centroid decomposition.

A conversation is rebuilt from the first turns of its family's first one and its own later turns.  Its prefixes are known
by 128 bits: the exclusive or of a hash of (position, role, text) for each turn, a running aggregate that needs no group
in one task.  A node is named by its smallest member and its depth, so one table of (conversation, depth, node) holds
every path to the root.

Sums over subtrees follow from centroids: in every component of the tree the node that leaves no part of more than half is
taken out, the total of what hangs below it within the component is added along the path from it to the component's top,
and the parts go on by themselves.  Components above ``TASK_NODES`` nodes are split so by Spark, all at once in each round;
smaller ones are finished inside tasks by the same steps.

Defined results: turns are ordered by (turn, hash of role and text), a null turn first; rows that repeat count as turns of
their own.  Rows without a conv_id belong to no conversation and are left out.  A conversation whose id is taken up by
others' heads but that is absent gives no head.  An empty table gives no rows, not even the root.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.tables import stored

#: Conversations of a family share the head of the one whose id is their own less this remainder.
FAMILY = 20
MAX_HEAD = 3
#: Components up to so many nodes are finished inside a task.
TASK_NODES = 20_000
#: Turns per group in which prefixes are folded; the groups' totals are folded after them.
FOLD = 4096
#: Up to so many components (40 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_COMPONENTS = 1_000_000
#: Ids that travel as one row to the task that digests them.
DIGESTED = 8192

NODE = ["conv_id", "depth"]
TOP = ["top", "top_depth"]


def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, j, a, b, words): every turn with its place, without its text.

    Rows are dealt out by ranges, so a conversation with a third of all rows is spread over tasks; a place is that within
    the partition and the conversation's rows in partitions before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ["turn", "a", "b", "deal"]
    dealt = stored(rows.withColumn("deal", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order)
                   .withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before))
             .where("before > 0").select("conv_id", "part", "before"))  # a row at most per partition
    inside = Window.partitionBy("part", "conv_id").orderBy(*(F.asc_nulls_first(c) for c in order))
    return stored(dealt.withColumn("j", F.row_number().over(inside) - 1).join(F.broadcast(spans), ["conv_id", "part"], "left")
                  .select("conv_id", (F.col("j") + F.coalesce("before", F.lit(0))).cast("long").alias("j"), "a", "b", "words"), "places")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation, and (conv_id, depth, x, y, words, length) of its prefixes from depth 1."""
    turns = _numbered(conversations)
    heads = (turns.where(F.col("j") < MAX_HEAD).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("j", "a", "b", "words"))).alias("head")))
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    convs = (turns.groupBy("conv_id").agg(F.count("*").alias("n"))
             .withColumn("h", (crc % (MAX_HEAD + 1)).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
             .join(heads, "base", "left").withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
             .withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
             .select("conv_id", "h", "k", "length", F.slice("head", 1, F.col("k")).alias("head")))
    convs = stored(convs, "rebuilt")
    first = convs.where("k > 0").select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "length", F.col("t.j").alias("at"), "t.a", "t.b", "t.words")
    own = turns.join(convs.select("conv_id", "h", "k", "length"), "conv_id").where("j >= h").select(
        "conv_id", "length", (F.col("k") + F.col("j") - F.col("h")).alias("at"), "a", "b", "words")
    rows = first.unionByName(own).select("conv_id", "length", "at", "words", F.xxhash64("at", "a").alias("x"), F.xxhash64("at", F.lit(1), "b").alias("y"),
                                         F.floor(F.col("at") / FOLD).alias("fold"))
    before = Window.partitionBy("conv_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    folds = (rows.where(F.col("length") > FOLD).groupBy("conv_id", "fold").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
             .select("conv_id", "fold", F.bit_xor("x").over(before).alias("x0"), F.bit_xor("y").over(before).alias("y0")))
    inside = Window.partitionBy("conv_id", "fold").orderBy("at")
    prefixes = rows.withColumn("x", F.bit_xor("x").over(inside)).withColumn("y", F.bit_xor("y").over(inside)).join(folds, ["conv_id", "fold"], "left")
    return convs.select("conv_id", "length"), stored(prefixes.select(
        "conv_id", (F.col("at") + 1).alias("depth"), *(F.col(c).bitwiseXOR(F.coalesce(c + "0", F.lit(0))).alias(c) for c in "xy"), "words", "length"), "prefixes")


def _paths(convs: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes without roll-ups, and the path table (conv_id, depth, node, length) with a row per member."""
    ends = F.col("depth") == F.col("length")
    made = [F.count("*").alias("n_convs"), F.max("words").alias("words"), F.sum(ends.cast("long")).alias("n_ends"),
            F.min(F.when(ends, F.col("conv_id"))).alias("first_end"), F.min("conv_id").alias("conv_id")]
    # Depth counts as part of the key, though x and y all but hold it.
    nodes = stored(prefixes.groupBy("depth", "x", "y").agg(*made), "nodes")
    root = stored(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(0).cast("long").alias("words")).groupBy("depth").agg(*made), "root")
    top = root.first()
    named = prefixes.join(nodes.select("depth", "x", "y", F.col("conv_id").alias("node")), ["depth", "x", "y"]).select(*NODE, "node", "length")
    if top:
        named = named.union(convs.select("conv_id", F.lit(0).cast("long"), F.lit(top.conv_id), "length"))
    return nodes.select(*root.columns).union(root), stored(named, "paths")


def _tree(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes with parent, number of children and size of their subtree."""
    up = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    below = nodes.join(up, NODE, "left")
    children = below.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    # A conversation names the nodes from the depth at which no smaller one shares its path, down to its end.
    own = paths.where("conv_id = node").groupBy("conv_id").agg(F.min("depth").alias("first"))
    sizes = (paths.join(own, "conv_id").groupBy(F.col("node").alias("conv_id"), "depth")
             .agg(F.sum(F.greatest(F.lit(0), F.col("length") - F.greatest("first", "depth") + 1)).alias("size")))
    return stored(below.join(children, NODE, "left").join(sizes, NODE).withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "tree")


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_COMPONENTS else rows


def _split(state: DataFrame, large: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes the centroid out of every large component: (the centroids with their sums, the remaining nodes)."""
    rows = state.join(_sent(large), TOP)
    found = stored(rows.where("2 * size >= total").groupBy(*TOP).agg(F.max(F.struct("depth", "conv_id", "size")).alias("c")).select(
        *TOP, F.col("c.depth").alias("c_depth"), F.col("c.conv_id").alias("c_conv"), F.col("c.size").alias("c_size")), "centroids")
    at = paths.select(F.col("conv_id").alias("m"), F.col("depth").alias("m_depth"), "node")
    marked = rows.drop("total").join(_sent(found), TOP)
    # A node hangs below a centroid if the path of its first member runs through it; the step after it names its new component.
    marked = (marked.join(at.withColumnRenamed("node", "passed"), (F.col("conv_id") == F.col("m")) & (F.col("m_depth") == F.col("c_depth")), "left").drop("m", "m_depth")
              .withColumn("below", (F.col("depth") >= F.col("c_depth")) & F.coalesce(F.col("passed") == F.col("c_conv"), F.lit(False))))
    marked = stored(marked.join(at.withColumnRenamed("node", "child"), F.col("below") & (F.col("conv_id") == F.col("m"))
                                & (F.col("m_depth") == F.col("c_depth") + 1) & (F.col("depth") > F.col("c_depth")), "left").drop("m", "m_depth", "passed"), "marked")
    totals = marked.where("below").groupBy(*TOP).agg(F.sum("leaf").alias("a_leaf"), F.sum("saved").alias("a_saved"))
    above = (paths.join(_sent(found.join(totals, TOP).withColumnRenamed("c_conv", "m")), F.col("conv_id") == F.col("m"))
             .where("depth between top_depth and c_depth")
             .select(F.col("node").alias("conv_id"), "depth", "a_leaf", "a_saved", F.col("c_size").alias("gone")))
    now = (marked.join(above, NODE, "left")
           .withColumn("sum_leaf", F.col("sum_leaf") + F.coalesce("a_leaf", F.lit(0)))
           .withColumn("sum_saved", F.col("sum_saved") + F.coalesce("a_saved", F.lit(0)))
           .withColumn("centroid", F.expr("below and depth = c_depth"))
           .withColumn("size", F.col("size") - F.when(F.col("below"), 0).otherwise(F.coalesce("gone", F.lit(0))))
           .withColumn("top", F.coalesce("child", "top"))
           .withColumn("top_depth", F.when(F.col("child").isNotNull(), F.col("c_depth") + 1).otherwise(F.col("top_depth"))))
    now = stored(now.select(*state.columns, "centroid"), "split")
    return now.where("centroid").select(*NODE, "sum_leaf", "sum_saved"), now.where("not centroid").drop("centroid")


def balanced(parent: list, size: list, leaf: list, saved: list, sum_leaf: list, sum_saved: list) -> None:
    """Adds every subtree's totals to the sums of one component, whose first node is its top; ``size`` is used up."""
    children = [[] for _ in parent]
    for k, p in enumerate(parent):
        if p is not None:
            children[p].append(k)
    gone, tops = [False] * len(parent), [0]
    while tops:
        top = tops.pop()
        total, centroid = size[top], top
        while (heavy := next((k for k in children[centroid] if not gone[k] and 2 * size[k] >= total), None)) is not None:
            centroid = heavy
        below = [centroid]
        for k in below:
            below.extend(x for x in children[k] if not gone[x])
        leaves, tokens = sum(leaf[k] for k in below), sum(saved[k] for k in below)
        k, part = centroid, size[centroid]
        while True:
            sum_leaf[k] += leaves
            sum_saved[k] += tokens
            if k == top:
                break
            k = parent[k]
            size[k] -= part
        gone[centroid] = True
        tops.extend(x for x in children[centroid] if not gone[x])
        if centroid != top:
            tops.append(top)


def _finished(state: DataFrame) -> DataFrame:
    """The sums of all components that fit a task."""
    names = ["top", "top_depth", "depth", "conv_id", "parent", "size", "leaf", "saved", "sum_leaf", "sum_saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            _, _, depth, conv, parent, *numbers = (list(c) for c in zip(*rows))
            place = {key: k for k, key in enumerate(zip(conv, depth))}
            balanced([place.get((p, d - 1)) if k else None for k, (p, d) in enumerate(zip(parent, depth))], *numbers)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (conv, depth, numbers[3], numbers[4])], [*NODE, "sum_leaf", "sum_saved"])

        rows = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:2] != rows[0][:2]:
                    yield made(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield made(rows)

    return (state.select(*names).repartition(*TOP).sortWithinPartitions(*TOP, "depth", "conv_id")
            .mapInArrow(run, "conv_id long, depth long, sum_leaf long, sum_saved long"))


def subtree_sums(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, depth, sum_leaf, sum_saved): leaves and saved tokens of every node's subtree."""
    root = tree.where("depth = 0").select("conv_id").first()
    zero = F.lit(0).cast("long")
    state = tree.select(*NODE, "parent", "size", (F.col("n_children") == 0).cast("long").alias("leaf"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.lit(root.conv_id if root else None).cast("long").alias("top"),
                        zero.alias("top_depth"), zero.alias("sum_leaf"), zero.alias("sum_saved"))
    done = []
    while True:
        large = stored(state.where((F.col("conv_id") == F.col("top")) & (F.col("depth") == F.col("top_depth")) & (F.col("size") > TASK_NODES))
                       .select(*TOP, F.col("size").alias("total")), "large")
        if large.isEmpty():
            return _union([*done, _finished(state)])
        done.append(_finished(state.join(_sent(large.select(*TOP)), TOP, "left_anti")))
        centroids, state = _split(state, large, paths)
        done.append(centroids)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _digests(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes at which several conversations end.

    Ids are sorted by ranges and travel as joined text, so that the one task a digest needs reads few rows.
    """
    many = nodes.where("n_ends > 1").select(F.col("conv_id").alias("node"), "depth")
    rows = paths.where("depth = length").join(many, ["node", "depth"]).select("node", "depth", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def text(key, ids):
            return pa.RecordBatch.from_pydict({"node": [key[0]], "depth": [key[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

        key, ids = None, []
        for batch in batches:
            for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != (node, depth) or len(ids) == DIGESTED):
                    yield text(key, ids)
                    ids = []
                key = (node, depth)
                ids.append(conv)
        if ids:
            yield text(key, ids)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            return pa.RecordBatch.from_pydict({"conv_id": [key[0]], "depth": [key[1]], "ends_sha256": [sha.hexdigest()]})

        key, sha = None, None
        for batch in batches:
            for node, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == (node, depth):
                    sha.update(b"," + ids.encode())
                    continue
                if key:
                    yield made()
                key, sha = (node, depth), hashlib.sha256(ids.encode())
        if key:
            yield made()

    key = ["node", "depth"]
    return (rows.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(joined, "node long, depth long, first long, ids string")
            .repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digested, "conv_id long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    nodes, paths = _paths(*rebuilt(conversations))
    tree = _tree(nodes, paths)
    one = F.sha2(F.coalesce(F.col("first_end").cast("string"), F.lit("")).cast("binary"), 256)
    return (tree.join(subtree_sums(tree, paths), NODE).join(_digests(tree, paths), NODE, "left")
            .select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"),
                    F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", one).alias("ends_sha256")))
