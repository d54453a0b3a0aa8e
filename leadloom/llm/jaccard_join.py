"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

A document's n-grams are the runs of five lower-cased words (fewer words: all of them as one run).  Documents with
the same words in the same order are one class of copies and enter once.  Two classes are linked if the
Jaccard similarity of their n-gram sets is at least 0.8.  Rows per band and bands are chosen for the target
recall at that similarity; at the default of 0.9999 a linked pair is missed once in 10,000 at exactly 0.8 and
practically never above 0.85.

Documents without words (null, empty, only white space) have no n-grams and link with nothing, each its own class.
Repeated rows with one doc_id are copies of each other: each row is returned, and counts as a document.  Rows with a
null doc_id are documents like others: they link by their words, and come after all ids where the smallest is taken.  An empty
table gives an empty result.  Other columns are neither read nor returned.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.components import components, lowest
from leadloom.llm.tables import per_text, stored, texts
from leadloom.llm.words import Words, chunks, mix, shingles, sorted_sets

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
MAX_HASHES = 150
#: A bucket is compared in blocks of at most so many documents and bytes of sets, two blocks in a task at a time.
BLOCK_DOCS = 256
BLOCK_BYTES = 8 << 20
#: Up to so many ids (8 bytes each) are sent to every executor to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_SLAB = 4096
#: Rows that are copied out of an Arrow batch at once.
SLICE_ROWS = 512


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows per band): the most rows, so the fewest false candidates, that still reach the recall."""
    for rows in range(hashes, 0, -1):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-similarity ** rows))) if similarity < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("this recall needs more hashes")


def _keys(words: Words) -> np.ndarray:
    """A 128-bit hash of each text's word sequence, 0 without words."""
    key = np.zeros((words.texts, 2), np.uint64)
    some = words.count > 0
    if not some.any():
        return key
    place = np.arange(len(words.start)) - np.repeat(words.first[:-1], words.count)
    h, begin = words.hashes(), words.first[:-1][some]
    with np.errstate(over="ignore"):
        for half in range(2):
            turned = mix(h + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(half + 1)))
            key[some, half] = mix(np.add.reduceat(turned, begin) + words.count[some].astype(np.uint64))
    return key


def _signatures(column: pa.Array, bands: int, rows: int, n: int) -> dict:
    """Class key and band hashes of each text; no words: null key."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    multiply, add = (seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1), (seeds >> np.uint64(32)).astype(np.uint32)
    keys, all_bands, sizes = [], [], []
    for _, _, data, offsets in chunks(column):
        words = Words(data, offsets, lower=True)
        value, runs = shingles(words, n)
        some = runs > 0
        start = (np.cumsum(runs) - runs)[some]
        found = np.zeros((words.texts, bands), np.uint64)
        if len(start):
            narrow = (value >> np.uint64(32)).astype(np.uint32)
            least = np.empty((bands * rows, len(start)), np.uint32)
            for k in range(bands * rows):
                least[k] = np.minimum.reduceat(narrow * multiply[k] + add[k], start)
            for b in range(bands):
                h = np.full(len(start), b + 1, np.uint64)
                for k in range(b * rows, (b + 1) * rows):
                    h = mix(h ^ (least[k].astype(np.uint64) + np.uint64(k << 32)))
                found[some, b] = h
        keys.append(_keys(words))
        all_bands.append(found)
        sizes.append(runs)
    key = np.concatenate(keys) if keys else np.zeros((0, 2), np.uint64)
    found = np.concatenate(all_bands) if keys else np.zeros((0, bands), np.uint64)
    size = np.concatenate(sizes) if keys else np.zeros(0, np.int64)
    signed = found.view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, signed.size + 1, bands, dtype=np.int32)), pa.array(signed.ravel()))
    return {"size": size, "high": pa.array(key[:, 0].view(np.int64), mask=size == 0),
            "low": pa.array(key[:, 1].view(np.int64), mask=size == 0), "bands": lists}


def _sets(column: pa.Array, n: int) -> dict:
    nodes, out = [np.zeros(0, np.int64)], []
    for _, _, data, offsets in chunks(column):
        words = Words(data, offsets, lower=True)
        nodes.append(_keys(words)[:, 0].view(np.int64))
        value, count = sorted_sets(*shingles(words, n))
        out += [x.tobytes() for x in np.split(value, np.cumsum(count)[:-1])]
    return {"node": np.concatenate(nodes), "grams": pa.array(out, pa.binary())}


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets in ``a`` with all sets in ``b``."""
    left, right = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.float32)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    pa_, pb = np.searchsorted(common, left), np.searchsorted(common, right)
    ia = np.flatnonzero((pa_ < len(common)) & (common[np.minimum(pa_, len(common) - 1)] == left)) if len(common) else ra[:0]
    ib = np.flatnonzero((pb < len(common)) & (common[np.minimum(pb, len(common) - 1)] == right)) if len(common) else rb[:0]
    for slab in range(0, len(common), _SLAB):
        width = min(_SLAB, len(common) - slab)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ja = ia[(pa_[ia] >= slab) & (pa_[ia] < slab + width)]
        jb = ib[(pb[ib] >= slab) & (pb[ib] < slab + width)]
        ma[ra[ja], pa_[ja] - slab] = 1
        mb[rb[jb], pb[jb] - slab] = 1
        out += ma @ mb.T
    return out


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of ``n`` places over the given links."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            nearer = root[root]
            if np.array_equal(nearer, root):
                break
            root = nearer
        differ = root[left] != root[right]
        left, right = left[differ], right[differ]
    return root


def _verify(similarity: float):
    """Compare two blocks of a bucket: links per class, and a spanning forest of the linked classes."""
    def linked(key: tuple, rows) -> tuple[list, list]:
        _, _, left, right = key
        ids, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        order = np.argsort(ids, kind="stable")
        rows, ids, copies = rows.iloc[order], ids[order], copies[order]
        bands = np.vstack(rows["bands"].to_numpy()) if len(rows) else np.zeros((0, 0))
        sets = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        size = np.array([len(x) for x in sets])
        block = rows["block"].to_numpy()
        if left == right:
            one = other = np.arange(len(ids))
        else:
            one, other = np.flatnonzero(block == left), np.flatnonzero(block == right)
        pairs_a, pairs_b = [], []
        band = key[0]
        for x in range(0, len(one), 128):
            for y in range(0, len(other), 128):
                i, j = one[x:x + 128], other[y:y + 128]
                if left == right and j[-1] <= i[0]:
                    continue
                shared = _shared([sets[k] for k in i], [sets[k] for k in j])
                whole = size[i][:, None] + size[j][None, :] - shared
                good = shared >= similarity * whole - 1e-6
                if left == right:
                    good &= i[:, None] < j[None, :]
                a, b = np.nonzero(good)
                a, b = i[a], j[b]
                # A pair counts in the first band that both share.
                first = ~(bands[a, :band] == bands[b, :band]).any(axis=1)
                pairs_a.append(a[first])
                pairs_b.append(b[first])
        a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (pairs_a, pairs_b))
        n = len(ids)
        classes = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        documents = np.bincount(a, copies[b], minlength=n) + np.bincount(b, copies[a], minlength=n)
        root = _roots(n, a, b)
        some = classes > 0
        return ids[some], classes[some], documents[some].astype(np.int64), ids[root[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        keys = ["band", "hash", "left", "right"]
        held = None
        made: list[tuple] = []

        def out():
            made_, made[:] = list(made), []
            columns = [np.concatenate(x) for x in zip(*made_)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "classes", "documents", "root"])

        def done(frame):
            for key, rows in frame.groupby(keys, sort=False):
                made.append(linked(key, rows))

        # A few rows at a time: a batch has thousands, and each copy of its sets counts.
        for frame in (whole.slice(i, SLICE_ROWS).to_pandas() for whole in batches for i in range(0, whole.num_rows, SLICE_ROWS)):
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            # Rows come sorted, so only the last group can go on in the next batch.
            last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1)
            done(frame[~last])
            held = frame[last]
            if sum(len(x[0]) for x in made) > 100_000:
                yield out()
        if held is not None and len(held):
            done(held)
        if made:
            yield out()

    return run


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = WORDS) -> DataFrame:
    """One row per document: doc_id, copy_id (smallest doc_id with the same words), class_id (smallest doc_id
    reachable by links), n_links (other documents linked directly, copies too), n_linked_classes (different texts
    linked directly), kept (the row with doc_id = class_id, null-safe; of repeated such rows all that have the same words).

    Buckets are cut in blocks, each pair of blocks is its own group, and a group gives counts per class and the
    edges of a spanning forest, never its pairs.  Buckets whose members all share an earlier band are left out,
    for their pairs are found there.  The sets of documents in a shared bucket are made anew from the text and are the
    only ones that move.
    """
    return _joined(docs, similarity, recall, n).select(
        "doc_id", "copy_id", "class_id", "n_links", "n_linked_classes", "kept")


def _joined(docs: DataFrame, similarity: float, recall: float, n: int) -> DataFrame:
    """The rows of ``jaccard_join`` with the key of their class (high, low) and ``row``, a hash of id and text."""
    docs = texts(docs)
    keyed = docs.select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("row")).alias("doc_id"), "text")
    bands, per_band = choose_bands(similarity, recall)
    signed = stored(per_text(keyed, "size long, high long, low long, bands array<bigint>",
                             lambda column: _signatures(column, bands, per_band, n))
                    .select("doc_id.doc_id", "doc_id.row", "size", "high", "low", "bands"), "signatures")
    classes = stored(signed.where("size > 0").groupBy("high", "low")
                     .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # A class is compared by one row of its smallest id; its node is half of its key, so ids may repeat.
    nodes = (signed.where("size > 0").join(classes, ["high", "low"]).where("doc_id <=> rep").dropDuplicates(["high", "low"])
             .select(F.col("high").alias("node"), "rep", "row", "size", "copies", "bands"))
    spots = nodes.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    shared = (spots.groupBy("band", "hash").agg(F.count("*").alias("members"), F.sum("size").alias("grams"))
              .where("members > 1"))
    found = stored(spots.select("node", "band", "hash").join(shared, ["band", "hash"]), "buckets")
    near = stored(nodes.join(found.select("node").distinct(), "node", "left_semi"), "near")
    # Left out: buckets whose members all agree in an earlier band.
    ends = [F.expr(f"{f}(bands[{k}])").alias(f"{f}{k}") for k in range(bands) for f in ("min", "max")]
    covered = " or ".join(f"(band > {k} and min{k} = max{k})" for k in range(bands))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_DOCS, F.col("grams") * 8 / BLOCK_BYTES)).cast("int")
    open_ = (found.join(near.select("node", "bands"), "node").groupBy("band", "hash", "members", "grams").agg(*ends)
             .where(~F.expr(covered)).select("band", "hash", blocks.alias("blocks")))
    ids = near.select("row").distinct()
    ids = F.broadcast(ids) if near.count() <= BROADCAST_IDS else ids
    picked = docs.join(ids, F.xxhash64("doc_id", "text") == F.col("row"), "left_semi")
    grams = (per_text(picked, "node long, grams binary", lambda column: _sets(column, n))
             .select("node", "grams").dropDuplicates(["node"]))
    members = near.join(grams, "node").select("node", "copies", "bands", "grams")
    placed = (found.select("node", "band", "hash").join(open_, ["band", "hash"])
              .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("node", "band", "hash", "block", F.least("block", "other").alias("left"),
                      F.greatest("block", "other").alias("right")))
    groups = (placed.join(members, "node").repartition("band", "hash", "left", "right")
              .sortWithinPartitions("band", "hash", "left", "right"))
    verified = stored(groups.select("band", "hash", "left", "right", "node", "copies", "block", "bands", "grams")
                      .mapInArrow(_verify(similarity), "node long, classes long, documents long, root long"), "links")
    joined = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = verified.groupBy("node").agg(F.sum("classes").alias("classes"), F.sum("documents").alias("documents"))
    linked = joined.join(near.select("node", "rep"), "node")
    smallest = lowest(linked, "component", "rep", "class_id")
    # Of classes with the smallest id (ids may repeat or be null) the one with the smallest node is kept.
    linked = stored(linked.join(smallest, F.col("component") == F.col("hub")).select("node", "component", "rep", "class_id"),
                    "linked")
    first = lowest(linked.where("rep <=> class_id"), "component", "node", "first")
    linked = (linked.join(first, F.col("component") == F.col("hub")).join(counts, "node", "left")
              .select(F.col("node").alias("high"), "class_id", "classes", "documents", F.expr("node = first").alias("leads")))
    known = (classes.join(linked, "high", "left")
             .select("high", "low", F.col("rep").alias("copy_id"), F.coalesce("class_id", "rep").alias("class_id"),
                     (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"),
                     F.coalesce("classes", F.lit(0)).alias("n_linked_classes"),
                     F.coalesce("leads", F.lit(True)).alias("leads")))
    rows = signed.select("doc_id", "row", "high", "low").join(known, ["high", "low"], "left")
    own = [F.coalesce(c, "doc_id").alias(c) for c in ("copy_id", "class_id")]
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_linked_classes")]
    return rows.select("doc_id", "row", "high", "low", *own, *none, F.coalesce("leads", F.lit(True)).alias("leads")).withColumn(
        "kept", F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id")))


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = WORDS) -> DataFrame:
    """The documents, all columns as they are, with one document of each group of linked ones: that of the smallest id.

    Of rows that repeat both id and text one stays.
    """
    kept = _joined(docs, similarity, recall, n).where("kept")
    # Of a class, the rows of one text; documents without words are each their own class.
    row, rows_of = (next(n for n in (base + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("_kept_row", "_kept_rows"))
    kept = (kept.where("high is not null").groupBy("high", "low").agg(F.min("row").alias(row), F.count("*").alias(rows_of))
            .select(row, rows_of)
            .union(kept.where("high is null").groupBy("row").agg(F.count("*"))))
    kept = stored(kept, "kept")
    here = F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))) == F.col(row)

    def those(rows: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, here, "left_semi")

    return those(kept.where(F.col(rows_of) == 1)).union(
        those(kept.where(F.col(rows_of) > 1)).dropDuplicates(["doc_id", "text"]))
