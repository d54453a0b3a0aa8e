"""Embedding near-duplicates by product quantisation, with exact cosine at the end.

Vectors are scaled to length 1.  A coarse quantiser files each distinct vector in the list of its nearest centroid; the residual
is coded by eight subspaces of 256 codewords, and the length of what the code leaves out is kept.  Each vector is also a
query.  A neighbour within distance d lies on its side of the plane between two centroids, so a list can hold one only if
its plane is no further than d from the query.  Hardly any neighbour is displaced by all of d along one normal, so a list is probed if
its plane is within a learned share of d: the share with which ``RECALL`` of neighbours made at the threshold in random
directions are found by one side at least, as are ``RECALL`` of the links of ``ASKED`` vectors, which a pass over the whole table
finds, and all linked pairs of the sample by both, for each list by itself.
With ``margin`` 1 every list that can hold a neighbour is probed.  A list further from the query than d and its
largest residual is never probed.  In a list the asymmetric distance (table look-ups of the query's residual) must be within d plus the coded vector's left-out length,
which by the triangle inequality loses nothing; the exact cosine in double precision decides.  A link that only one of
its vectors finds counts for both.

The quantisers are fitted on at most ``TRAIN_ROWS`` distinct vectors (by hash); all rows are indexed and all are queries.
Equal vectors are one entry with a count.  Lists are cut in blocks, and a pair of blocks gives counts and a spanning
forest, never its pairs.  Null, empty, zero and non-finite vectors, and those with a null component, link with
nothing.  Shorter vectors count as padded with zeros.  Repeated rows are vectors of their own that link with each other.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.components import components, lowest
from leadloom.llm.jaccard_join import _roots
from leadloom.llm.tables import stored

COSINE = 0.95
TRAIN_ROWS = 16_384
SUBSPACES = 8
WORDS = 256
#: Lists are so many that each holds about this number of entries, up to ``MAX_LISTS`` (all centroids go to each task).
LIST_ROWS = 512
MAX_LISTS = 4096
BLOCK = 1024
#: The share of links that margins are to keep, sample vectors that they are learned from, and vectors whose links are all found
#: by comparing them with the whole table.
RECALL = 0.995
MARGIN_ROWS = 8192
ASKED = 512
_STEPS = 64
_SLACK = 1e-4


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = 0.5 * (centres ** 2).sum(axis=1)
    for i in range(0, len(x), 4096):
        out[i:i + 4096] = (half - x[i:i + 4096] @ centres.T).argmin(axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced rows; an empty centre stays where it was."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=k)
        some = count > 0
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[some] = sums[some] / count[some, None]
    return centres


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = sample.shape[1]
        self.padded = -(-self.width // SUBSPACES) * SUBSPACES
        self.centres = _kmeans(sample, lists, 10)
        rest = self._pad(sample - self.centres[_nearest(sample, self.centres)])
        self.books = [_kmeans(part, WORDS, 6) for part in np.split(rest, SUBSPACES, axis=1)]

    def _pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the length of what the codes leave out."""
        near = _nearest(x, self.centres)
        rest = self._pad(x - self.centres[near])
        parts = np.split(rest, SUBSPACES, axis=1)
        codes = np.stack([_nearest(p, b) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)
        said = np.hstack([b[codes[:, m]] for m, b in enumerate(self.books)])
        return near, codes, np.sqrt(((rest - said) ** 2).sum(axis=1))

    def _planes(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and list: twice the distance of centroids times that of the row to their plane, and the former doubled."""
        square = (self.centres ** 2).sum(axis=1)
        far = square - 2 * x @ self.centres.T  # squared distances, less the row's own square
        between = np.sqrt(np.maximum(square[near][:, None] + square - 2 * self.centres[near] @ self.centres.T, 0))
        return far - far[np.arange(len(x)), near][:, None], 2 * between

    def margins(self, sample: np.ndarray, cosine: float, recall: float) -> np.ndarray:
        """Per list, the share of the neighbour distance within which its plane must lie to be probed."""
        distance, near = np.sqrt(2 - 2 * cosine), _nearest(sample, self.centres)
        x, own = sample[:MARGIN_ROWS], near[:MARGIN_ROWS]
        way = np.random.default_rng(0).normal(size=x.shape)
        way -= (way * x).sum(axis=1, keepdims=True) * x
        way /= np.maximum(np.sqrt((way ** 2).sum(axis=1, keepdims=True)), 1e-12)
        made = cosine * x + np.sqrt(1 - cosine ** 2) * way
        target, needed = _nearest(made, self.centres), np.zeros(len(x))
        margins = np.zeros(len(self.centres))

        def share(rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
            plane, between = self._planes(rows, lists)
            return np.divide(plane, between * distance, out=np.zeros_like(plane), where=between > 0)

        for i in range(0, len(x), 512):
            rows = slice(i, i + 512)
            there, every = share(x[rows], own[rows]), np.arange(len(x[rows]))
            # It's enough that one of the two finds the other.
            needed[rows] = np.minimum(there[every, target[rows]], share(made[rows], target[rows])[every, own[rows]])
            a, b = np.nonzero(x[rows] @ sample.T >= cosine)
            np.maximum.at(margins, near[b], there[a, near[b]])
        return 1.1 * np.maximum(margins, np.quantile(needed, recall))

    def probes(self, x: np.ndarray, near: np.ndarray, distance: float, reach: np.ndarray, margins: np.ndarray) -> list[np.ndarray]:
        """The lists to search for vectors within ``distance`` of each row; ``reach`` is each list's largest residual, -1 if empty."""
        out = []
        for i in range(0, len(x), 1024):
            rows, own = x[i:i + 1024], near[i:i + 1024]
            plane, between = self._planes(rows, own)
            apart = np.sqrt(np.maximum(((rows ** 2).sum(axis=1))[:, None] + (self.centres ** 2).sum(axis=1) - 2 * rows @ self.centres.T, 0))
            wanted = (plane <= between * (distance * margins + _SLACK)) & (apart <= distance + reach + _SLACK) & (reach >= 0)
            wanted[np.arange(len(rows)), own] = True
            for row in wanted:
                out.append(np.flatnonzero(row).astype(np.int32))
        return out

    def tables(self, x: np.ndarray, list_: int) -> np.ndarray:
        """Squared distance of each row's residual parts to each codeword: rows, subspaces, codewords."""
        rest = self._pad(x - self.centres[list_])
        parts = np.split(rest, SUBSPACES, axis=1)
        return np.stack([np.pad(((p[:, None] - b[None]) ** 2).sum(axis=2), ((0, 0), (0, WORDS - len(b))))
                         for p, b in zip(parts, self.books)], axis=1)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles of length 1, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == width).all():
        out = flat.reshape(-1, width)
    else:
        out = np.zeros((len(size), width))
        out[np.repeat(np.arange(len(size)), size), np.concatenate([np.zeros(0, int), *map(np.arange, size)])] = flat
    # Scaled by the largest component first, so that neither tiny nor huge numbers lose the length.
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out ** 2).sum(axis=1, keepdims=True))


def _compare(index, cosine: float, width: int):
    """Counts and spanning forest of one block of a list and one block of its queries."""
    distance = np.sqrt(2 - 2 * cosine)

    def linked(list_: int, rows: pa.Table) -> tuple | None:
        side = rows["side"].to_numpy()
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        x = np.frombuffer(b"".join(rows["unit"].to_pylist()), np.float64).reshape(-1, width)
        base, query = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(base) or not len(query):
            return None
        codes = np.frombuffer(b"".join(rows["codes"].take(base).to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        reach = (distance + rows["left_out"].to_numpy()[base] + _SLACK) ** 2
        found_q, found_b = [], []
        for i in range(0, len(query), 256):
            q = query[i:i + 256]
            table = index.value.tables(x[q], list_)
            about = sum(table[:, m][:, codes[:, m]] for m in range(SUBSPACES))
            a, b = np.nonzero(about <= reach)
            a, b = q[a], base[b]
            exact = (node[a] != node[b])
            a, b = a[exact], b[exact]
            close = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            found_q.append(a[close])
            found_b.append(b[close])
        a, b = np.concatenate(found_q), np.concatenate(found_b)
        if not len(a):
            return None
        # The entry finds the query by itself unless it doesn't probe the query's list.
        probed, size = rows["probes"].combine_chunks(), len(index.value.centres)
        told = np.repeat(np.arange(len(node)), np.diff(probed.offsets.to_numpy())) * size + probed.flatten().to_numpy()
        alone = ~np.isin(b * size + rows["own"].to_numpy()[a], told)
        links = (np.bincount(a, copies[b], minlength=len(node)) + np.bincount(b[alone], copies[a[alone]], minlength=len(node))).astype(np.int64)
        ids, place = np.unique(node, return_inverse=True)
        root = ids[_roots(len(ids), place[a], place[b])][place]
        some = np.zeros(len(node), bool)
        some[a] = some[b] = True
        return node[some], links[some], root[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["list", "block", "group"]
        held: list[pa.RecordBatch] = []
        now = None

        def done():
            made = linked(now[0], pa.Table.from_batches(held))
            held.clear()
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["node", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *edges], [*edges, len(key)]):
                if held and now != tuple(key[start]):
                    yield from done()
                now = tuple(key[start])
                held.append(batch.slice(start, stop - start))
        if held:
            yield from done()

    return run


def _asked_margin(coded: DataFrame, index, cosine: float, width: int) -> float:
    """The margin that keeps ``RECALL`` of the links of ``ASKED`` vectors (by hash), compared with all rows; each counts alike."""
    asked = coded.orderBy(F.xxhash64("node"), "node").limit(ASKED).select("node", "unit", "list").toArrow().combine_chunks()
    table = coded.sparkSession.sparkContext.broadcast(asked)
    distance = np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists = table.value["node"].to_numpy(), table.value["list"].to_numpy()
        q = np.frombuffer(b"".join(table.value["unit"].to_pylist()), np.float64).reshape(-1, width)
        ahead, between = index.value._planes(q, lists)
        back = np.divide(ahead, between * distance, out=np.zeros_like(ahead), where=between > 0)
        count = np.zeros((len(q), _STEPS + 1), np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, width)
                a, b = np.nonzero((x @ q.T >= cosine) & (batch.column(0).to_numpy()[:, None] != ids[None]))
                if not len(a):
                    continue
                near, (rows, place) = batch.column(2).to_numpy(), np.unique(a, return_inverse=True)
                ahead, between = index.value._planes(x[rows], near[rows])
                there = np.divide(ahead, between * distance, out=np.zeros_like(ahead), where=between > 0)
                least = np.minimum(there[place, lists[b]], back[b, near[a]])
                np.add.at(count, (b, np.ceil(np.clip(least, 0, 1) * _STEPS).astype(int)), 1)
        who, step = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(step), pa.array(count[who, step])], ["who", "step", "n"])

    rows = coded.select("node", "unit", "list").mapInArrow(run, "who long, step long, n long").groupBy("who", "step").agg(F.sum("n").alias("n")).collect()
    count = np.zeros((len(asked), _STEPS + 1))
    for r in rows:  # at most ASKED times _STEPS + 1
        count[r.who, r.step] = r.n
    count = count[count.sum(axis=1) > 0]
    if not len(count):
        return 0.0
    found = (np.cumsum(count, axis=1) / count.sum(axis=1, keepdims=True)).mean(axis=0)
    return float(np.argmax(found >= min(RECALL, found[-1])) / _STEPS)


def vector_dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id",
                 vector_col: str = "embedding", margin: float | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    ``margin`` replaces the learned margins; 1 is exact.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(
        ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0),
        F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.col("v"))).withColumn(
        "high", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn(
        "low", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))
    some = rows.where("v is not null")
    classes = stored(some.groupBy("high", "low").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"),
                                                     F.first("v").alias("v")).withColumnRenamed("high", "node"), "vectors")
    size = classes.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width")).first()
    if not size.rows:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    width = size.width
    lists = int(min(MAX_LISTS, max(1, size.rows // LIST_ROWS)))
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(TRAIN_ROWS).select("v").toArrow()["v"].combine_chunks()
    fitted = Index(_unit(sample, width), lists)
    index = spark.sparkContext.broadcast(fitted)
    distance = float(np.sqrt(2 - 2 * cosine))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                x = _unit(batch.column(2), width)
                near, codes, left_out = index.value.encode(x)
                far = np.sqrt(((x - index.value.centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x]), pa.array(near.astype(np.int32)),
                     pa.array([c.tobytes() for c in codes]), pa.array(left_out), pa.array(far)],
                    ["node", "copies", "unit", "list", "codes", "left_out", "far"])

    coded = stored(classes.select("node", "copies", "v").mapInArrow(
        code, "node long, copies long, unit binary, list int, codes binary, left_out double, far double"), "codes")
    reach = np.full(len(fitted.centres), -1.0)
    for r in coded.groupBy("list").agg(F.max("far").alias("far")).collect():  # a row per list
        reach[r.list] = r.far
    if margin is None:
        margins = np.minimum(1, np.maximum(fitted.margins(_unit(sample, width), cosine, RECALL), _asked_margin(coded, index, cosine, width)))
    else:
        margins = np.full(len(reach), margin)
    limits = spark.sparkContext.broadcast((reach, margins))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096).drop_columns(["far"])
                x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(-1, width)
                probes = index.value.probes(x, batch.column("list").to_numpy(), distance, *limits.value)
                yield batch.append_column("probes", pa.array(probes, pa.list_(pa.int32())))

    coded = stored(coded.mapInArrow(
        probe, "node long, copies long, unit binary, list int, codes binary, left_out double, probes array<int>"), "probed")
    asked = coded.select("node", "copies", "unit", F.col("list").alias("own"), F.explode("probes").alias("list"))
    # Blocks per list, of entries and of queries: at most MAX_LISTS rows.
    blocks = (coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
              .join(asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups")), "list"))
    blocks = F.broadcast(blocks)
    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["list", "block", "group"]
    base = coded.join(blocks, "list").withColumn("block", spread("blocks")).withColumn("group", every("groups")).select(
        *keys, F.lit(0).alias("side"), "node", "copies", "unit", "codes", "left_out", "probes", F.col("list").alias("own"))
    asked = asked.join(blocks, "list").withColumn("group", spread("groups")).withColumn("block", every("blocks")).select(
        *keys, F.lit(1).alias("side"), "node", "copies", "unit", F.lit(None).cast("binary").alias("codes"),
        F.lit(None).cast("double").alias("left_out"), F.expr("cast(array() as array<int>)").alias("probes"), "own")
    met = base.union(asked).repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    links = stored(met.mapInArrow(_compare(index, cosine, width), "node long, links long, root long"), "links")
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = joined.join(classes.select("node", "rep"), "node")
    smallest = lowest(known, "component", "rep", "component_id")
    known = known.join(smallest, F.col("component") == F.col("hub")).select("node", "component_id").join(counts, "node", "left")
    known = (classes.select("node", "low", "rep", "copies").join(known, "node", "left")
             .select(F.col("node").alias("high"), "low", F.coalesce("component_id", "rep").alias("component_id"),
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = rows.select("vec_id", "high", "low").join(known, ["high", "low"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
