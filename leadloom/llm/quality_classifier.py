"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

A text's features are hashed counts of words and of runs of one to three character kinds (letter, capital, digit, each
sign, space, line end), as logarithms weighted by inverse document frequency, the two blocks each of length 1.  A
truncated singular value decomposition of a sample of labelled texts gives the latent space.  The sample's vectors are
broadcast, the cosine of every document to every one of them is worked out exactly in blocks, and the score is the share
of label 1 among the ``NEIGHBOURS`` nearest, each weighted by its similarity.  Both labels weigh the same in the sample;
the score puts the share of label 1 among all labelled training documents back in.

Document frequencies cover all documents.  The sample has at most ``TRAIN_ROWS`` labelled rows, half of each label where
there are enough, by hash of the id; rows with the same id and text are one, however often they are repeated; held-out documents
are never in it.  Nulls and empty texts have no features and score the share of label 1.  Repeated rows and ties are scored row by row; of equally near neighbours those
that come first in the sample count.  With no labelled document every score is 0.5.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tables import fold, labelled, per_text, texts
from leadloom.llm.words import Words, chunks

TRAIN_ROWS = 4000
BUCKETS = 2048
DIMENSIONS = 48
NEIGHBOURS = 25
FOLDS = 5
PREDICT_AT = 0.3
#: A larger count says no more.
MOST = 65_535
_BLOCK = 256


def _kinds() -> np.ndarray:
    """The kind of each byte: letters of either case and bytes of longer characters, digits, and each sign by itself."""
    out = np.arange(256, dtype=np.uint32)
    out[ord("a"):ord("z") + 1] = ord("a")
    out[ord("A"):ord("Z") + 1] = ord("A")
    out[ord("0"):ord("9") + 1] = ord("0")
    out[128:] = ord("a")
    return out


_KIND = _kinds()


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of 2 * BUCKETS counts: character kinds, then words."""
    n = len(offsets) - 1
    out = np.zeros((n, 2 * BUCKETS), np.float32)
    if not len(data):
        return out
    kind = _KIND[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    gram = np.zeros(len(data), np.uint32)
    for length in (1, 2, 3):
        last = len(data) - length + 1
        if last <= 0:
            break
        gram = gram[:last] * np.uint32(256) + kind[length - 1:]
        inside = row[:last] == row[length - 1:]
        # Runs of letters say little and are nearly all runs; they are left to the word block.
        telling = inside & (gram != sum(ord("a") << 8 * k for k in range(length)))
        bucket = ((gram[telling] + np.uint32(length)) * np.uint32(0x9E3779B1)) >> np.uint32(21)
        out[:, :BUCKETS] += np.bincount(row[:last][telling] * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    words = Words(data, offsets, lower=True)
    bucket = (words.hashes() % np.uint64(BUCKETS)).astype(np.int64)
    out[:, BUCKETS:] = np.bincount(words.row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, held = 0, np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(0)):
            for part, bounds in _blocks(data, offsets):
                held += (counts(part, bounds) > 0).sum(axis=0)
            docs += last - first
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 2 * BUCKETS, dtype=np.int32)), pa.array([docs, *held])], ["bucket", "n"])


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """The texts of a chunk by ``_BLOCK``, for each has a dense row."""
    for i in range(0, len(offsets) - 1, _BLOCK):
        bounds = offsets[i:i + _BLOCK + 1]
        yield data[bounds[0]:bounds[-1]], bounds - bounds[0]


def _weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    for half in (x[:, :BUCKETS], x[:, BUCKETS:]):
        half /= np.maximum(np.sqrt((half ** 2).sum(axis=1, keepdims=True)), 1e-12)
    return x


class Neighbours:
    """Latent space, labelled vectors in it and their labels."""

    def __init__(self, count: np.ndarray, label: np.ndarray, idf: np.ndarray, prior: float):
        self.idf, self.prior, self.label = idf.astype(np.float32), prior, label.astype(np.float32)
        x = _weighted(count, self.idf)
        # Singular vectors from a random projection with a fixed seed and three power rounds.
        start = np.random.default_rng(7).standard_normal((x.shape[1], DIMENSIONS + 16)).astype(np.float32)
        basis = np.linalg.qr(x.T @ (x @ start))[0]
        for _ in range(3):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        small = np.linalg.svd(x @ basis, full_matrices=False)[2][:DIMENSIONS]
        self.space = (basis @ small.T).astype(np.float32)
        self.vectors = self.latent(count)
        # Weight of each label so that the sample counts as the labelled documents do.
        ones = max(label.sum(), 1)
        zeros = max((1 - label).sum(), 1)
        self.weight = np.where(label > 0, prior / ones, (1 - prior) / zeros).astype(np.float32)

    def latent(self, count: np.ndarray) -> np.ndarray:
        x = _weighted(count, self.idf) @ self.space
        return x / np.maximum(np.sqrt((x ** 2).sum(axis=1, keepdims=True)), 1e-12)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        k = min(NEIGHBOURS, len(self.label))
        for part, bounds in _blocks(data, offsets):
            count = np.minimum(counts(part, bounds), MOST)
            cosine = self.latent(count) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
            for row in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):  # ties at the border
                near[row] = np.argsort(-cosine[row], kind="stable")[:k]
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 4 * self.weight[near]
            total = vote.sum(axis=1)
            share = (vote * self.label[near]).sum(axis=1) / np.where(total > 0, total, 1)
            out.append(np.where((total > 0) & count.any(axis=1), share, self.prior))
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS) -> Neighbours | None:
    """Neighbours from the labelled documents outside the held-out fold; None without any."""
    docs = texts(docs)
    known = labelled(docs, labels, column, F.min).where(fold(F.col("doc_id"), folds) != 0)
    known = known.withColumn("row", F.xxhash64("doc_id", "text"))
    ids = known.select("doc_id", "row", "label")
    totals = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}
    if not totals:
        return None
    each = {0: min(totals.get(0, 0), TRAIN_ROWS // 2), 1: min(totals.get(1, 0), TRAIN_ROWS // 2)}
    picked = None
    for label, rows in each.items():
        some = ids.where(F.col("label") == label).select("doc_id", "row").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(rows)
        picked = some if picked is None else picked.union(some)

    def counted(batches):
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(0)):
                for part, bounds in _blocks(data, offsets):
                    rows = len(bounds) - 1
                    made = np.minimum(counts(part, bounds), MOST).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1)[first:first + rows], batch.column(2)[first:first + rows],
                         pa.array([m.tobytes() for m in made])], ["doc_id", "label", "counts"])
                    first += rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = (known.join(F.broadcast(picked.select("row")), "row", "left_semi").dropDuplicates(["row"]).select("text", "doc_id", "label")
              .mapInArrow(counted, f"doc_id {kind}, label int, counts binary").toPandas())
    sample = sample.sort_values(["doc_id", "label", "counts"])
    found = docs.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = {r.bucket: r.n for r in found.collect()}
    rows = frequency.pop(-1)
    idf = np.log((1 + rows) / (1 + np.array([frequency[b] for b in range(2 * BUCKETS)]))) + 0.05
    count = np.stack([np.frombuffer(c, np.uint16) for c in sample["counts"]]).astype(np.float32)
    return Neighbours(count, sample["label"].to_numpy(), idf, totals.get(1, 0) / sum(totals.values()))


def quality_classifier(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, folds=folds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(column):
        if shared.value is None:
            return {"score": np.full(len(column), 0.5)}
        made = [shared.value.score(data, offsets) for _, _, data, offsets in chunks(column)]
        return {"score": np.concatenate(made) if made else np.zeros(0)}

    return per_text(texts(docs), "score double", work).select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
        (F.col("score") >= predict_at).cast("int").alias("predicted"))
