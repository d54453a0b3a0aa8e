"""Toxicity: cumulative-link ordinal regression from sparse word features to severity grades.

Features of a text are the distinct hashes of its lower-cased words and of their first four, five and six bytes.
All labelled documents are counted, each distinct text once, and every feature whose odds among toxic texts are over
``ODDS`` times those among clean ones, by a likelihood ratio above ``SIGNIFICANT``, is a column of the model.  A labelled document has grade 0 (not toxic), 1, 2 or 3: toxic ones by their number of distinct marker
words (a marker stands almost only in toxic texts).  The regression is P(grade > k) = sigmoid(w.x - cut_k): one weight
vector for all ordered cuts.  The result is the expected grade, the sum of those probabilities.

The regression is fitted on at most ``TRAIN_ROWS`` distinct labelled texts (by hash), everything else on all of them.
Nulls and empty texts have no features.  Repeated rows and ties are judged row by row.  With no toxic label nothing
is toxic.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tables import distinct_texts, kept_rows, labelled, per_text, stored, texts
from leadloom.llm.words import NO_LETTER, Words, chunks, mix

#: Least ratio of odds and least G squared of a feature; neither depends on the share of toxic labels.
ODDS = 3.0
SIGNIFICANT = 2.0
TRAIN_ROWS = 20_000
GRADES = 4
#: Rejecting at even odds would miss some texts with a single rare marker; labels show hardly a clean text above this.
REJECT_ABOVE = 0.3
PREFIXES = (4, 5, 6)
_FLUSH = 2_000_000
_SLOTS = 1 << 18


def _hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word) of every word and word prefix."""
    row = words.row
    made = [(words.hashes(), row, np.arange(len(row)))]
    for n in PREFIXES:
        at = np.flatnonzero(words.end - words.start > n)
        made.append((mix(words.hashed(words.start[at], words.start[at] + n) ^ np.uint64(n)), row[at], at))
    return tuple(np.concatenate(x) for x in zip(*made))


def _distinct(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value, docs, toxic = (np.concatenate(x) for x in zip(*parts))
    value, place = np.unique(value, return_inverse=True)
    return value, np.bincount(place, docs).astype(np.int64), np.bincount(place, toxic).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents of each feature, summed in the task as far as memory allows."""
    held, size = [], 0

    def out():
        value, docs, toxic = _summed(held)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(docs), pa.array(toxic)],
                                          ["feature", "docs", "toxic"])

    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in chunks(batch.column(0)):
            value, row, _ = _hashes(Words(data, offsets, lower=True, gaps=NO_LETTER))
            value, row = _distinct(value, row)
            held.append((value, np.ones(len(value)), label[first:last][row]))
            size += len(value)
            if size > _FLUSH:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > _FLUSH // 2:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


@dataclass
class Model:
    """Chosen features in the order of their low bits, their weights, the ordered cuts and the markers."""

    feature: np.ndarray
    marker: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def found(self, value: np.ndarray) -> np.ndarray:
        """Place of each hash among the features, or -1."""
        if not len(self.feature):
            return np.full(len(value), -1)
        # Nearly all hashes leave at the first look, a table of a quarter megabyte.
        seen = np.zeros(_SLOTS, bool)
        seen[self.feature & np.uint64(_SLOTS - 1)] = True
        out = np.full(len(value), -1)
        near = np.flatnonzero(seen[value & np.uint64(_SLOTS - 1)])
        at = np.minimum(np.searchsorted(self.feature, value[near]), len(self.feature) - 1)
        out[near] = np.where(self.feature[at] == value[near], at, -1)
        return out

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """Distinct (feature, text), and the number of distinct marker words of each text."""
        words = Words(data, offsets, lower=True, gaps=NO_LETTER)
        value, row, word = _hashes(words)
        place = self.found(value)
        some = place >= 0
        marked = np.unique(word[some][self.marker[place[some]]])
        kind, text = _distinct(words.hashed(words.start[marked], words.end[marked]), words.row[marked])
        feature, text_ = _distinct(place[some], row[some])
        return feature, text_, np.bincount(text, minlength=words.texts)

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) of each text, one row per k."""
        scores = [np.zeros(0)]
        for _, _, data, offsets in chunks(column):
            feature, text, _ = self.hits(data, offsets)
            scores.append(np.bincount(text, self.weight[feature], minlength=len(offsets) - 1))
        return _sigmoid(np.concatenate(scores)[None, :] - self.cuts[:, None])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Choose the features over all labelled documents, then fit weights and cuts."""
    known = labelled(texts(docs), labels, "toxic")
    once = stored(distinct_texts(known, "label"), "labelled")
    totals = once.agg(F.count("*").alias("docs"), F.sum("label").alias("toxic")).first()
    none = Model(np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0), np.full(GRADES - 1, 30.0))
    if not totals.docs or not totals.toxic:
        return none
    counted = (once.mapInArrow(_counts, "feature long, docs long, toxic long")
               .groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")))
    toxic, clean = F.col("toxic"), F.col("docs") - F.col("toxic")
    no_toxic, no_clean = totals.toxic - toxic, totals.docs - totals.toxic - clean
    odds = (toxic + 0.5) * (no_clean + 0.5) / ((clean + 0.5) * (no_toxic + 0.5))

    def part(seen, with_, of):
        return F.when(seen > 0, 2 * seen * F.log(seen * float(totals.docs) / (with_ * F.lit(float(of))))).otherwise(0.0)

    without = totals.docs - F.col("docs")
    g = (part(toxic, F.col("docs"), totals.toxic) + part(clean, F.col("docs"), totals.docs - totals.toxic)
         + part(no_toxic, without, totals.toxic) + part(no_clean, without, totals.docs - totals.toxic))
    share = (toxic + 0.5) / (F.col("docs") + 1.0)
    chosen = (counted.where(toxic >= 2).withColumn("share", share)
              .where((odds > ODDS) & (g > SIGNIFICANT)).select("feature", "share").collect())
    if not chosen:
        return none
    chosen.sort(key=lambda r: r.feature % (1 << 64))
    feature = np.array([r.feature % (1 << 64) for r in chosen], np.uint64)
    model = Model(feature, np.array([r.share >= 0.8 for r in chosen]), np.zeros(len(chosen)), np.zeros(GRADES - 1))

    def sparse(batches):
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(0)):
                place, text, marked = model.hits(data, offsets)
                each = np.split(place.astype(np.int32), np.searchsorted(text, np.arange(1, last - first)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[first:last], pa.array(each, pa.list_(pa.int32())), pa.array(marked)],
                    ["label", "places", "marked"])

    picked = once.select(F.xxhash64("text").alias("hash")).orderBy("hash").limit(TRAIN_ROWS)
    sample = once.join(F.broadcast(picked), F.xxhash64("text") == F.col("hash"), "left_semi")
    rows = sample.mapInArrow(sparse, "label int, places array<int>, marked long").toPandas()
    return _regress(model, rows)


def _regress(model: Model, rows) -> Model:
    """Penalised maximum likelihood by Adam steps over the whole sample; the order of rows doesn't matter much, so it is fixed."""
    rows = rows.iloc[np.lexsort((rows.places.map(lambda p: hash(tuple(p))), rows.marked, rows.label))]
    grade = np.where(rows.label > 0, 1 + np.clip(rows.marked.to_numpy() - 1, 0, GRADES - 2), 0)
    size = rows.places.map(len).to_numpy()
    place = np.concatenate([np.zeros(0, np.int64), *rows.places]).astype(np.int64)
    text = np.repeat(np.arange(len(rows)), size)
    n, m, cuts = len(rows), len(model.feature), GRADES - 1
    over = (grade[None, :] > np.arange(cuts)[:, None]).astype(float)
    theta = np.concatenate([np.zeros(m), [2.0], np.zeros(cuts - 1)])  # weights, first cut, logs of the steps to the next
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 401):
        weight, steps = theta[:m], np.exp(theta[m + 1:])
        edge = theta[m] + np.concatenate([[0], np.cumsum(steps)])
        z = np.bincount(text, weight[place], minlength=n)
        # Likelihood of the grade itself: the difference of two neighbouring tails.
        tail = np.vstack([np.ones(n), _sigmoid(z[None, :] - edge[:, None]), np.zeros(n)])
        slope = tail * (1 - tail)
        at = np.arange(n)
        chance = np.maximum(tail[grade, at] - tail[grade + 1, at], 1e-9)
        low, high = slope[grade, at] / chance, slope[grade + 1, at] / chance
        by_z = low - high
        by_edge = np.array([-(low[grade == k + 1].sum()) + high[grade == k].sum() for k in range(cuts)])
        gradient = np.concatenate([
            np.bincount(place, by_z[text], minlength=m) / n - 1e-4 * weight,
            [by_edge.sum() / n], [by_edge[k + 1:].sum() * steps[k] / n for k in range(cuts - 1)]])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient ** 2
        theta = theta + 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    edge = theta[m] + np.concatenate([[0], np.cumsum(np.exp(theta[m + 1:]))])
    return Model(model.feature, model.marker, np.round(theta[:m], 6), np.round(edge, 6))


def toxicity(docs: DataFrame, labels: DataFrame, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """doc_id, expected severity 0..3, chance of any toxicity, most likely grade, and whether the text is rejected."""
    model = fit(docs, labels)

    def work(column):
        tails = model.tails(column)
        chance = -np.diff(np.vstack([np.ones((1, tails.shape[1])), tails, np.zeros((1, tails.shape[1]))]), axis=0)
        return {"severity": tails.sum(axis=0), "toxic_chance": tails[0], "grade": chance.argmax(axis=0).astype(np.int32),
                "toxic": tails[0] > reject_above}

    return per_text(texts(docs), "severity double, toxic_chance double, grade int, toxic boolean", work)


def mild_documents(docs: DataFrame, labels: DataFrame, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """The documents, all columns as they are, that are not rejected."""
    model = fit(docs, labels)
    return kept_rows(docs, "text", lambda column: ~(model.tails(column)[0] > reject_above))
