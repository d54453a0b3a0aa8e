"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is read as its lower-cased words, one space between them and one end mark, so the model and the word-unigram
base score the same events.  Every byte is a path of yes/no decisions in the Huffman tree of the training bytes that
follow the byte before it.  Three predictors estimate each decision from counts under a hashed context: the last four
bytes, the current word so far, and that with the word before it.  Their log odds are added with weights
chosen by a gate: the depth of the decision and the place in the word.  The weights are learned online, in small steps,
on every sixteenth training document, which the context counts leave out; tasks' weights are averaged by
use.  While a text is scored its own correction to the weights is refined after 256, 512, 1024, ... bytes from what it
has shown so far.

All counts cover all training documents.  The hashed tables have a fixed size (``BITS``), so their broadcast doesn't
grow; words counted often are broadcast up to ``FREQUENT`` entries, all others are looked up by a join.

Words are counted by 64-bit hash.  Null and empty texts are the end mark alone.  A null id counts as the empty text for
the folds.  Repeated rows are scored and counted row by row.  Without training documents the predictors know nothing and
every decision is even.
"""

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tables import fold, stored, texts
from leadloom.llm.words import SPACE, Words, _power, chunks, mix, top_bits

FOLDS = 10
MIXING_FOLDS = 16
#: Table sizes, as powers of two, of the contexts: four bytes, word, two words.
BITS = (21, 22, 22)
GATES = 256
FREQUENT = 500_000
BLOCK = 4096
#: Counts that a table slot starts with on either side.
PRIOR = 0.4
SEGMENT, LONGEST_SEGMENT = 256, 65_536
STEP = 4096
#: Bytes whose decisions are made at once: their arrays stay in the processor's cache.
_WINDOW = 1 << 15
RATE, DAMPING, INERTIA = 0.15, 0.3, 20.0
_CHUNK = 1 << 18
_UNIT = 256.0  # log odds are kept as 16-bit numbers in this unit
_LIMIT = 14.0
_END_TOKEN = np.int64(-1)
_U = np.uint64
_TOP = [sum(1 << b for b in BITS[:k]) for k in range(len(BITS) + 1)]


def _code(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Huffman code of all bytes, (node, bit) from the root down; the nodes of frequent bytes have small numbers."""
    heap = [(int(c) * 256 + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    for node in range(256, 511):
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        above[left], above[right] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node, node))
    paths = []
    for byte in range(256):
        path, at = [], byte
        while at in above:
            at, bit = above[at]
            path.append((510 - at, bit))
        paths.append(path[::-1])
    return paths


@dataclass
class Tree:
    """A Huffman code for each preceding byte: where the decisions of (before, byte) start in a flat array, and how many.

    A decision is a node number, its depth times 16 from bit 16 on, and the outcome as bit 24.  All numbers, slots and gates
    are as wide as an index, as numpy would otherwise copy them in small buffers whenever they look something up.
    """

    start: np.ndarray
    length: np.ndarray
    decision: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray) -> "Tree":
        """From the counts of byte pairs; bytes that never come before share one code."""
        pairs = pairs.reshape(256, 256)
        rest = _code(pairs.sum(axis=0))
        paths = [path for before in pairs for path in (_code(before) if before.any() else rest)]
        length = np.array([len(p) for p in paths], np.int64)
        flat = [n | min(d, 15) << 20 | b << 24 for p in paths for d, (n, b) in enumerate(p)]
        return cls(np.cumsum(length) - length, length, np.array(flat, np.int64))


class Stream:
    """The texts of a chunk as bytes to predict, with the context hashes of each byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=True)
        self.words, self.texts = words, words.texts
        empty = words.count == 0
        units = np.maximum(words.count, 1)
        unit_length = np.ones(units.sum(), np.int64)
        unit_length[np.arange(len(words.start)) + np.cumsum(empty)[words.row]] = words.end - words.start + 1
        stop = np.cumsum(unit_length) - 1
        last = np.cumsum(units) - 1
        n = int(stop[-1]) + 1 if len(stop) else 0
        inside = np.ones(n, bool)
        inside[stop] = False
        self.data = np.empty(n, np.uint8)
        self.data[inside] = words.data[~SPACE[data]]
        self.data[stop] = 0x20
        self.data[stop[last]] = 0x0A
        self.size = np.diff(stop[last], prepend=-1)
        self.first = np.cumsum(self.size) - self.size
        self.before = np.empty(n, np.uint8)
        self.before[1:] = self.data[:-1]
        self.before[:1] = 0x0A
        self._units = unit_length, stop, units

    def pairs(self) -> np.ndarray:
        """Each byte with the one before it, as a number."""
        return self.before.astype(np.int64) << 8 | self.data

    def hashes(self) -> np.ndarray:
        """``Words.hashes`` of the texts, from what ``prepare`` has summed."""
        return mix(self._whole[np.repeat(self.words.count > 0, self._units[2])])

    def prepare(self) -> "Stream":
        """Context hashes and the place in the word, for predicting."""
        unit_length, stop, units = self._units
        n = len(self.data)
        begin = stop - unit_length + 1
        padded = np.full(n + 4, 0x0A, np.uint8)
        padded[4:] = self.data
        four = padded[3:n + 3].astype(np.uint32)
        for k in range(2, 5):
            part = padded[4 - k:n + 4 - k].astype(np.uint32)
            part <<= np.uint32(8 * (k - 1))
            four |= part
        for k in range(4):  # the bytes before a text's first ones are line ends
            at = self.first[self.size > k] + k
            own = np.uint32((1 << 8 * k) - 1)
            four[at] = four[at] & own | np.uint32(0x0A0A0A0A) & ~own
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            sums[1:] = self.data
            sums[1:] += _U(1)
            sums[1:] *= _power("up", n)
            np.cumsum(sums[1:], out=sums[1:])
            back = _power("down", n + 1)[begin]
            self._whole = whole = (sums[stop] - sums[begin]) * back
            earlier = np.zeros(len(stop), np.uint64)
            earlier[1:] = whole[:-1]
            earlier[np.cumsum(units) - units] = 0
            unit = np.zeros(n, np.int64)
            unit[begin[1:]] = 1
            np.cumsum(unit, out=unit)
            word = sums[:-1] - sums[begin].take(unit)
            word *= back.take(unit)
            self.contexts = [top_bits(four, 1, BITS[0]), top_bits(word, 2, BITS[1])]
            word += mix(earlier + _U(99)).take(unit)
            self.contexts.append(top_bits(word, 3, BITS[2]))
        letters = np.arange(n)
        letters -= begin.take(unit)
        self.letters = np.minimum(letters, 15, out=letters).astype(np.uint8)
        return self

    def _steps(self, tree: Tree, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of decisions of each byte at ``at``; all of them, and which of these bytes each belongs to."""
        pair = self.before[at].astype(np.int64)
        pair <<= 8
        pair |= self.data[at]
        length = tree.length.take(pair)
        end = np.cumsum(length)
        which = np.zeros(end[-1], np.int64)
        which[end[:-1]] = 1
        np.cumsum(which, out=which)
        flat = (tree.start.take(pair) - end + length).take(which)
        flat += np.arange(len(flat))
        return length, tree.decision.take(flat), which

    def decisions(self, tree: Tree, at: np.ndarray | slice):
        """Number of decisions of each byte at ``at``; gate, outcome and one table slot per context of each decision.

        The decisions of one context lie side by side in its table, so they share a cache line.
        """
        length, decision, which = self._steps(tree, at)
        node = decision & 0xFFFF
        decision >>= 16
        gate = decision & 0xFF
        gate |= self.letters[at].take(which)
        decision >>= 8
        slots = []
        for context, bits in zip(self.contexts, BITS):
            slot = context[at].astype(np.int64).take(which)
            slot += node
            slot &= (1 << bits) - 1
            slots.append(slot)
        return length, gate, decision, slots

    def outcomes(self, tree: Tree, at: np.ndarray | slice) -> Iterator[np.ndarray]:
        """For each context twice the slot of each decision, plus the outcome."""
        _, decision, which = self._steps(tree, at)
        step = decision & 0xFFFF
        step <<= 1
        decision >>= 24
        step |= decision
        for context, bits in zip(self.contexts, BITS):
            place = (context[at].astype(np.int64) << 1).take(which)
            place += step
            place &= (2 << bits) - 1
            yield place


def _windows(n: int, width: int = _WINDOW):
    for i in range(0, n, width):
        yield slice(i, i + width)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word hashes (kind 0) and of byte pairs (kind 1), summed in the task as far as memory allows."""
    held, size, pairs, ends = [], 0, np.zeros(1 << 16, np.int64), 0

    def summed():
        value, place = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        return value, np.bincount(place, np.concatenate([c for _, c in held])).astype(np.int64)

    def out(kind, value, count):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), kind, np.int32)), pa.array(value), pa.array(count)],
                                          ["kind", "token", "n"])

    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(0)):
            stream = Stream(data, offsets)
            value, count = np.unique(stream.words.hashes(), return_counts=True)
            held.append((value.view(np.int64), count))
            size += len(value)
            pairs += np.bincount(stream.pairs(), minlength=1 << 16)
            ends += last - first
            if size > 2_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield out(0, *held[0])
                    held, size = [], 0
    met = np.flatnonzero(pairs)
    yield out(1, met, pairs[met])
    if ends:
        yield out(0, np.array([_END_TOKEN]), np.array([ends]))
    if held:
        yield out(0, *summed())


def _context_counts(tree: Tree):
    """Counts of both outcomes in every slot, by blocks of ``BLOCK`` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * _TOP[-1], np.int32)
        tables = [counts[2 * low:2 * high] for low, high in zip(_TOP[:-1], _TOP[1:])]
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), _CHUNK):
                stream = Stream(data, offsets).prepare()
                for at in _windows(len(stream.data)):
                    for table, places in zip(tables, stream.outcomes(tree, at)):
                        np.add.at(table, places, np.int32(1))
        # Most counts fit a byte and most bytes are 0 or 1, which deflate brings to about two bits.
        for block, part in enumerate(counts.reshape(-1, 2 * BLOCK)):
            if part.any():
                large = np.flatnonzero(part > 255)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([zlib.compress(np.minimum(part, 255).astype(np.uint8), 1)]),
                     pa.array([large.astype(np.uint16).tobytes()]), pa.array([(part[large] - 255).tobytes()])],
                    ["block", "small", "places", "rest"])

    return run


def _log_odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the blocks of a partition as they come (all blocks together have a fixed size) and gives their log odds."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, small, places, rest in zip(*(c.to_pylist() for c in batch.columns)):
            if block not in total:
                total[block] = np.zeros(2 * BLOCK, np.int64)
            total[block] += np.frombuffer(zlib.decompress(small), np.uint8)
            total[block][np.frombuffer(places, np.uint16)] += np.frombuffer(rest, np.int32)
    for block, sums in total.items():
        odds = np.log((sums[1::2] + PRIOR) / (sums[::2] + PRIOR))
        kept = np.clip(np.round(odds * _UNIT), -32767, 32767).astype(np.int16)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kept.tobytes()])], ["block", "odds"])


@dataclass
class Mixer:
    """Tree, log odds of all slots, and the weight of each context at each gate."""

    tree: Tree
    odds: np.ndarray
    weight: np.ndarray

    def inputs(self, slots: list[np.ndarray]) -> list[np.ndarray]:
        """Log odds of each decision under each context, in units of 1 / _UNIT."""
        return [self.odds[_TOP[k]:_TOP[k + 1]].take(slot).astype(np.float32) for k, slot in enumerate(slots)]

    def learned(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weights after online steps over the task's documents, times the gate's decisions, and those decisions."""
        weight, power, use = self.weight.astype(np.float64), np.ones(self.weight.shape), np.zeros(GATES)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), _CHUNK):
                stream = Stream(data, offsets).prepare()
                for at in _windows(len(stream.data), LONGEST_SEGMENT):
                    _, gates, bit, slots = stream.decisions(self.tree, at)
                    x = np.stack(self.inputs(slots)) / _UNIT
                    for i in range(0, len(gates), STEP):
                        gate, part = gates[i:i + STEP], x[:, i:i + STEP]
                        z = np.clip((weight.take(gate, axis=1) * part).sum(axis=0), -_LIMIT, _LIMIT)
                        wrong = bit[i:i + STEP] - 1 / (1 + np.exp(-z))
                        use += np.bincount(gate, minlength=GATES)
                        for k in range(len(BITS)):
                            slope = np.bincount(gate, wrong * part[k], minlength=GATES)
                            power[k] += slope ** 2
                            weight[k] += RATE * slope / np.sqrt(power[k])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(GATES, dtype=np.int32), len(BITS))),
             pa.array(np.repeat(np.arange(len(BITS), dtype=np.int32), GATES)),
             pa.array((weight * use).ravel()), pa.array(np.tile(use, len(BITS)))], ["gate", "context", "weighted", "used"])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Stream]:
        """Natural log probability and number of bytes of each text, its weights refined as it goes; and the texts' stream."""
        stream = Stream(data, offsets).prepare()
        weight = (self.weight / _UNIT).astype(np.float32)
        total = np.zeros(stream.texts)
        own = np.zeros((len(BITS), stream.texts), np.float32)
        bend = np.zeros(own.shape)  # curvature of a text's log probability per decision, from its first bytes
        curve = np.full(own.shape, INERTIA * _UNIT ** 2)
        start, width = 0, SEGMENT
        longest = int(stream.size.max()) if stream.texts else 0
        while start < longest:
            on = stream.size > start + width
            for live in (np.flatnonzero(on), np.flatnonzero((stream.size > start) & ~on)):
                length = np.minimum(stream.size[live] - start, width)
                for some in np.split(live, np.flatnonzero(np.diff(np.cumsum(length) // _WINDOW)) + 1):
                    if len(some):
                        self._segment(stream, some, start, width, weight, own, bend, curve, total)
            start, width = start + width, min(2 * width, LONGEST_SEGMENT)
        return total, stream.size, stream

    def _segment(self, stream: Stream, live, start: int, width: int, weight, own, bend, curve, total) -> None:
        """Score the bytes from ``start`` of the texts ``live``; if they go on after ``width`` bytes, refine their weights."""
        size = np.minimum(stream.size[live] - start, width)
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(stream.first[live] + start - begin, size)
        length, gate, bit, slots = stream.decisions(self.tree, at)
        edges = np.add.reduceat(length, begin)
        x = self.inputs(slots)
        z = np.zeros(len(gate), np.float32)
        for k in range(len(BITS)):
            w = weight[k].take(gate)
            if start:
                w += np.repeat(own[k][live], edges)
            w *= x[k]
            z += w
        sign = bit.astype(np.float32)
        sign += sign
        sign -= 1
        z *= sign  # log odds of what came
        np.clip(z, -_LIMIT, _LIMIT, out=z)
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        first = np.cumsum(edges) - edges
        total[live] -= np.add.reduceat(np.log(z), first, dtype=np.float64)
        if stream.size[live[0]] <= start + width:
            return
        np.divide(1, z, out=z)
        if not start:
            spread = z * (1 - z)
        z -= 1
        z *= sign  # what the model gave away
        for k in range(len(BITS)):
            if not start:
                bend[k][live] = np.add.reduceat(spread * x[k] * x[k], first, dtype=np.float64) / edges
            slope = -np.add.reduceat(z * x[k], first, dtype=np.float64)
            curve[k][live] += bend[k][live] * edges
            own[k][live] += DAMPING * slope / curve[k][live]


def train(known: DataFrame, pairs: np.ndarray) -> Mixer:
    """The mixer from the training texts (doc_id, text)."""
    tree = Tree.of(pairs)
    mixing = F.pmod(F.xxhash64("doc_id"), F.lit(MIXING_FOLDS)) == 0
    blocks = (known.where(~mixing).select("text").mapInArrow(_context_counts(tree), "block int, small binary, places binary, rest binary")
              .repartition("block").mapInArrow(_log_odds, "block int, odds binary"))
    odds = np.zeros(_TOP[-1], np.int16)
    for r in blocks.collect():
        odds[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.odds, np.int16)
    mixer = Mixer(tree, odds, np.full((len(BITS), GATES), 0.3, np.float32))
    shared = known.sparkSession.sparkContext.broadcast(mixer)
    learned = (known.where(mixing).select("text")
               .mapInArrow(lambda batches: shared.value.learned(batches), "gate int, context int, weighted double, used double")
               .groupBy("gate", "context").agg(F.sum("weighted").alias("weighted"), F.sum("used").alias("used")))
    for r in learned.where("used > 0").collect():
        mixer.weight[r.context, r.gate] = round(r.weighted / r.used, 4)
    return mixer


def lm_scoring(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), bits_per_byte of every document."""
    docs = texts(docs)
    spark = docs.sparkSession
    known = docs.where(fold(F.col("doc_id"), folds) != 0)
    counts = stored(known.select("text").mapInArrow(_tokens, "kind int, token long, n long")
                    .groupBy("kind", "token").agg(F.sum("n").alias("n")), "tokens")
    pairs = np.zeros(1 << 16, np.int64)
    for r in counts.where("kind = 1").collect():
        pairs[r.token] = r.n
    tokens = counts.where("kind = 0")
    sums = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    # The lowest power of two above which at most FREQUENT words are counted.
    sizes = sorted(tokens.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), key=lambda r: -r.power)
    power, held = 64, 0
    for r in sizes:
        held += r["count"]
        if held > FREQUENT:
            break
        power = r.power
    often = tokens.where(F.floor(F.log2("n")) >= power).select("token", "n").toArrow()
    token, n = (often[c].to_numpy() for c in ("token", "n"))
    order = np.argsort(token)
    shared = spark.sparkContext.broadcast((token[order], np.log10(n[order] + 0.1), train(known, pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, log, mixer = shared.value
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1), _CHUNK):
                chance, size, stream = mixer.score(data, offsets)
                words = stream.words
                row = np.concatenate([words.row, np.arange(words.texts)])
                value = np.concatenate([stream.hashes().view(np.int64), np.full(words.texts, _END_TOKEN)])
                each, place = np.unique(value, return_inverse=True)  # in order they are found with fewer cache misses
                at = np.minimum(np.searchsorted(token, each), max(len(token) - 1, 0))
                met = token[at] == each if len(token) else np.zeros(len(each), bool)
                found, at = met[place], at[place]
                logs = np.bincount(row[found], log[at[found]], minlength=words.texts)
                rare, rest = row[~found], value[~found]
                by_text = np.argsort(rare, kind="stable")
                bounds = np.searchsorted(rare[by_text], np.arange(words.texts + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(words.count + 1), pa.array(np.bincount(row[found], minlength=words.texts)),
                     pa.array(logs), pa.array(chance / np.log(10)), pa.array(-chance / np.log(2) / size),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(rest[by_text]))],
                    ["doc_id", "n_tokens", "often", "logs", "score", "bits_per_byte", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, often long, logs double, score double, "
                                  "bits_per_byte double, rare array<bigint>")
    scored = stored(scored.withColumn("place", F.monotonically_increasing_id()), "scored")
    rare = scored.select("place", F.explode("rare").alias("token")).groupBy("place", "token").agg(F.count("*").alias("times"))
    met = rare.join(tokens.select("token", "n"), "token", "left").groupBy("place").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_logs"))
    even = float(np.log10(sums.n + 0.1 * (sums.words + 1)))
    return (scored.drop("rare").join(met, "place", "left").select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens",
        (F.col("often") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(sums.n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(even)).alias("base_score"),
        "score", "bits_per_byte"))
