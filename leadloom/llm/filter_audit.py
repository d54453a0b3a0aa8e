"""How five document filters act together, in every order, with exact duplicates found by radix tries of whole texts.

The first four filters look at a text alone; the fifth fails a document whose text equals that of a smaller id.  Each
task inserts whole texts into a compressed trie, which unites copies before anything moves.  Texts are then dealt out by
ranges: the cuts are prefixes, each as long as needed to tell it from the cut before.  Every bucket is inserted into one
trie whose terminals hold the smallest id; a walk over it turns ids into the fifth flag, and only counts per
(part, mask of failed filters, labels) leave the task.

Defined results: a null text is empty (it fails A alone, and E where a smaller id is empty too); a null ``lang`` is the part ''.
A null id is neither smaller than any other nor fails E.  Rows that repeat an id don't fail E by each other.  Of several
labels of one id, one that says 1 counts; a null label counts as no label.  An empty table gives no rows.
"""

import bisect
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tables import BROADCAST_LABELS

#: Bytes of text that a task unites before it hands them on, and that a bucket should hold: together they bound a trie.
COMBINE_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20
#: At most so many cuts; beyond, each range is dealt out further by a hash of the whole text.
MAX_CUTS = 65_536
#: Texts sampled per cut, and the code points of them that a cut may use.  Both only move cuts, never results.
SAMPLED_PER_CUT = 4
CUT_CHARS = 64

UPPER = bytes(range(65, 91))
SIGNS = b"#$%&*|"
LETTERS = "ABCDE"


def failed(text: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # bytes split at 20 and 09-0D only
    return ((len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words))
            + 4 * (100 * (len(text) - len(text.translate(None, UPPER))) > 10 * code_points)
            + 8 * (len(text.translate(None, SIGNS)) < len(text)))


class Trie:
    """A compressed trie over bytes.  A node is [edge, children by first byte, value or None]."""

    def __init__(self):
        self.root, self.bytes = [b"", {}, None], 0

    def terminal(self, text: bytes) -> list:
        """The node at which ``text`` ends, made where it is missing."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None]
                node[1][text[at]] = child
                self.bytes += len(text) - at
                return child
            edge = child[0]
            if not text.startswith(edge, at):
                same = _common(edge, text, at)
                child = [edge[:same], {edge[same]: [edge[same:], child[1], child[2]]}, None]
                node[1][text[at]] = child
                edge = child[0]
            node, at = child, at + len(edge)
        return node

    def walk(self) -> Iterator[tuple[bytes, object]]:
        """(text, value) of every terminal."""
        path = [(self.root, b"")]
        while path:
            node, above = path.pop()
            here = above + node[0]
            if node[2] is not None:
                yield here, node[2]
            path.extend((child, here) for child in node[1].values())


def _common(edge: bytes, text: bytes, at: int) -> int:
    """Length of the longest start of ``edge`` that stands in ``text`` at ``at``; it is known to be shorter than edge."""
    low, high = 1, len(edge) - 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if text.startswith(edge[:middle], at) else (low, middle - 1)
    return low


def cuts(docs: DataFrame) -> tuple[list[bytes], int]:
    """Sorted cut prefixes from a sample, and the number of parts into which a hash deals each range."""
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    wanted = max(1, -(-(size.bytes or 0) // BUCKET_BYTES))
    ranges = min(wanted, MAX_CUTS)
    share = min(1.0, ranges * SAMPLED_PER_CUT / max(size.rows, 1))
    order = F.xxhash64("doc_id", F.octet_length("text"))
    sample = sorted(r.start.encode() for r in docs.where(order <= int(share * 2 ** 64) - 2 ** 63 - 1).select(
        F.substring("text", 1, CUT_CHARS).alias("start")).limit(2 * ranges * SAMPLED_PER_CUT).collect())
    at = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    out, before = [], b""
    for text in at:
        # As many bytes as tell it from the cut before; equal cuts stay equal and share their range by hash.
        same = next((k for k, (a, b) in enumerate(zip(text, before)) if a != b), min(len(text), len(before)))
        out.append(text if text == before else text[:same + 1])
        before = text
    return sorted(out), -(-wanted // ranges)


def _bucket(text: bytes, at: list[bytes], parts: int) -> int:
    """The range of a text; copies always meet, and different texts behind equal cuts are dealt out by hash."""
    first, last = bisect.bisect_left(at, text), bisect.bisect_right(at, text)
    if last and (last == len(at) or at[last] != at[last - 1]):
        first = bisect.bisect_left(at, at[last - 1])  # cuts equal to the one below share their range
    key = zlib.crc32(text)
    return (first + key % max(1, last - first)) * parts + (key // 65_537) % parts


_UNITED = "bucket long, text binary, lang string, good boolean, toxic boolean, mask int, n_null long, n_ids long, n_first long"


def _united(docs: DataFrame, at: list[bytes], parts: int) -> DataFrame:
    """One row per text, part and labels of each task: the smallest id, and how many rows have it."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()

        def emitted():
            rows = [(_bucket(text, at, parts), text, *group, mask, *found) for text, (mask, groups) in trie.walk()
                    for group, found in groups.items()]
            for start in range(0, len(rows), 2000):
                cols = list(zip(*rows[start:start + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                    id_type))], [*(c.split()[0] for c in _UNITED.split(", ")), "first_id"])

        for batch in batches:
            id_type = batch.column(0).type
            ids, texts, *rest = (batch.column(k).to_pylist() for k in range(batch.num_columns))
            for doc_id, text, *group in zip(ids, texts, *rest):
                data = text.encode()
                node = trie.terminal(data)
                if node[2] is None:
                    node[2] = (failed(data, len(text)), {})
                found = node[2][1].setdefault(tuple(group), [0, 0, 0, None])
                if doc_id is None:
                    found[0] += 1
                    continue
                found[1] += 1
                if found[3] is None or doc_id < found[3]:
                    found[2], found[3] = 0, doc_id
                found[2] += doc_id == found[3]
            if trie.bytes > COMBINE_BYTES:
                yield from emitted()
                trie = Trie()
        if trie.root[1] or trie.root[2]:
            yield from emitted()

    return docs.mapInArrow(run, f"{_UNITED}, first_id {kind.simpleString()}")


def _masks(united: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n) from the tries of all buckets; a task holds one bucket's trie at a time."""

    def counted(trie: Trie, counts: dict):
        for _, (mask, groups) in trie.walk():
            smallest = min((g[-1] for g in groups if g[-1] is not None), default=None)
            for lang, good, toxic, n_null, n_ids, n_first, first_id in groups:
                different = n_first if first_id == smallest else 0
                for bits, n in ((mask, n_null + different), (mask + 16, n_ids - different)):
                    if n:
                        key = (lang, bits, good, toxic)
                        counts[key] = counts.get(key, 0) + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counts, now = Trie(), {}, None
        for batch in batches:
            for bucket, text, lang, good, toxic, mask, *found in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    counted(trie, counts)
                    trie, now = Trie(), bucket
                node = trie.terminal(text)
                if node[2] is None:
                    node[2] = (mask, [])
                node[2][1].append((lang, good, toxic, *found))
        counted(trie, counts)
        yield pa.RecordBatch.from_pylist([dict(part=k[0], mask=k[1], good=k[2], toxic=k[3], n=n) for k, n in counts.items()], pa.schema([
            ("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())]))

    return (united.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "part string, mask int, good boolean, toxic boolean, n long")
            .groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")))


def filter_masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail, as bits 1 (A) to 16 (E)."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic")
    few = labels.count() <= BROADCAST_LABELS
    rows = docs.join(F.broadcast(one) if few else one, "doc_id", "left").select(
        "doc_id", "text", "lang", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return _masks(_united(rows, *cuts(docs)))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of earlier filters, bit of this one) of all orders."""
    bit = {letter: 1 << k for k, letter in enumerate(LETTERS)}
    return [("".join(order), k + 1, sum(bit[x] for x in order[:k]), bit[letter])
            for order in itertools.permutations(LETTERS) for k, letter in enumerate(order)]


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step with what the step's filter removes, in that order and over all orders."""
    masks = filter_masks(documents, labels)
    steps = F.expr("array(" + ", ".join(f"struct('{o}' AS filter_order, {s} AS step, {b} AS before, {f} AS bit)"
                                        for o, s, b, f in _steps()) + ")")
    # A part has at most 128 rows of masks and labels, and each of them takes part in all 600 steps.
    rows = masks.withColumn("s", F.explode(steps)).select("part", "mask", "good", "toxic", "n", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(test):
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~earlier & F.col("good")).alias("good_lost"),
        total(fails & ~earlier & F.col("toxic")).alias("toxic_lost"))
    shares = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "bit"]).drop("bit").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
