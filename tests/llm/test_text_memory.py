"""What the text operators hold in a Python worker besides the batch itself."""

import tracemalloc

import numpy as np
import pyarrow as pa

from leadloom.llm import quality_rules
from leadloom.llm.words import chunks, text_bytes


def test_texts_of_a_batch_are_read_where_they_are():
    column = pa.array(["one two", None, "", "drei vier fünf", "six"])
    for part in (column, column.cast(pa.large_string()), column.slice(1, 3), column.slice(3), column.slice(0, 0),
                 pa.array([], pa.string()), pa.array([None, None], pa.string())):
        data, offsets = text_bytes(part)
        assert offsets.dtype == np.int64
        assert [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])] == [t or "" for t in part.to_pylist()]
    plain = pa.array(["one two"] * 1000)
    data, _ = text_bytes(plain)
    assert data.ctypes.data == plain.buffers()[2].address


def test_memory_follows_a_chunk_and_not_the_batch():
    text = " ".join(f"word{i % 97} and more" for i in range(130))
    column = pa.array([text] * 1600)
    assert column.nbytes > 3_000_000
    weights = np.zeros(quality_rules.BUCKETS, np.int64)
    quality_rules.features(column, weights, weights)  # tables that stay are made
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    made = quality_rules.features(column, weights, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made["n_words"]) == 1600
    assert pa.total_allocated_bytes() == held
    assert peak < 25_000_000  # 53 MB with chunks of a megabyte


def test_chunks_change_no_result():
    column = pa.array([" ".join(f"w{i * k % 31}" for i in range(k)) for k in range(200)] + ["", None, "word " * 60_000])
    whole = quality_rules.features(column, np.arange(quality_rules.BUCKETS))
    parts = [quality_rules.features(column.slice(first, last - first), np.arange(quality_rules.BUCKETS))
             for first, last, _, _ in chunks(column, 500)]
    for name, values in whole.items():
        assert (values == np.concatenate([p[name] for p in parts])).all()


def test_stages_send_few_rows_at_once(spark, docs):
    from corpus_pipeline import sequences
    from leadloom.llm.tables import BATCH_ROWS

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, wanted in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("200", 200)):
            spark.conf.set(key, given)
            sequences(spark, docs, None)
            assert int(spark.conf.get(key)) == wanted

        def sizes(batches):
            yield from (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)

        spark.conf.set(key, "10000")
        sequences(spark, docs, None)
        assert max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()) == BATCH_ROWS
    finally:
        spark.conf.set(key, before)
