"""Small helpers that several operators share."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import new_path, stored

__all__ = ["read", "stored", "new_path", "texts", "fold", "labelled", "distinct_texts", "per_text", "kept_rows", "small_batches"]

#: Up to so many label rows (16 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Up to so many hashes of repeated texts (16 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_REPEATED = 2_000_000
#: Rows that go to a Python worker at once; the batch is held several times, by the JVM and by the worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hold less memory outside the heap where whole texts go through Python; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text under fixed names, so that other columns can neither clash nor be read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled(docs: DataFrame, labels: DataFrame, column: str, worst: Callable = F.max) -> DataFrame:
    """The documents of ``texts`` that have a label, as (doc_id, text, label); of several labels ``worst`` counts.

    Labels are small rows beside texts, so they are broadcast up to ``BROADCAST_LABELS`` rows.
    """
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
           .groupBy("doc_id").agg(worst(F.col(column).cast("int")).alias("label")))
    few = labels.count() <= BROADCAST_LABELS
    return docs.join(F.broadcast(one) if few else one, "doc_id")


def distinct_texts(docs: DataFrame, label: str | None = None) -> DataFrame:
    """(text, ``label``) of each distinct text of ``texts`` once, by 128 bits of hash; of several labels the largest counts.

    Only rows whose text repeats move, combined in each task before.
    """
    keys = ["high", "low"]
    rows = docs.select("text", *([label] if label else []), F.xxhash64("text").alias("high"),
                       F.xxhash64(F.lit(1), "text").alias("low"))
    again = stored(rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").select(*keys), "repeated")
    again = F.broadcast(again) if again.count() <= BROADCAST_REPEATED else again
    made = [F.first("text").alias("text"), *([F.max(label).alias(label)] if label else [])]
    out = ["text", *([label] if label else [])]
    return (rows.join(again, keys, "left_anti").select(*out)
            .union(rows.join(again, keys, "left_semi").groupBy(*keys).agg(*made).select(*out)))


def per_text(docs: DataFrame, schema: str, work: Callable[[pa.Array], dict]) -> DataFrame:
    """(doc_id, *schema) for each row of ``texts``; ``work`` gets the texts of a batch and returns its columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[n]) for n in names)], ["doc_id", *names])
        pa.default_memory_pool().release_unused()  # workers live on

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def kept_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``keep`` accepts."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(place)), pa.bool_()))
        pa.default_memory_pool().release_unused()  # workers live on

    return docs.mapInArrow(run, docs.schema)
