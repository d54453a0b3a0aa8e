"""Streamed intake of links and manual pages: lead ids that stay the same when a batch is repeated."""

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.operators import leads
from leadloom.session import release, stored, stored_so_far
from leadloom.sources import tables
from leadloom.streaming.jobs import _start

_lock = threading.Lock()


class LeadIds:
    """A log of the id ranges that batches have taken; one driver at a time hands them out.

    An entry is the name of an empty folder, so it is there whole or not at all and nothing is read but a listing.
    """

    def __init__(self, spark: SparkSession, path: str, after: int = 0):
        self.spark, self.path, self.after = spark, path.rstrip("/"), after

    def ranges(self) -> dict[str, tuple[int, int]]:
        """(first id, number of ids) by batch."""
        found = {}
        for name in tables._folders(self.spark, self.path, "first="):
            first, count, batch = name.split(",", 2)
            found[batch.removeprefix("batch=")] = (int(first[6:]), int(count[6:]))
        return found

    def take(self, batch: str, count: int) -> int:
        """The first id of the batch's range: the old one if the batch is repeated, else the one after all others."""
        with _lock:
            taken = self.ranges()
            if batch in taken:
                if taken[batch][1] != count:
                    raise ValueError(f"batch {batch} had {taken[batch][1]} leads and now has {count}")
                return taken[batch][0]
            first = max((f + n for f, n in taken.values()), default=self.after + 1)
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/first={first},count={count},batch={batch}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(place)
            return first


def _numbered(rows: DataFrame, ids: LeadIds, batch: str, new: str = "true") -> DataFrame:
    """``rows`` whose new leads are numbered from 1, with the ids of their batch."""
    first = ids.take(batch, rows.where(new).count())
    return rows.withColumn("lead_id", F.when(F.expr(new), F.col("lead_id") + (first - 1)).otherwise(F.col("lead_id")))


def _writer(out: str, name: str, ids: LeadIds, work: Callable[[DataFrame, str], DataFrame]):
    def write(batch: DataFrame, batch_id: int) -> None:
        mark = stored_so_far()
        try:
            work(batch, f"{name}-{batch_id}").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            release(batch.sparkSession, mark)
    return write


def link_stream(link_lists: DataFrame, out: str, ids: LeadIds, checkpoint: str, name: str = "links", live: bool = False) -> StreamingQuery:
    """Queue streamed link lists (request_id, links) as PENDING leads; a batch's ids follow the order of its requests."""
    def work(batch: DataFrame, label: str) -> DataFrame:
        return _numbered(stored(leads.intake(batch, F.lit(0)), "intake"), ids, label)

    return _start(link_lists, "append", _writer(out, name, ids, work), checkpoint, live)


def manual_stream(submitted: DataFrame, current: Callable[[], DataFrame], out: str, ids: LeadIds, checkpoint: str,
                  name: str = "manual", live: bool = False) -> StreamingQuery:
    """Take streamed manual pages (seq, url, html) against the leads that ``current`` gives when a batch runs.

    Leads that earlier batches of ``out`` added count as known; a repeated batch doesn't see its own.
    """
    def work(batch: DataFrame, label: str) -> DataFrame:
        number = int(label.rsplit("-", 1)[1])
        known = current().select("lead_id", "website", "company_name", "location", "source_url")
        if earlier := [n for n in tables._folders(batch.sparkSession, out, "batch_id=") if int(n[9:]) < number]:
            added = batch.sparkSession.read.parquet(*[f"{out}/{n}" for n in earlier]).where("action = 'insert'")
            known = known.unionByName(added.select(known.columns))
        rows = stored(leads.manual_upsert(batch, known, F.lit(0)), "manual")
        return _numbered(rows, ids, label, "action = 'insert'")

    return _start(submitted, "append", _writer(out, name, ids, work), checkpoint, live)
