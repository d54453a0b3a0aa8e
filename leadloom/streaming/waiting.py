"""Leads that wait for their pages: finished once these arrive, given up when the watermark passes their time.

``intake_stream`` finishes what can be finished and writes the other leads, with the addresses they need and the time until
which they wait, to a folder.  ``waiting_stream`` joins that folder with the arrivals of a ``PageStore``, both streams with
watermarks, as a left outer join on the address: each arrival in time has the lead looked at again, and a lead without any comes out
alone once both watermarks have passed its time.  Pages are read from the store inside each batch, so they count as soon as
they are there.  Every batch writes folders of its own and replaces them when it is repeated.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.plans import enrichment
from leadloom.session import release, stored, stored_so_far
from leadloom.sources.page_store import ARRIVALS, PageStore
from leadloom.streaming.jobs import LIVE_TRIGGER

LEAD = "lead_id long, company_name string, location string, source_url string"
WAITING = f"{LEAD}, address string, until timestamp, since timestamp, batch string"


def _folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _put(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


class WaitingLeads:
    """The service over a page store: ``finished`` and ``waiting`` are its folders below ``path``."""

    def __init__(self, store: PageStore, path: str, patience: str = "1 day", use_browser: bool = True):
        self.store, self.path, self.patience, self.use_browser = store, path.rstrip("/"), patience, use_browser
        self.spark = store.spark

    def _settle(self, leads: DataFrame, batch: str) -> None:
        """Finish the leads whose pages are there or whose time is over; the others wait on.

        ``leads`` has a row per lead with ``until``, ``over`` and ``since``, the last arrival that was seen.
        """
        asked = stored(leads, "asked")
        if asked.isEmpty():
            return
        done = enrichment.enrich(asked.select("lead_id", "company_name", "location", "source_url"), self.store.links(), self.store, self.use_browser)
        done = stored(done.join(asked.select("lead_id", "until", "over", "since"), "lead_id").withColumn("unready", enrichment.unready()), "done")
        _put(done.where("over or not unready").withColumn("batch", F.lit(batch)).withColumn("given_up", F.col("unready"))
             .drop("unready", "over", "until", "since"), f"{self.path}/finished/of={batch}")
        # A lead without its source page needs that; any needs its home page, which the source page may name anew.
        needs = F.array_distinct(F.array_compact(F.array(F.when(~F.col("source_known"), F.col("source_url")), F.col("found_website"))))
        names = asked.select("lead_id", F.col("company_name").alias("name"))  # a finished lead's null name is ''
        late = done.where("unready and not over").join(names, "lead_id").select(
            "lead_id", F.col("name").alias("company_name"), "location", "source_url", F.explode(needs).alias("address"), "until", "since", F.lit(batch).alias("batch"))
        _put(late, f"{self.path}/waiting/of={batch}")

    def _each(self, name: str, work):
        def write(batch: DataFrame, batch_id: int) -> None:
            mark = stored_so_far()
            try:
                self._settle(work(batch), f"{name}-{batch_id}")
            finally:
                release(batch.sparkSession, mark)
        return write

    def _start(self, stream: DataFrame, name: str, work, checkpoint: str, live: bool) -> StreamingQuery:
        writer = stream.writeStream.outputMode("append").foreachBatch(self._each(name, work)).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=LIVE_TRIGGER) if live else writer.trigger(availableNow=True)).start()

    def intake_stream(self, leads: DataFrame, checkpoint: str, live: bool = False) -> StreamingQuery:
        """Take streamed leads (``LEAD`` columns and ``asked``, when they came in)."""
        until = F.col("asked") + F.expr(f"interval {self.patience}")
        return self._start(leads, "intake", lambda batch: batch.select("*", until.alias("until"), F.lit(False).alias("over"), F.lit(None).cast("timestamp").alias("since")).drop("asked"), checkpoint, live)

    def tick(self, name: str, at: Column) -> None:
        """Tell both streams how late it is, so that leads are given up while nothing arrives."""
        self.store.tick(f"tick-{name}", at)
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in f"{LEAD}, address string".split(", "))]
        _put(self.spark.range(1).select(*nothing, (at + F.expr(f"interval {self.patience}")).alias("until"),
                                        F.lit(None).cast("timestamp").alias("since"), F.lit("tick").alias("batch")),
             f"{self.path}/waiting/of=tick-{name}")

    def waiting_stream(self, checkpoint: str, live: bool = False, slack: str = "10 minutes") -> StreamingQuery:
        """Look at waiting leads again as their pages arrive; ``slack`` is how late an arrival may be told."""
        read = self.spark.readStream.option("pathGlobFilter", "*.parquet")
        for folder in (f"{self.path}/waiting", f"{self.store.path}/arrivals"):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(place)
        waiting = read.schema(WAITING).parquet(f"{self.path}/waiting").select(
            "lead_id", "company_name", "location", "source_url", "address", "until", "since").withWatermark("until", self.patience)
        arrivals = read.schema(ARRIVALS).parquet(f"{self.store.path}/arrivals").select("url", "arrived").withWatermark("arrived", slack)
        # A lead that was looked at and waits on is woken by later arrivals only.
        joined = waiting.join(arrivals, F.expr(
            f"address = url AND until >= arrived AND until <= arrived + interval {self.patience} + interval {slack} "
            "AND (since IS NULL OR arrived > since)"), "left_outer")

        def work(batch: DataFrame) -> DataFrame:
            # Several addresses and arrivals of a lead are one look; it is over only if no address has seen an arrival.
            return batch.where("lead_id is not null").groupBy("lead_id").agg(
                *[F.first(n).alias(n) for n in ("company_name", "location", "source_url", "until")], (F.count("arrived") == 0).alias("over"),
                F.greatest(F.max("since"), F.max("arrived")).alias("since")).join(self._done().select("lead_id"), "lead_id", "left_anti")

        return self._start(joined, "waiting", work, checkpoint, live)

    def finish_overdue(self, now: Column, batch: str) -> None:
        """Finish every lead whose time was over before ``now`` and that no batch has finished.

        A lead that has seen some but not all of its pages never comes out of the join alone; this job ends its wait.
        """
        waiting = _folder(self.spark, f"{self.path}/waiting", WAITING).where("lead_id is not null").groupBy("lead_id").agg(
            *[F.first(n).alias(n) for n in ("company_name", "location", "source_url")], F.max("until").alias("until"), F.max("since").alias("since")).where(F.col("until") < now)
        self._settle(waiting.join(self._done(), "lead_id", "left_anti").withColumn("over", F.lit(True)), batch)

    def _done(self) -> DataFrame:
        return _folder(self.spark, f"{self.path}/finished", "lead_id long, batch string, given_up boolean")

    def finished(self) -> DataFrame:
        """One row per finished lead, as ``enrichment.enrich`` gives it.

        If a lead was finished several times, one with its pages counts before one without; chosen without moving texts.
        """
        one = self._done().groupBy("lead_id").agg(F.min(F.struct("given_up", "batch")).alias("best")).select("lead_id", "best.batch")
        rows = self.spark.read.parquet(f"{self.path}/finished")
        return rows.join(one, ["lead_id", "batch"], "left_semi").drop("batch", "given_up", "of")

    def waiting(self) -> DataFrame:
        """(lead_id, until) of the leads that still wait."""
        rows = _folder(self.spark, f"{self.path}/waiting", WAITING).where("lead_id is not null")
        return rows.groupBy("lead_id").agg(F.max("until").alias("until")).join(self._done(), "lead_id", "left_anti")
