"""Streaming jobs: leads are finished as they arrive, lead state is kept current."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.functions import vocab
from leadloom.plans import enrichment
from leadloom.session import delete, release, stored, stored_so_far
from leadloom.sources import tables
from leadloom.sources.page_store import PageStore

LIVE_TRIGGER = "10 seconds"


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, oldest first."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files).parquet(folder))


def _start(stream: DataFrame, mode: str, write, checkpoint: str, live: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=LIVE_TRIGGER) if live else writer.trigger(availableNow=True)).start()


def _batch_writer(out: str, work=lambda df: df):
    """Writes each micro-batch to a folder of its own, so a repeated batch replaces itself.

    Tables stored on the way to a batch's results go once these are written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        mark = stored_so_far()
        try:
            work(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            release(batch.sparkSession, mark)
    return write


def parse_stream(arriving: DataFrame, store: PageStore, checkpoint: str, name: str = "stream", live: bool = False,
                 sources: bool = True, captures: bool = True, arrived: Column | None = None) -> StreamingQuery:
    """Parse pages once, as their files arrive, into a page store; each batch is a load of its own.

    ``arriving`` are captures (page_id, url, html, channel and what the crawl checks need).  As source pages only those
    fetched over HTTP count.  Batch jobs may append to the same store meanwhile.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        mark = stored_so_far()
        try:
            store.append(f"{name}-{batch_id}", enrichment.parsed_captures(batch) if captures else None,
                         enrichment.parsed_sources(batch.where("channel = 'http'")) if sources else None, arrived)
        finally:
            release(batch.sparkSession, mark)

    return _start(arriving, "append", write, checkpoint, live)


def enrichment_stream(leads: DataFrame, store: PageStore, out: str, checkpoint: str,
                      live: bool = False, use_browser: bool = True, rejects: str | None = None) -> StreamingQuery:
    """Finish streamed leads at once, against the pages that the store holds when their batch runs; results go to ``out`` per batch.

    A lead whose pages cannot be read ends as FAILED and is listed in ``rejects``; it never stops the stream.
    ``waiting`` has the service in which leads wait for their pages.
    """
    finish = _batch_writer(out, lambda batch: enrichment.enrich(batch, store.links(), store, use_browser))

    def write(batch: DataFrame, batch_id: int) -> None:
        finish(batch, batch_id)
        if rejects:
            done = batch.sparkSession.read.parquet(f"{out}/batch_id={batch_id}")
            enrichment.rejects(done).write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")

    return _start(leads, "append", write, checkpoint, live)


# Contacts, page text and analysis documents are large; the state only keeps which event holds the last of them.
PAYLOAD = ["emails", "phones", "body_text", "analysis_json"]


def slim_state(events: DataFrame) -> DataFrame:
    """Current scalars per lead, and the numbers of the events with its last scrape and analysis."""
    c = F.col
    last = lambda value, cond: F.max_by(value, F.when(cond, c("seq")))
    kind = lambda k: c("kind") == k
    return events.groupBy("lead_id").agg(
        F.coalesce(last("status", kind("status")), F.lit("PENDING")).alias("status"),
        last("website", kind("status") & c("website").isNotNull()).alias("website"),
        last("company_name", kind("status") & c("company_name").isNotNull()).alias("company_name"),
        F.max(F.when(kind("scraped"), c("seq"))).alias("scraped_seq"),
        F.max(F.when(kind("analysis"), c("seq"))).alias("analysis_seq"),
        last("score", kind("analysis")).alias("opportunity_score"),
        F.min("ts").alias("created_at"), F.max_by("ts", "seq").alias("updated_at"), F.max("seq").alias("last_seq"))


STATE_SCHEMA = ("lead_id long, status string, website string, company_name string, scraped_seq long, analysis_seq long, "
                "opportunity_score int, created_at timestamp, updated_at timestamp, last_seq long, batch_id int, part int")
PAYLOAD_SCHEMA = "lead_id long, seq long, emails string, phones string, body_text string, analysis_json string, part int"
#: Up to so many leads are looked up by their ids, which reach the files; more by their parts and a join.
LOOKED_UP = 1000
#: Up to so many event numbers (24 bytes each) are sent to the payloads; with more, payloads are shuffled.
BROADCAST_POINTERS = 2_000_000


def state_stream(events: DataFrame, out: str, checkpoint: str, live: bool = False, snapshot: str | None = None) -> StreamingQuery:
    """Keep the current row of every lead, and the dashboard's numbers.

    The fold lives in the state store; each batch writes only the leads it changed, by part, and how it changed the numbers:
    the old rows of these leads taken out, the new ones put in.  There is no event time, hence
    no watermark: state is one small row per lead, for what is large stays with ``payload_stream``.  ``snapshot`` is where
    ``compact_state`` folds the changes, if it runs beside the stream.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("part", tables.part(F.col("lead_id"))).repartition("part").sortWithinPartitions("part", "lead_id")
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{out}/batch_id={batch_id}")
        # A repeated batch finds its numbers written: it counts no second time.
        if not _done(spark, f"{out}-numbers/changes/of={batch_id}"):
            new = spark.read.schema(STATE_SCHEMA).parquet(f"{out}/batch_id={batch_id}")
            old = slim_current(spark, out, snapshot, new, before=batch_id)
            both = new.select("status", "opportunity_score", F.lit(1).alias("sign")).union(old.select("status", "opportunity_score", F.lit(-1)))
            _numbers(both).coalesce(1).write.mode("overwrite").parquet(f"{out}-numbers/changes/of={batch_id}")

    return _start(slim_state(events), "update", write, checkpoint, live)


def payload_stream(events: DataFrame, out: str, checkpoint: str, live: bool = False) -> StreamingQuery:
    """The contacts, texts and documents of events, by part, lead and event number."""
    held = events.where("kind in ('scraped', 'analysis')").select("lead_id", "seq", *PAYLOAD, tables.part(F.col("lead_id")).alias("part"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.repartition("part").sortWithinPartitions("part", "lead_id").write.mode("overwrite").partitionBy("part").parquet(f"{out}/batch_id={batch_id}")

    return _start(held, "append", write, checkpoint, live)


def _done(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _changes(spark: SparkSession, out: str, after: int = -1, parts: list[int] | None = None) -> DataFrame:
    """State rows that batches after ``after`` wrote; none before the first batch."""
    if not tables._folders(spark, out, "batch_id="):
        return spark.createDataFrame([], STATE_SCHEMA)
    rows = spark.read.schema(STATE_SCHEMA).parquet(out).where(F.col("batch_id") > after)
    return rows if parts is None else rows.where(F.col("part").isin(parts))


def _seen(spark: SparkSession, snapshot: str | None) -> int:
    """The last batch that the snapshot holds."""
    if snapshot is None or not _done(spark, f"{snapshot}/seen"):
        return -1
    return spark.read.parquet(f"{snapshot}/seen").first()[0]


def compact_state(spark: SparkSession, out: str, snapshot: str) -> None:
    """Fold the changes since the last snapshot into it, so that reading never goes through all history.

    Only the parts that have changed are written.  The folders of batches that the snapshot before this one holds already
    are deleted, for state and numbers alike.
    """
    seen = _seen(spark, snapshot)
    # A batch is folded once its numbers are written, for these need the state before it.
    numbered = [int(n[3:]) for n in tables._folders(spark, f"{out}-numbers/changes", "of=") if _done(spark, f"{out}-numbers/changes/{n}")]
    changed = _changes(spark, out, seen).where(F.col("batch_id") <= max(numbered, default=-1))
    found = [r.part for r in changed.select("part").distinct().collect()]  # at most as many numbers as parts
    if found:
        upto = changed.agg(F.max("batch_id")).first()[0]
        old = tables.read_parts(spark, snapshot, STATE_SCHEMA, found)
        tables.write_parts(tables.merged_snapshot(old, changed, order="batch_id"), snapshot, bloom=("website",))
        _fold_numbers(spark, out, seen, upto)
        spark.range(1).select(F.lit(upto).cast("int").alias("seen")).write.mode("overwrite").parquet(f"{snapshot}/seen")
    for name in tables._folders(spark, out, "batch_id="):
        if int(name[9:]) <= seen:
            delete(spark, f"{out}/{name}")


def _ids(leads: DataFrame | None) -> tuple[list | None, list | None]:
    """(ids, parts) of the leads asked for; ids where they are few, None where everything is asked for."""
    if leads is None:
        return None, None
    part = tables.part(F.col("lead_id"))
    few = leads.select("lead_id", part.alias("part")).limit(LOOKED_UP + 1).collect()
    if len(few) <= LOOKED_UP:
        return [r.lead_id for r in few], sorted({r.part for r in few})
    return None, [r[0] for r in leads.select(part).distinct().collect()]  # at most as many numbers as parts


def _of(rows: DataFrame, leads: DataFrame | None, ids: list | None, parts: list | None) -> DataFrame:
    """The rows of the leads asked for, read from their parts alone."""
    if leads is None:
        return rows
    rows = rows.where(F.col("part").isin(parts))
    return rows.where(F.col("lead_id").isin(ids)) if ids is not None else rows.join(leads.select("lead_id").distinct(), "lead_id", "left_semi")


def slim_current(spark: SparkSession, out: str, snapshot: str | None = None, leads: DataFrame | None = None, before: int | None = None) -> DataFrame:
    """The last state row per lead (of ``leads``, if given): the snapshot and the changes after it.

    With ``before`` it is the state before that batch, which no snapshot holds yet.
    """
    ids, parts = _ids(leads)
    new = _of(_changes(spark, out, _seen(spark, snapshot), parts), leads, ids, parts)
    if before is not None:
        new = new.where(F.col("batch_id") < before)
    old = spark.createDataFrame([], STATE_SCHEMA) if snapshot is None else _of(tables.read_parts(spark, snapshot, STATE_SCHEMA, parts), leads, ids, parts)
    return tables.merged_snapshot(old, new, order="batch_id").drop("batch_id")


def current_state(spark: SparkSession, out: str, payloads: str, snapshot: str | None = None, leads: DataFrame | None = None) -> DataFrame:
    """Lead rows as ``leads.fold_state`` gives them, with contacts, text and document; all leads or those of ``leads``.

    The state's event numbers come first; only the payloads they name are read out of their parts and moved.
    """
    slim = stored(slim_current(spark, out, snapshot, leads), "slim-state")
    if not tables._folders(spark, payloads, "batch_id="):
        held = spark.createDataFrame([], PAYLOAD_SCHEMA)
    else:
        ids, parts = _ids(leads)
        held = _of(spark.read.schema(PAYLOAD_SCHEMA).parquet(payloads), leads, ids, parts)
    named = slim.select("part", "lead_id", F.explode(F.array_compact(F.array("scraped_seq", "analysis_seq"))).alias("seq")).distinct()
    named = F.broadcast(named) if named.count() <= BROADCAST_POINTERS else named
    held = stored(held.join(named, ["part", "lead_id", "seq"], "left_semi").dropDuplicates(["lead_id", "seq"]).drop("part", "batch_id"), "named-payloads")
    scraped = held.select("lead_id", F.col("seq").alias("scraped_seq"), "emails", "phones", "body_text")
    analysis = held.select("lead_id", F.col("seq").alias("analysis_seq"), "analysis_json")
    return (slim.drop("part").join(scraped, ["lead_id", "scraped_seq"], "left")
            .join(analysis, ["lead_id", "analysis_seq"], "left").drop("scraped_seq", "analysis_seq"))


def lead_by_id(spark: SparkSession, out: str, payloads: str, snapshot: str, lead_id: int) -> DataFrame:
    """One lead as it stands: one part of the snapshot, the changes since, and its own payloads."""
    return current_state(spark, out, payloads, snapshot, spark.range(lead_id, lead_id + 1).withColumnRenamed("id", "lead_id"))


def next_pending(spark: SparkSession, out: str, payloads: str, snapshot: str) -> DataFrame:
    """The PENDING lead with the lowest id, found by status and id alone."""
    lowest = slim_current(spark, out, snapshot).where("status = 'PENDING'").agg(F.min("lead_id").alias("lead_id")).where("lead_id is not null")
    return current_state(spark, out, payloads, snapshot, stored(lowest, "lowest"))


def latest_of_website(spark: SparkSession, out: str, snapshot: str, website: str) -> DataFrame:
    """The state row with the highest id of one website; the address reaches the snapshot's Bloom filters."""
    seen = _seen(spark, snapshot)
    named = tables.read_parts(spark, snapshot, STATE_SCHEMA).where(F.col("website") == website).select("lead_id")
    leads = named.union(_changes(spark, out, seen).where(F.col("website") == website).select("lead_id")).distinct()
    return (slim_current(spark, out, snapshot, stored(leads, "candidates")).where(F.col("website") == website)
            .orderBy(F.desc("lead_id")).limit(1))


NUMBERS = ("total", "pending", "processing", "completed", "failed", "high_opportunity", "score_sum", "scored")


def _numbers(rows: DataFrame) -> DataFrame:
    """One row of ``NUMBERS``: those of rows with sign 1, less those of rows with sign -1."""
    c = F.col
    count = lambda test: F.coalesce(F.sum(F.when(test, c("sign")).otherwise(0)), F.lit(0)).cast("long")
    states = [count(c("status") == s.upper()).alias(s) for s in NUMBERS[1:5]]
    return rows.agg(count(F.lit(True)).alias("total"), *states, count(c("opportunity_score") >= vocab.BAND_HIGH).alias("high_opportunity"),
                    F.coalesce(F.sum(c("opportunity_score") * c("sign")), F.lit(0)).cast("long").alias("score_sum"),
                    count(c("opportunity_score").isNotNull()).alias("scored"))


_NUMBERS_SCHEMA = ", ".join(f"{n} long" for n in NUMBERS)


def _number_rows(spark: SparkSession, out: str) -> tuple[DataFrame, int]:
    """Rows of changes to the numbers that add up to them, and the last batch that the folded one holds."""
    folded = [n for n in tables._folders(spark, f"{out}-numbers/folded", "upto=") if _done(spark, f"{out}-numbers/folded/{n}")]
    upto = max((int(n[5:]) for n in folded), default=-1)
    names = [f"{out}-numbers/changes/{n}" for n in tables._folders(spark, f"{out}-numbers/changes", "of=") if int(n[3:]) > upto
             and _done(spark, f"{out}-numbers/changes/{n}")]
    names += [f"{out}-numbers/folded/upto={upto}"] if folded else []
    return (spark.read.schema(_NUMBERS_SCHEMA).parquet(*names) if names else spark.createDataFrame([], _NUMBERS_SCHEMA)), upto


def _fold_numbers(spark: SparkSession, out: str, before: int, upto: int) -> None:
    """Unite the changes of batches up to ``upto``; those that the fold before held go."""
    rows, had = _number_rows(spark, out)
    if upto <= had:
        return
    names = [f"{out}-numbers/changes/of={k}" for k in range(had + 1, upto + 1) if _done(spark, f"{out}-numbers/changes/of={k}")]
    names += [f"{out}-numbers/folded/upto={had}"] if had >= 0 else []
    spark.read.schema(_NUMBERS_SCHEMA).parquet(*names).agg(*[F.sum(n).alias(n) for n in NUMBERS]).write.mode("overwrite").parquet(
        f"{out}-numbers/folded/upto={upto}")
    for name in tables._folders(spark, f"{out}-numbers/folded", "upto="):
        if int(name[5:]) < had:
            delete(spark, f"{out}-numbers/folded/{name}")
    for name in tables._folders(spark, f"{out}-numbers/changes", "of="):
        if int(name[3:]) <= before:
            delete(spark, f"{out}-numbers/changes/{name}")


def live_stats(spark: SparkSession, out: str) -> DataFrame:
    """Dashboard numbers, from one row per batch since the last fold; zeros before the first batch."""
    total = _number_rows(spark, out)[0].agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in NUMBERS])
    mean = F.when(F.col("scored") > 0, F.col("score_sum").cast("double") / F.col("scored"))
    return total.select(*NUMBERS[:6], F.bround(mean, 1).alias("average_score"))
