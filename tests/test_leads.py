"""Intake, state, dashboard, reports and streams."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadloom.operators import dashboard, leads, reports
from leadloom.plans import enrichment
from leadloom.session import new_path
from leadloom.sources import seeding, tables
from leadloom.streaming import intake, jobs

EVENT = ("seq long, lead_id long, ts timestamp, kind string, status string, website string, company_name string, "
         "emails string, phones string, body_text string, score int, analysis_json string")
T0 = datetime(2024, 1, 1)


def event(seq, lead, kind, **fields):
    names = ["status", "website", "company_name", "emails", "phones", "body_text", "score", "analysis_json"]
    return (seq, lead, T0 + timedelta(seconds=seq), kind, *[fields.get(n) for n in names])


def fold(spark, *events):
    return leads.fold_state(spark.createDataFrame(events, EVENT))


def test_intake(spark):
    df = spark.createDataFrame([(2, "http://c\n\n ftp://d \nhttpx"), (1, " https://a \nhttps://a")], "request_id long, links string")
    rows = sorted(map(tuple, leads.intake(df, F.lit(7)).select("lead_id", "source_url", "status").collect()))
    assert rows == [(8, "https://a", "PENDING"), (9, "https://a", "PENDING"), (10, "http://c", "PENDING"), (11, "httpx", "PENDING")]


def test_intake_numbers_across_blocks(spark):
    df = spark.range(500).select(F.col("id").alias("r"), (F.col("id") % 4).cast("int").alias("n"))
    rows = leads.numbered_spans(df, "r", F.col("n"), F.lit(0)).orderBy("r").collect()
    expected, start = [], 1
    for r in rows:
        expected.append(start)
        start += r.n
    assert [r.first_id for r in rows] == expected


def test_fold(spark):
    row = fold(
        spark, event(1, 1, "status", status="PENDING", website="w1", company_name="A"),
        event(2, 1, "scraped", emails="e", body_text="b"), event(3, 1, "status", status="ENRICHED", company_name=""),
        event(4, 1, "analysis", score=5, analysis_json="{}"), event(6, 1, "analysis"), event(5, 1, "scraped", phones="p")).first()
    assert (row.status, row.website, row.company_name) == ("ENRICHED", "w1", "")
    assert (row.emails, row.phones, row.body_text, row.opportunity_score) == (None, "p", None, None)
    assert row.updated_at == T0 + timedelta(seconds=6)


def test_stats_and_recent(spark):
    state = fold(
        spark, event(1, 1, "status", status="COMPLETED"), event(2, 2, "status", status="PENDING"),
        event(3, 1, "analysis", score=90, analysis_json='{"opportunities":[{"type":"x","score":90}]}'),
        event(4, 2, "analysis", score=40, analysis_json='{"opportunities":[]}'))
    s = dashboard.stats(state).first()
    assert (s.total, s.completed, s.pending, s.high_opportunity, s.average_score) == (2, 1, 1, 1, 65.0)
    assert [r.lead_id for r in dashboard.recent(state).collect()] == [2, 1]
    assert len(dashboard.recent(state, -5).collect()) == 1
    decoded = {r.lead_id: r.analysis for r in dashboard.decode_analysis(state).collect()}
    assert decoded[1].opportunities[0].score == 90 and decoded[2].opportunities == []


def test_average_rounds_half_to_even(spark):
    df = spark.createDataFrame([(s, "x") for s in (65, 65, 65, 66)], "opportunity_score int, status string")
    assert dashboard.stats(df).first().average_score == 65.2
    assert dashboard.stats(df.withColumn("opportunity_score", F.lit(None).cast("int"))).first().average_score is None


def test_broken_analysis_is_null(spark):
    df = spark.createDataFrame([(1, "{x"), (2, ""), (3, None), (4, '{"business_name":"B"}')], "lead_id long, analysis_json string")
    got = {r.lead_id: r.analysis and r.analysis.business_name for r in dashboard.decode_analysis(df).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "B"}


def test_views_read_the_document_by_path(spark):
    """One parse per document and no decode of fields that a view doesn't show; a field of another type is null by itself."""
    text = '{"business_name":"B","opportunity_score":"x","opportunities":[{"type":"t","score":90,"evidence":[{"code":"c","arg":"a"}]}],"signal_evidence":{"email":[{"code":"k"}]}}'
    df = spark.createDataFrame([(1, text, 90), (2, "[1]", 0), (3, '{"opportunities":3}', None)], "lead_id long, analysis_json string, opportunity_score int")
    full = df.selectExpr("*", "'' company_name", "'w' website", "'s' source_url", "'S' status", "'' emails", "'' phones")
    decoded = dashboard.decode_analysis(full)
    got = {r.lead_id: r.analysis for r in decoded.collect()}
    assert got[1].opportunity_score is None and got[1].opportunities[0].evidence[0].arg == "a" and got[1].signal_evidence["email"][0].code == "k"
    assert got[2].business_name is None and got[3].opportunities is None
    view = dashboard.rows(dashboard.documents(full))
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and plan.count("parseJson") == 1 and "page_details" not in plan and "signal_evidence" not in plan
    assert [len(r.top_opportunities) for r in view.orderBy("lead_id").collect()] == [1, 0, 0]
    assert [r.pos for r in dashboard.detail(dashboard.documents(full)).orderBy("lead_id").collect()] == [0, None, None]


def test_report(spark):
    df = spark.createDataFrame(
        [(1, "", "s", None, ["a", "", "b"], [], "S", "x" * 501, 0), (2, "C", None, "w", [], ["1"], None, "t", None)],
        "lead_id long, company_name string, source_url string, website string, emails array<string>, phones array<string>, "
        "status string, text string, opportunity_score int")
    report = reports.report_rows(df)
    rows = {r.lead_id: r for r in report.collect()}
    assert tuple(rows[1]) == (1, "Unknown", "s", "", "a, b", "", "S", "x" * 500 + "...", "0")
    assert tuple(rows[2]) == (2, "C", "", "w", "", "1", "", "t", "")
    changed = {r.lead_id: r for r in reports.updated_report(report, df.where("lead_id = 2").withColumn("status", F.lit("N"))).collect()}
    assert (changed[2].status, changed[2].text, changed[1].text[:1]) == ("N", "", "x")
    path = new_path(spark, "report")
    reports.write_report(report, path)
    assert spark.read.option("header", True).csv(path).count() == 2


def test_manual_upsert(spark):
    known = spark.createDataFrame([(1, "https://k", "K", "", "s1"), (2, "https://k", None, "", "s2")],
                                  "lead_id long, website string, company_name string, location string, source_url string")
    sent = spark.createDataFrame(
        [(1, " https://n ", "one a@b.dev"), (2, "https://k", "plain"), (3, "", "x"), (4, "https://z", " "), (5, "https://n", "two"),
         (6, "https://m", "310-555-1212")], "seq long, url string, html string")
    rows = {r.website: r for r in leads.manual_upsert(sent, known, F.lit(2)).collect()}
    assert (rows["https://k"].lead_id, rows["https://k"].action, rows["https://k"].status) == (2, "update", "MISSING_DATA")
    assert (rows["https://n"].lead_id, rows["https://n"].body_text, rows["https://n"].status) == (3, "two", "MISSING_DATA")
    assert (rows["https://m"].lead_id, rows["https://m"].status, rows["https://m"].source_url) == (4, "COMPLETED", "Manual HTML")
    assert {r.seq: r.error for r in leads.manual_rejects(sent).collect()} == {3: "url_required", 4: "html_required"}


def test_failed_without_browser(spark):
    new = spark.createDataFrame([(1, None, "", "https://a.org/"), (2, "B", "", "none")],
                                "lead_id long, company_name string, location string, source_url string")
    empty = spark.createDataFrame([], "page_id long, url string, html string, channel string")
    rows = {r.lead_id: r for r in enrichment.enrich(new, enrichment.parsed_sources(empty.drop("channel")), enrichment.parsed_captures(empty), use_browser=False).collect()}
    assert (rows[1].status, rows[1].website, rows[1].opportunity_score) == ("FAILED", "ERROR", None)
    assert (rows[2].status, rows[2].website, rows[2].method, rows[2].business_name) == ("MISSING_DATA", "NOT_FOUND", "none", "Not Found")


def test_snapshot_gains_columns(spark):
    """Read, merge, write the next version, swap, and drop old versions."""
    path = new_path(spark, "snapshot")
    empty = "lead_id long, status string, last_seq long"
    assert tables.read_snapshot(spark, path, empty).count() == 0
    changes = [spark.createDataFrame([(1, "a", 1), (2, "a", 1)], empty),
               spark.createDataFrame([(2, "b", 2, 5)], empty + ", score int"), spark.createDataFrame([(3, "c", 3)], empty)]
    for changed in changes:
        tables.write_snapshot(tables.merged_snapshot(tables.read_snapshot(spark, path, empty), changed), path)
    rows = {r.lead_id: (r.status, r.score) for r in tables.read_snapshot(spark, path).collect()}
    assert rows == {1: ("a", None), 2: ("b", 5), 3: ("c", None)}
    assert tables._versions(spark, path) == [1, 2]


def test_state_stream_equals_batch_over_many_files(spark, folder):
    source = new_path(spark, "event-files")
    tables.table(spark, folder, "events").repartition(4).write.parquet(source)  # late events too
    schema = spark.read.parquet(source).schema
    stream = seeding.as_lead_events(jobs.file_stream(spark, source, schema))
    out, checkpoint, payloads, snapshot = (new_path(spark, n) for n in ("state", "check", "payloads", "snapshot"))
    # Before the first batch the numbers are zero.
    assert jobs.live_stats(spark, out).first().total == 0
    jobs.state_stream(stream, out, checkpoint).awaitTermination()
    jobs.payload_stream(stream, payloads, new_path(spark, "check")).awaitTermination()
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 4
    assert not set(jobs.PAYLOAD) & set(spark.read.parquet(out).columns)
    batch = leads.fold_state(seeding.lead_events(spark, folder))
    for use in (None, snapshot):
        if use:
            jobs.compact_state(spark, out, snapshot)
            jobs.compact_state(spark, out, snapshot)
        streamed = jobs.current_state(spark, out, payloads, use).select(*batch.columns)
        assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
        assert jobs.live_stats(spark, out).first() == dashboard.stats(batch).first()
    # Started again with nothing new, it changes nothing.
    jobs.state_stream(stream, out, checkpoint).awaitTermination()
    assert jobs.slim_current(spark, out, snapshot).count() == batch.count()


def test_numbers_after_every_batch(spark, folder):
    """Each batch takes its leads' old rows out of the numbers and puts the new ones in; repeated, it changes nothing."""
    source = tables.table(spark, folder, "events")
    arriving, out, snapshot, check = (new_path(spark, n) for n in ("events", "state", "snapshot", "check"))
    sofar, reads = None, []
    for k in range(4):
        some = source.where(F.col("event_id") % 4 == k)
        some.coalesce(1).write.mode("append").parquet(arriving)
        stream = seeding.as_lead_events(jobs.file_stream(spark, arriving, source.schema))
        jobs.state_stream(stream, out, check, snapshot=snapshot).awaitTermination()
        sofar = some if sofar is None else sofar.union(some)
        want = dashboard.stats(leads.fold_state(seeding.as_lead_events(sofar))).first()
        assert jobs.live_stats(spark, out).first() == want
        if k % 2:
            jobs.compact_state(spark, out, snapshot)
            assert jobs.live_stats(spark, out).first() == want
        reads.append(jobs._number_rows(spark, out)[0].count())
    assert reads == [1, 1, 2, 1]
    # A batch that is written again, after its rows are seen and folded.
    rows = spark.read.schema(jobs.STATE_SCHEMA).parquet(f"{out}/batch_id=3").drop("part", "batch_id")
    writes = []
    start, jobs._start = jobs._start, lambda stream, mode, write, *rest: writes.append(write)
    try:
        jobs.state_stream(stream, out, check, snapshot=snapshot)
    finally:
        jobs._start = start
    writes[0](rows, 3)
    assert jobs.live_stats(spark, out).first() == want
    batch = leads.fold_state(seeding.as_lead_events(source))
    assert sorted(jobs.slim_current(spark, out, snapshot).select("lead_id", "status", "last_seq").collect()) == sorted(
        batch.select("lead_id", "status", "last_seq").collect())


def test_one_lead_reads_one_part(spark, folder):
    """A look-up reads the lead's part of snapshot and payloads; compaction writes the touched parts alone."""
    arriving, out, payloads, snapshot = (new_path(spark, n) for n in ("events", "state", "payloads", "snapshot"))
    events = tables.table(spark, folder, "events")
    events.coalesce(1).write.parquet(arriving)
    stream = seeding.as_lead_events(jobs.file_stream(spark, arriving, events.schema))
    check, pcheck = new_path(spark, "check"), new_path(spark, "check")
    for _ in range(2):
        jobs.state_stream(stream, out, check, snapshot=snapshot).awaitTermination()
        jobs.payload_stream(stream, payloads, pcheck).awaitTermination()
        jobs.compact_state(spark, out, snapshot)
    batch = leads.fold_state(seeding.lead_events(spark, folder))
    some = batch.where("website is not null").orderBy("lead_id").first()
    assert jobs.lead_by_id(spark, out, payloads, snapshot, some.lead_id).select(*batch.columns).collect() == [some]
    part = spark.range(some.lead_id, some.lead_id + 1).select(tables.part(F.col("id"))).first()[0]
    one = tables.read_parts(spark, snapshot, jobs.STATE_SCHEMA, [part])
    assert len(one.inputFiles()) == 1 and one.count() < batch.count() / 4
    asked = spark.createDataFrame([(some.lead_id,)], "lead_id long")
    held = jobs._of(spark.read.schema(jobs.PAYLOAD_SCHEMA).parquet(payloads), asked, *jobs._ids(asked))
    plan = held._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().head().metrics().apply("numFiles").value() == 1
    assert "In(lead_id" in plan.toString() or "EqualTo(lead_id" in plan.toString()
    assert jobs.next_pending(spark, out, payloads, snapshot).select("lead_id").collect() == leads.next_pending(batch).select("lead_id").collect()
    latest = leads.latest_by_website(batch).where(F.col("website") == some.website).first()
    assert [r.lead_id for r in jobs.latest_of_website(spark, out, snapshot, some.website).collect()] == [latest.lead_id]
    # Many leads take the join instead of literal ids.
    jobs.LOOKED_UP, before = 3, jobs.LOOKED_UP
    try:
        few = batch.where("lead_id % 5 = 0")
        got = jobs.current_state(spark, out, payloads, snapshot, few).select(*batch.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, few.collect()))
    finally:
        jobs.LOOKED_UP = before
    # New events of one lead: one part is written again.
    first = events.orderBy("event_id").limit(1).withColumn("event_id", F.col("event_id") + 10**9)
    first.write.mode("append").parquet(arriving)
    jobs.state_stream(stream, out, check, snapshot=snapshot).awaitTermination()
    jobs.compact_state(spark, out, snapshot)
    versions = tables._versions(spark, snapshot)
    assert len(tables._folders(spark, f"{snapshot}/v={versions[-1]}", "part=")) == 1
    assert jobs.slim_current(spark, out, snapshot).count() == batch.count()


def test_report_in_place(spark):
    """Ten changed leads: only their id ranges are written again, and new leads come into ranges of their own."""
    df = spark.range(1, 1001).select(F.col("id").alias("lead_id"), F.lit("C").alias("company_name"), F.lit("s").alias("source_url"), F.lit("w").alias("website"),
                                     F.array(F.lit("a")).alias("emails"), F.array(F.lit("1")).alias("phones"), F.lit("S").alias("status"),
                                     F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit(5).alias("opportunity_score"))
    report, path = reports.report_rows(df), new_path(spark, "report")
    reports.write_report_table(report, path, span=100)
    files = set(spark.read.parquet(path).inputFiles())
    assert len(files) == 11
    changes = df.where("lead_id between 201 and 210").withColumn("status", F.lit("N")).union(
        df.limit(1).withColumn("lead_id", F.lit(5000).cast("long")))
    want = sorted(map(tuple, reports.updated_report(report, changes).collect()))
    reports.update_report_table(path, changes, span=100)
    after = set(spark.read.parquet(path).inputFiles())
    assert len(files & after) == 10 and len(after) == 12
    assert sorted(map(tuple, reports.read_report_table(spark, path).collect())) == want
    reports.update_report_table(path, changes, span=100)
    assert sorted(map(tuple, reports.read_report_table(spark, path).collect())) == want


def test_streamed_ids(spark, monkeypatch):
    """A repeated batch gets its old ids, batches never overlap, and two streams share one log."""
    ids = intake.LeadIds(spark, new_path(spark, "ids"), after=10)
    writers = []
    monkeypatch.setattr(intake, "_start", lambda stream, mode, write, *rest: writers.append(write))
    queued, manual = new_path(spark, "queued"), new_path(spark, "manual")
    known = spark.createDataFrame([(3, "https://k", "K", "", "s")], "lead_id long, website string, company_name string, location string, source_url string")
    intake.link_stream(None, queued, ids, "")
    intake.manual_stream(None, lambda: known, manual, ids, "")
    links, pages = writers
    batches = [spark.createDataFrame([(r, "http://a\nhttp://b")], "request_id long, links string") for r in (2, 1)]
    sent = [spark.createDataFrame(rows, "seq long, url string, html string") for rows in (
        [(1, "https://n", "x"), (2, "https://k", "y"), (3, "https://m", "z")], [(4, "https://n", "more"), (5, "https://o", "x")])]

    def seen():
        rows = spark.read.parquet(queued).select("lead_id", "source_url").union(spark.read.parquet(manual).select("lead_id", "website"))
        return sorted(map(tuple, rows.collect()))

    links(batches[0], 0)
    pages(sent[0], 0)
    links(batches[1], 1)
    pages(sent[1], 1)
    assert ids.ranges() == {"links-0": (11, 2), "manual-0": (13, 2), "links-1": (15, 2), "manual-1": (17, 1)}
    first = seen()
    assert first == sorted([(3, "https://k"), (11, "http://a"), (12, "http://b"), (13, "https://n"), (14, "https://m"), (15, "http://a"), (16, "http://b"),
                            (13, "https://n"), (17, "https://o")])
    for write, batch, number in ((pages, sent[1], 1), (links, batches[0], 0), (pages, sent[0], 0)):
        write(batch, number)
    assert seen() == first and len(ids.ranges()) == 4
