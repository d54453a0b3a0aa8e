"""Page store and waiting leads: several writers, large domains, plans without moved payload, pages after leads."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadloom import session
from leadloom.operators import sites
from leadloom.plans import enrichment
from leadloom.session import new_path
from leadloom.sources.page_store import PageStore
from leadloom.streaming import jobs
from leadloom.streaming.waiting import WaitingLeads

T0 = datetime(2024, 1, 1)
TEXT = "We look after our customers and answer every question they may have about our work. " * 8
CAPTURE = "page_id long, url string, html string, channel string"
LEAD = "lead_id long, company_name string, location string, source_url string, asked timestamp"


def html(title, links=()):
    return f"<html><title>{title}</title><body><p>{title} {TEXT}</p>" + "".join(f"<a href='{u}'>{t}</a>" for u, t in links) + "</body></html>"


def captures(spark, rows):
    return spark.createDataFrame(rows, CAPTURE)


def site(base, n, first=0):
    """A home page with three subpages of one domain."""
    pages = [(first + n * 10, f"{base}/{n}", html(f"Home {n}", [(f"/{n}/contact", "Contact"), (f"/{n}/about", "About"), (f"/{n}/team", "Team")]), "http")]
    return pages + [(first + n * 10 + k, f"{base}/{n}/{p}", html(f"{p} {n}"), "http") for k, p in enumerate(("contact", "about", "team"), 1)]


def flat(df):
    return sorted(map(str, df.select("website", "method", "text", "pages", "page_details").collect()))


def at(minutes):
    return F.lit(T0 + timedelta(minutes=minutes))


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the pages are of one domain; the others of twelve."""
    return [p for n in range(24) for p in site("https://large.example.com", n)] + [
        p for d in range(12) for n in range(2) for p in site(f"https://d{d}.example.org", n, 1000 * (d + 1))]


@pytest.fixture(scope="module")
def websites(spark, rows):
    homes = [r[1] for r in rows if r[0] % 10 == 0] + ["https://none.example.com/"]
    return spark.createDataFrame([(h,) for h in homes], "website string")


@pytest.mark.parametrize("browser", [True, False])
def test_equal_to_plain_tables(spark, rows, websites, browser):
    parsed = enrichment.parsed_captures(captures(spark, rows))
    store = PageStore(spark, new_path(spark, "pages"), buckets=8, splits=4, large_domain=20)
    store.append("a", parsed)
    assert flat(store.assemble(websites, browser)) == flat(sites.assemble(websites, parsed, browser))
    one = websites.where("website like '%d3%'")
    assert flat(store.assemble(one, browser)) == flat(sites.assemble(one, parsed, browser))


def test_a_domain_grows_large(spark, rows, websites):
    """Its first pages lie in one slot, later ones in others; sites of both are put together."""
    parsed = enrichment.parsed_captures(captures(spark, rows))
    store = PageStore(spark, new_path(spark, "pages"), buckets=8, splits=4, large_domain=40)
    early = (F.col("page_id") % 10 < 2) | (F.col("page_id") < 40)
    store.append("a", parsed.where(early))
    assert store.large_domains().collect()[0].domain == "large.example.com" and len(store.large_domains().collect()) == 1
    store.append("b", parsed.where(~early))
    again = PageStore(spark, store.path, buckets=99)
    assert again.buckets == 8
    want = flat(sites.assemble(websites, parsed))
    assert flat(again.assemble(websites)) == want
    spread = store._read("light").where("url like '%large%'").groupBy("slot").count().collect()
    assert len(spread) >= 4
    # United loads and a load that is written again change nothing.
    store.append("b", parsed.where(~early))
    assert store._read("payload").count() == len(rows)
    store.compact("united")
    assert store._read("payload").select("load").distinct().count() == 1 and store._read("payload").count() == len(rows)
    assert flat(store.assemble(websites)) == want


def test_payload_stays_where_it_is(spark, rows, websites):
    """No exchange above the payload scan; the large domain's payload is read by several tasks."""
    store = PageStore(spark, new_path(spark, "pages"), buckets=16, splits=8, large_domain=20)
    store.append("a", enrichment.parsed_captures(captures(spark, rows)))
    captures_, payload = store._read("light"), store._read("payload")
    requests, latest = sites.site_tables(websites, captures_.drop("load"))
    keys = sites.wanted_captures(sites.picked(requests, latest, True, ("bucket", "slot"))).cache()
    for limit in ("-1", "10m"):  # by a shuffled join, and by a broadcast of few keys
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            with store.in_place():
                plan = store.gathered_in_place(payload, keys)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        lines = plan.split("\n")
        scan = next(k for k, line in enumerate(lines) if "payload" in line and "FileScan" in line)
        depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
        above = [line for k, line in enumerate(lines[:scan]) if len(line) - len(line.lstrip(" :+-")) < depth]
        assert above and not any("Exchange" in line for line in above), plan
        assert "Bucketed: true" in lines[scan]
    buckets = payload.where("url like '%large%'").select("bucket").distinct().count()
    assert buckets >= 3
    # A small batch reads the folders of its buckets alone.
    few = store._in_buckets(payload, keys.where("website = 'https://d1.example.org/0'"))
    assert few.select("bucket").distinct().count() == 1 and len(few.inputFiles()) == 1


def test_two_writers(spark, rows, websites):
    """Rows of a stream and of a batch job in one store are all read, by batch and by stream."""
    store = PageStore(spark, new_path(spark, "pages"), buckets=4, splits=2)
    arriving = new_path(spark, "arriving")
    captures(spark, rows[:100]).repartition(2).write.parquet(arriving)
    stream = jobs.file_stream(spark, arriving, captures(spark, rows).schema)
    jobs.parse_stream(stream, store, new_path(spark, "check")).awaitTermination()
    store.append("batch", enrichment.parsed_captures(captures(spark, rows[100:])))
    assert store._read("payload").count() == store._read("light").count() == len(rows)
    assert store.links().count() == 100
    captures(spark, rows[:3]).write.mode("append").parquet(arriving)
    jobs.parse_stream(stream, store, new_path(spark, "check2"), name="again").awaitTermination()
    assert flat(store.assemble(websites)) == flat(sites.assemble(websites, enrichment.parsed_captures(captures(spark, rows))))


def test_batch_job_leaves_only_its_result(spark, rows):
    store = PageStore(spark, new_path(spark, "pages"), buckets=4)
    store.append("a", enrichment.parsed_captures(captures(spark, rows)))
    leads = spark.createDataFrame([(1, "A", "", "https://d1.example.org/0"), (2, "B", "", "Manual HTML")], "lead_id long, company_name string, location string, source_url string")
    mark, out = session.stored_so_far(), new_path(spark, "finished")
    done = enrichment.finish(leads, store.links(), store, out)
    assert session.stored_so_far() == mark and {r.lead_id: len(r.pages or []) for r in done.collect()} == {1: 4, 2: 0}


def test_empty_store(spark, websites):
    store = PageStore(spark, new_path(spark, "pages"))
    assert {r.method for r in store.assemble(websites).collect()} == {"playwright"} and store.links().count() == 0


def test_leads_wait_for_their_pages(spark):
    store = PageStore(spark, new_path(spark, "pages"), buckets=4, splits=2)
    service = WaitingLeads(store, new_path(spark, "service"), patience="5 hours")
    folder, check = new_path(spark, "leads"), new_path(spark, "check")
    new = [(1, "A", "", "https://a.example.com/0"), (2, None, "", "https://list.example.net/b"), (3, "C", "", "https://c.example.com/0"),
           (4, "D", "", "Manual HTML"), (5, "E", "", "https://e.example.com/0")]
    spark.createDataFrame([(*r, T0) for r in new], LEAD).coalesce(1).write.parquet(folder)
    service.intake_stream(jobs.file_stream(spark, folder, spark.read.parquet(folder).schema), new_path(spark, "check")).awaitTermination()

    def run():
        service.waiting_stream(check).awaitTermination()
        return {r.lead_id: (r.found_website, r.pages) for r in service.finished().collect()}, {r.lead_id for r in service.waiting().collect()}

    assert run() == ({4: ("NOT_FOUND", [])}, {1, 2, 3, 5}) or run()[1] == {1, 2, 3, 5}
    # Lead 1: all its pages at once.  Lead 2: its source page, which names a site that comes later.  Lead 5: its source page only.
    a = captures(spark, site("https://a.example.com", 0))
    store.append("a", enrichment.parsed_captures(a), enrichment.parsed_sources(a), at(10))
    found = "<a href='https://b.example.com/0'>Website</a>"
    sources = captures(spark, [(50, "https://list.example.net/b", found, "http"), (51, "https://e.example.com/0", "<p>none</p>", "http")])
    store.append("sources", None, enrichment.parsed_sources(sources), at(11))
    done, waits = run()
    assert set(done) == {1, 4} and waits == {2, 3, 5} and len(done[1][1]) == 4
    # Time passes, but not theirs.
    service.tick("1", at(120))
    assert run()[1] == {2, 3, 5}
    b = captures(spark, site("https://b.example.com", 0, 100))
    store.append("b", enrichment.parsed_captures(b), None, at(130))
    done, waits = run()
    assert done[2][0] == "https://b.example.com/0" and len(done[2][1]) == 4 and waits == {3, 5}
    before = sorted(map(str, service.finished().collect()))
    # Their time is over: given up without pages, and later pages change nothing.
    service.tick("2", at(900))
    run()
    service.tick("3", at(1300))
    done, waits = run()
    assert set(done) == {1, 2, 3, 4, 5} and waits == set() and not done[3][1] and not done[5][1]
    c = captures(spark, site("https://c.example.com", 0, 200))
    store.append("c", enrichment.parsed_captures(c), enrichment.parsed_sources(c), at(1400))
    run()
    service.finish_overdue(at(2000), "overdue")
    after = {r.lead_id: r for r in service.finished().collect()}
    assert not after[3].pages and len(after) == 5 and set(before) <= set(map(str, after.values()))


def test_overdue_leads_are_finished_with_what_is_there(spark):
    """A page that is told of too late to wake a lead counts when its wait ends."""
    store = PageStore(spark, new_path(spark, "pages"), buckets=4)
    service = WaitingLeads(store, new_path(spark, "service"), patience="1 hour")
    folder = new_path(spark, "leads")
    spark.createDataFrame([(1, "A", "", "https://a.example.com/0", T0)], LEAD).write.parquet(folder)
    service.intake_stream(jobs.file_stream(spark, folder, spark.read.parquet(folder).schema), new_path(spark, "check")).awaitTermination()
    a = captures(spark, site("https://a.example.com", 0))
    store.append("a", enrichment.parsed_captures(a), None, at(-600))
    service.finish_overdue(at(30), "early")
    assert service.waiting().count() == 1
    service.finish_overdue(at(61), "late")
    assert [len(r.pages) for r in service.finished().collect()] == [4] and service.waiting().count() == 0
