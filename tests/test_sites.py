"""URLs, subpages, site merge and official links."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from leadloom.functions import skew, urls
from leadloom.operators import sites
from leadloom.operators import pages as page_ops
from leadloom.plans import enrichment

FILL = "<p>" + "word " * 120 + "</p>"


def test_resolve_like_standard_join(spark):
    bases = ["http://a/b/c", "http://a/b/c/", "http://a", "http://a/b/c/d", "http://a/b?z", "http://a//b/c", "https://u@h:8/x"]
    hrefs = ["x", "./", "..", "../", "../../../x", "/x/./y", "/x/../y", "/x//y", "x//y", "?q", "//h/p", "http://o/p", "/x/..",
             "x?y=../z", "#f", "", "mailto:a@b.c"]
    cases = [(b, h) for b in bases for h in hrefs if not (h == "#f" and "?" in b)]
    df = spark.createDataFrame(cases, "b string, h string")
    got = [r[0] for r in df.select(urls.resolve(F.col("b"), F.col("h"))).collect()]
    assert got == [urljoin(b, h) for b, h in cases]


def test_domains(spark):
    df = spark.createDataFrame([("https://WWW.a.org:8/x",), ("http://b.www.c.org",), ("nothing",)], "u string")
    rows = df.select(urls.netloc(F.col("u")), urls.site_domain(F.col("u")), urls.bare_domain(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [("www.a.org:8", "a.org:8", "a.org:8"),
                                        ("b.www.c.org", "b.www.c.org", "b.c.org"), ("", "", "")]


def subpages(spark, html, url="https://www.a.org/"):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return sites.with_subpages(page_ops.parse(df, page_ops.links)).first().subpages


def test_subpages(spark):
    assert subpages(spark, '<a href="/s">Contact</a><a href="/s">Services</a><a href="/t">team</a>') == [
        "https://www.a.org/t", "https://www.a.org/s"]
    assert subpages(spark, '<a href="/s">Team</a><a href="/s">Other</a>') == ["https://www.a.org/s"]
    assert subpages(spark, '<a href="/about#a">x</a><a href="/about#b">x</a>') == [
        "https://www.a.org/about#a", "https://www.a.org/about#b"]
    assert subpages(spark, '<a href="http://a.org/about">x</a><a href="http://b.org/about">x</a>') == ["http://a.org/about"]
    assert subpages(spark, "".join(f'<a href="/{w}">x</a>' for w in ("service", "team", "about", "contact"))) == [
        f"https://www.a.org/{w}" for w in ("contact", "about", "team")]
    assert subpages(spark, '<a href="/">About</a><a href="tel:about">x</a>') == ["https://www.a.org/"]


def captures(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "page_id long, url string, html string, channel string")


def build(spark, rows, use_browser=True, websites=("https://a.org/",)):
    web = spark.createDataFrame([(w,) for w in websites], "website string")
    return {r.website: r for r in sites.assemble(web, sites.parsed_captures(captures(spark, rows)), use_browser).collect()}


HOME = FILL + '<a href="/contact">c</a><a href="/about">a</a> z@a.dev'


def test_merge_over_http(spark):
    row = build(spark, [("https://a.org/", HOME, "http"), ("https://a.org/contact", "CONTACT a@a.dev" + FILL, "http"),
                        ("https://a.org/about", "too short", "http")])["https://a.org/"]
    assert row.method == "http" and row.pages == ["https://a.org/", "https://a.org/contact"]
    assert row.emails == ["a@a.dev", "z@a.dev"]
    assert row.text.index("z@a.dev") < row.text.index("CONTACT")
    assert [d.url for d in row.page_details] == row.pages and len(row.page_details[0].text_preview) == 500


def test_browser_helps_unusable_but_not_missing_pages(spark):
    rows = [("https://a.org/", HOME, "http"), ("https://a.org/about", "too short", "http"),
            ("https://a.org/about", "seen", "browser"), ("https://a.org/contact", "seen", "browser")]
    row = build(spark, rows)["https://a.org/"]
    assert row.method == "http+playwright" and row.pages == ["https://a.org/", "https://a.org/about"]
    row = build(spark, rows, use_browser=False)["https://a.org/"]
    assert row.method == "http" and row.pages == ["https://a.org/"]


def test_whole_site_from_browser(spark):
    rows = [("https://a.org/", "short", "http"), ("https://a.org/", HOME, "browser"),
            ("https://a.org/contact", FILL, "http"), ("https://a.org/about", "tiny", "browser")]
    row = build(spark, rows)["https://a.org/"]
    assert row.method == "playwright" and row.pages == ["https://a.org/", "https://a.org/about"]
    assert build(spark, rows, use_browser=False)["https://a.org/"].method == "failed"
    nothing = build(spark, rows, websites=["UNSCRAPABLE"])["UNSCRAPABLE"]
    assert (nothing.method, nothing.text, nothing.pages) == ("playwright", "", [])


def test_latest_capture_counts_and_text_is_cut(spark):
    rows = [("https://a.org/", FILL + "OLD", "http"), ("https://a.org/", "NEW" + "<p>word</p>" * 9000, "http")]
    row = build(spark, rows)["https://a.org/"]
    assert row.text.startswith("NEW") and len(row.text) == 15000


@pytest.mark.parametrize("html, expected", [
    ('<a href="https://x.dev/">website</a><a href="https://y.dev/">VISIT   Website</a>', "https://y.dev/"),
    ('<a href="https://www.dir.org/x">Visit Website</a><a href="/in">Website</a>', "https://dir.org/lead"),
    ('<a href="https://maps.google.com/">Website</a><a href="https://z.dev/?biz_redir=1">b</a>', "https://z.dev/?biz_redir=1"),
    ('<a data-testid="bizWebsiteLink" href="https://t.dev">t</a>', "https://t.dev")])
def test_official_link(spark, html, expected):
    leads = spark.createDataFrame([(1, "https://dir.org/lead")], "lead_id long, source_url string")
    source = spark.createDataFrame([(1, "https://dir.org/lead", html)], "page_id long, url string, html string")
    assert sites.with_website(leads, sites.official_links(source)).first().website == expected


def test_website_without_page(spark):
    leads = spark.createDataFrame([(1, "https://www.linkedin.com/x"), (2, "Manual"), (3, None), (4, "http://k.org")],
                                  "lead_id long, source_url string")
    source = spark.createDataFrame([], "page_id long, url string, html string")
    got = {r.lead_id: r.website for r in sites.with_website(leads, sites.official_links(source)).collect()}
    assert got == {1: "UNSCRAPABLE", 2: "NOT_FOUND", 3: "NOT_FOUND", 4: "http://k.org"}


def test_many_captures_of_one_url(spark):
    """100,000 captures of one page fold to the one that counts; an older usable one beats a newer unusable one."""
    many = spark.range(100_000).select(
        F.lit("http://a.org/").alias("url"), F.lit("http").alias("channel"), F.col("id").alias("page_id"),
        (F.col("id") < 70_000).alias("usable"), F.concat(F.lit("v"), F.col("id")).alias("page"))
    rows = sites.latest_captures(many.unionByName(many.limit(5).withColumn("channel", F.lit("browser")))).collect()
    assert sorted((r.channel, r.page_id, r.page) for r in rows) == [("browser", 4, "v4"), ("http", 69_999, "v69999")]
    none = many.withColumn("usable", F.lit(False))
    assert [r.page_id for r in sites.latest_captures(none).collect()] == [99_999]


def test_lead_job_reads_no_html(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, channel string")
    links, parsed = enrichment.parsed_sources(empty.drop("channel")), enrichment.parsed_captures(empty)
    assert "html" not in links.columns + parsed.columns
    wanted = enrichment.wanted(parsed, F.col("url"), spark.createDataFrame([("http://a.org/",)], "u string"))
    assert wanted.columns == [c for c in parsed.columns if c != "bucket"]


def test_numbering_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("n")).repartition(7)
    rows = skew.numbered(df, "n", "k", F.lit(10)).orderBy("n").collect()
    assert [r.k for r in rows] == list(range(11, 1011))


def test_sparse_ids_are_numbered(spark):
    """Ids far apart: the serial step has a row per partition, not per id."""
    df = spark.range(20_000).select((F.col("id") * 1_000_000_007).alias("n")).repartition(5)
    out = skew.numbered(df, "n", "k", F.lit(0))
    assert [r.k for r in out.orderBy("n").collect()] == list(range(1, 20_001))
