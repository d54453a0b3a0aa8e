"""The whole lead job: leads and page captures in, finished leads out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import urls
from leadloom.operators import analysis, leads as lead_ops, opportunities, sites
from leadloom.session import release, stored, stored_so_far
from leadloom.sources import tables
from leadloom.sources.page_store import PageStore

#: Parts of the parsed tables.
BUCKETS = 64


def analysed_sites(site_rows: DataFrame) -> DataFrame:
    """Analysis, opportunities and score of merged sites, written once.

    Later steps filter and unnest this table; over a stored table that costs a scan
    instead of a second run of the analysis.
    """
    found = opportunities.detect(analysis.analyze(analysis.from_sites(site_rows)))
    return stored(found.select(
        "website", "method", "text", "emails", "phones", "pages", "business_name", "industry", "services",
        "signals", "evidence", "opportunities", "opportunity_score", "opportunity_band", "score_breakdown",
        "title", "description", "schema_types", "content_length", "link_count", "page_details",
        analysis.intelligence().alias("business_intelligence")), "analysed-sites")


def parsed_sources(source_pages: DataFrame) -> DataFrame:
    """What the lead job reads of source pages: url, page_id, official link, bucket.  Row-local, no shuffle."""
    return sites.official_links(source_pages).withColumn("bucket", bucket(F.col("url")))


def parsed_captures(captures: DataFrame) -> DataFrame:
    """What the lead job reads of page captures (page_id, url, html, channel), and the bucket.  Row-local, no shuffle.

    With the columns status_code and content_type, HTTP captures that the crawl checks refuse count as not fetched;
    ``refused_captures`` has them.
    """
    return sites.parsed_captures(_judged(captures).where("verdict = 'ok'")).withColumn("bucket", bucket(F.col("url")))


def refused_captures(captures: DataFrame) -> DataFrame:
    """page_id, url, channel and the verdict of captures that do not count."""
    return _judged(captures).where("verdict <> 'ok'").select("page_id", "url", "channel", "verdict")


def _judged(captures: DataFrame) -> DataFrame:
    if "status_code" not in captures.columns:
        return captures.withColumn("verdict", F.lit("ok"))
    return tables.admission(captures).withColumn("verdict", F.when(F.col("channel") == "browser", "ok").otherwise(F.col("verdict")))


def bucket(url: Column) -> Column:
    """Pages of a site share a bucket: a hash of the site's domain."""
    return F.pmod(F.xxhash64(urls.site_domain(url)), F.lit(BUCKETS)).cast("int")


def append_parsed(parsed: DataFrame, path: str) -> None:
    """Add newly parsed pages to a table that is partitioned by bucket."""
    parsed.write.mode("append").partitionBy("bucket").parquet(path)


def unready() -> Column:
    """A finished lead whose source page or home page has not been read, though it has an address."""
    c = F.col
    web = lambda n: F.coalesce(c(n).startswith("http://") | c(n).startswith("https://"), F.lit(False))
    return web("found_website") & (~c("source_known") | (F.coalesce(F.size("pages"), F.lit(0)) <= 0))


def wanted(parsed: DataFrame, url: Column, keys: DataFrame) -> DataFrame:
    """The rows of a parsed table whose ``url`` value is among the one column of ``keys``.

    A bucketed table is read only in the buckets of the keys where these are few enough for Spark to prune by.
    """
    keys = keys.toDF("_key").where("_key is not null").distinct().withColumn("_bucket", bucket(F.col("_key")))
    return parsed.join(keys, (F.col("bucket") == F.col("_bucket")) & (url == F.col("_key")), "left_semi").drop("bucket")


def enrich(leads: DataFrame, links: DataFrame, captures: DataFrame | PageStore, use_browser: bool = True) -> DataFrame:
    """One finished row per lead (lead_id, company_name, location, source_url).

    ``links`` and ``captures`` are the parsed tables: html is parsed once, when it arrives, and never here.  Each
    distinct website is read and analysed once, however many leads share it; the result is then joined
    back to the leads.  Sources are picked by address, captures by the sites' domains (subpages never leave them); a
    ``PageStore`` is read in the buckets of these domains, and its payload stays where it is.
    """
    c = F.col
    sources = wanted(links, c("url"), leads.select("source_url")) if "bucket" in links.columns else links
    located = stored(sites.with_website(leads, sources), "located-leads")
    if isinstance(captures, PageStore):
        found = analysed_sites(captures.assemble(located.select("website"), use_browser))
    else:
        domain = lambda u: F.concat(F.lit("//"), urls.site_domain(u))  # noqa: E731  an address of the domain itself
        near = wanted(captures, domain(c("url")), located.select(domain(c("website"))))
        found = analysed_sites(sites.assemble(located, near, use_browser))
    done = located.join(found, "website", "left")
    # A lead without a website is finished with empty data; it never reads pages.
    failed = (c("website") != "NOT_FOUND") & (c("method") == "failed")
    kept = [n for n in found.columns if n not in ("website", "method")]
    return done.select(
        "lead_id", F.coalesce("company_name", F.lit("")).alias("company_name"), "location", "source_url",
        F.when(failed, "ERROR").otherwise(c("website")).alias("website"), c("website").alias("found_website"),
        F.when(c("website") == "NOT_FOUND", "none").otherwise(c("method")).alias("method"),
        F.when(failed, "FAILED").otherwise(lead_ops.final_status("emails", "phones")).alias("status"), "source_known",
        *[F.when(~failed, c(n)).alias(n) for n in kept])


def finish(leads: DataFrame, links: DataFrame, captures: DataFrame | PageStore, out: str, use_browser: bool = True) -> DataFrame:
    """``enrich`` as a batch job: the finished leads are written to ``out``, and the tables stored on the way are deleted."""
    spark, mark = leads.sparkSession, stored_so_far()
    try:
        enrich(leads, links, captures, use_browser).write.mode("errorifexists").parquet(out)
    finally:
        release(spark, mark)
    return spark.read.parquet(out)


def analysis_document() -> Column:
    """The whole analysis of a finished lead as JSON, as ``dashboard.ANALYSIS_SCHEMA`` reads it."""
    c = F.col
    return F.to_json(F.struct(
        c("website").alias("url"), "business_name", "industry", "services", "title", "description", "schema_types", "signals",
        c("evidence").alias("signal_evidence"), "opportunity_score", c("opportunity_band").alias("opportunity_score_band"),
        c("score_breakdown").alias("opportunity_score_breakdown"),
        F.transform("opportunities", lambda o: o.dropFields("rule_no")).alias("opportunities"),
        "content_length", "link_count", c("pages").alias("pages_analyzed"), "page_details", "business_intelligence"),
        {"ignoreNullFields": "false"})


#: Events of a finished lead, in order.
STEPS = ("processing", "enriched", "scraped", "analysis", "final")


def to_events(finished: DataFrame, ts: Column, after: Column | None = None) -> DataFrame:
    """The state changes that store finished leads, as ``leads.fold_state`` reads them.

    PROCESSING, then ENRICHED with website and company, the scraped contacts and text, the analysis document, and the
    final status; a failed lead goes from ENRICHED to FAILED.  A lead's events have rising numbers from
    ``after`` (default 0): five per lead id.
    """
    c = F.col
    failed = c("status") == "FAILED"
    nothing = F.lit(None).cast("string")

    def event(kind, when=F.lit(True), **fields):
        names = ("status", "website", "company_name", "emails", "phones", "body_text")
        return F.when(when, F.struct(F.lit(kind).alias("kind"), *[fields.get(n, nothing).alias(n) for n in names],
                                     fields.get("score", F.lit(None).cast("int")).alias("score"),
                                     fields.get("analysis_json", nothing).alias("analysis_json")))

    steps = F.array(
        event("status", status=F.lit("PROCESSING")),
        event("status", status=F.lit("ENRICHED"), website=c("found_website"), company_name=c("company_name")),
        event("scraped", ~failed, emails=F.array_join("emails", ", "), phones=F.array_join("phones", ", "), body_text=c("text")),
        event("analysis", ~failed, score=c("opportunity_score"), analysis_json=analysis_document()),
        event("status", status=c("status"), website=c("website")))
    return finished.select("lead_id", F.posexplode(steps).alias("step", "event")).where("event is not null").select(
        ((F.lit(0) if after is None else after) + c("lead_id") * len(STEPS) + c("step")).cast("long").alias("seq"), "lead_id",
        ts.alias("ts"), "event.*")


def rejects(finished: DataFrame) -> DataFrame:
    """lead_id, website and reason of failed leads: no page of their website could be read."""
    return finished.where("status = 'FAILED'").select(
        "lead_id", F.col("found_website").alias("website"), F.lit("no_page").alias("reason"))


def report(enriched: DataFrame) -> DataFrame:
    """Report input of finished leads: the company falls back to the business name."""
    return enriched.withColumn("company_name", F.coalesce(
        F.nullif("company_name", F.lit("")), "business_name"))


def top_leads(enriched: DataFrame, limit: int = 20) -> DataFrame:
    """The best scored finished leads."""
    return enriched.where("opportunity_score is not null").orderBy(
        F.desc("opportunity_score"), "lead_id").limit(limit)
