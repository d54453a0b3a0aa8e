"""Lead intake and state: queueing links, manual pages, folding events, final status."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.skew import numbered, numbered_spans
from leadloom.functions.text import is_blank, strip
from leadloom.operators import pages
from leadloom.session import stored


def intake(link_lists: DataFrame, last_id: Column) -> DataFrame:
    """New PENDING leads of pasted link lists (request_id, links: lines of text).

    Blank lines go, and every link not starting with ``http``; repeats stay.  Ids
    follow ``last_id`` in the order of arrival.
    """
    links = link_lists.select("request_id", F.filter(
        F.transform(F.split("links", "\n"), strip), lambda l: l.startswith("http")).alias("links"))
    # Number the requests' first links by running counts, then the links inside.
    sized = numbered_spans(links, "request_id", F.size("links"), last_id)
    return sized.select(
        F.posexplode("links").alias("pos", "source_url"), "first_id").select(
        (F.col("first_id") + F.col("pos")).alias("lead_id"), "source_url", F.lit("PENDING").alias("status"),
        F.lit("").alias("company_name"), F.lit("").alias("location"))


def final_status(emails: Column, phones: Column) -> Column:
    """MISSING_DATA when both contact lists are empty."""
    return F.when((F.size(emails) == 0) & (F.size(phones) == 0), "MISSING_DATA").otherwise("COMPLETED")


def latest_by_website(leads: DataFrame) -> DataFrame:
    """The lead with the highest id per website; combined before the shuffle."""
    return (leads.where("website is not null").groupBy("website")
            .agg(F.max_by(F.struct(*[n for n in leads.columns if n != "website"]), "lead_id").alias("lead"))
            .select("website", "lead.*"))


def manual_rejects(submitted: DataFrame) -> DataFrame:
    """Manual pages (seq, url, html) that cannot be taken, with the reason."""
    no_url = is_blank(F.col("url"))
    return submitted.where(no_url | is_blank(F.col("html"))).select(
        "seq", F.when(no_url, "url_required").otherwise("html_required").alias("error"))


def manual_upsert(submitted: DataFrame, leads: DataFrame, last_id: Column) -> DataFrame:
    """Rows of ``leads`` a batch of manual pages (seq, url, html) adds or changes.

    No quality gate and no text cut here.  The page updates the latest lead with
    exactly its website, else it becomes a new lead.  Of several pages for one
    website the last one counts; new ids follow the order of first arrival.
    """
    c = F.col
    good = (submitted.select("seq", strip(c("url")).alias("website"), "html")
            .where((c("website") != "") & ~is_blank(c("html"))))
    # Which page counts is found by seq alone, so neither html nor text of the others is moved or kept.
    last = good.groupBy("website").agg(F.max("seq").alias("seq"), F.min("seq").alias("first_seq"))
    counted = good.join(last.select("seq"), "seq", "left_semi")
    parsed = pages.parse(counted.withColumn("url", c("website")), pages.emails, pages.phones).select(
        "website", "seq", "emails", "phones", c("text").alias("body_text"))
    parsed = parsed.join(last, ["website", "seq"]).drop("seq").withColumn("status", final_status("emails", "phones"))
    known = latest_by_website(leads.select("lead_id", "website", "company_name", "location", "source_url"))
    # Stored: the parsed pages feed updates, inserts and the numbering of inserts.
    matched = stored(parsed.join(known, "website", "left"), "manual-pages")
    updates = matched.where("lead_id is not null").withColumn("action", F.lit("update"))
    fresh = matched.where("lead_id is null").drop("lead_id")
    inserts = numbered(fresh, "first_seq", "lead_id", last_id).withColumns({
        "action": F.lit("insert"), "company_name": F.lit("Unknown"), "location": F.lit(""),
        "source_url": F.lit("Manual HTML")})
    return updates.unionByName(inserts).select(
        "lead_id", "action", "company_name", "location", "source_url", "website", "status", "emails", "phones",
        "body_text")


def fold_state(events: DataFrame) -> DataFrame:
    """Current row per lead from its events (seq, lead_id, ts, kind, ...).

    The last event of a kind sets that kind's fields, nulls included; website and
    company_name of status events keep the last non-null value ("" counts as one).
    Plain aggregates, so a lead with very many events is combined before the
    shuffle, and the same fold runs on a stream.
    """
    c = F.col
    last = lambda value, cond: F.max_by(value, F.when(cond, c("seq")))
    kind = lambda k: c("kind") == k
    scraped = last(F.struct("emails", "phones", "body_text"), kind("scraped"))
    analysis = last(F.struct("score", "analysis_json"), kind("analysis"))
    return events.groupBy("lead_id").agg(
        last("status", kind("status")).alias("status"),
        last("website", kind("status") & c("website").isNotNull()).alias("website"),
        last("company_name", kind("status") & c("company_name").isNotNull()).alias("company_name"),
        scraped.alias("_scraped"), analysis.alias("_analysis"),
        F.min("ts").alias("created_at"), F.max_by("ts", "seq").alias("updated_at"), F.max("seq").alias("last_seq"),
    ).select(
        "lead_id", F.coalesce("status", F.lit("PENDING")).alias("status"), "website", "company_name",
        "_scraped.emails", "_scraped.phones", "_scraped.body_text",
        c("_analysis.score").alias("opportunity_score"), "_analysis.analysis_json",
        "created_at", "updated_at", "last_seq")


def next_pending(leads: DataFrame) -> DataFrame:
    """The PENDING lead with the lowest id."""
    return leads.where("status = 'PENDING'").orderBy("lead_id").limit(1)


def by_id(leads: DataFrame, lead_id: int) -> DataFrame:
    return leads.where(F.col("lead_id") == lead_id)
