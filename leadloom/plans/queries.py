"""Every checked query: name to a function of (spark, folder).

Results are flat: lists are joined with ``|`` so that they compare as text.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import contacts, urls, vocab
from leadloom.functions.text import exploded_rows
from leadloom.operators import analysis, dashboard, leads, opportunities, pages, reports, sites
from leadloom.plans import enrichment
from leadloom.session import new_path, stored
from leadloom.sources import seeding, tables
from leadloom.sources.page_store import PageStore
from leadloom.streaming import intake, jobs
from leadloom.streaming.waiting import WaitingLeads

QUERIES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def joined(c, sep="|") -> Column:
    return F.array_join(c, sep)


def _signals(c) -> list[Column]:
    """The twelve signals as columns, beside a column of services."""
    return [c[n].alias("services_signal" if n == "services" else n) for n in vocab.SIGNALS]


def notes(c) -> Column:
    """Evidence entries as ``code=arg`` text."""
    return joined(F.transform(c, lambda e: F.concat(e["code"], F.lit("="), e["arg"])))


# --- sources and sinks --------------------------------------------------------

@query("s1_link_intake")
def _(spark, d):
    return leads.intake(seeding.link_lists(spark, d), F.lit(100)).select("lead_id", "source_url", "status")


@query("s1_streamed_intake")
def _(spark, d):
    lists = stored(seeding.link_lists(spark, d), "lists")
    arriving, out, log, check = (new_path(spark, n) for n in ("lists", "queued", "ids", "check"))
    middle = lists.agg(F.percentile_approx("request_id", 0.5)).first()[0]
    for half in (F.col("request_id") <= middle, F.col("request_id") > middle):
        lists.where(half).coalesce(1).write.mode("append").parquet(arriving)
        intake.link_stream(jobs.file_stream(spark, arriving, lists.schema), out, intake.LeadIds(spark, log, 100), check).awaitTermination()
    return spark.read.parquet(out).select("lead_id", "source_url", "status")


@query("s2_crawl_admission")
def _(spark, d):
    return tables.admission(seeding.crawl_log(spark, d)).select("page_id", "status_code", "verdict")


@query("s3_page_source")
def _(spark, d):
    return tables.pages(spark, d).select("page_id", "url", F.length("html").alias("html_chars"))


def _manual(spark, d) -> DataFrame:
    new = seeding.new_leads(spark, d)
    located = sites.with_website(new, _links(spark, d))
    last = new.agg(F.max("lead_id").alias("m")).scalar()
    return leads.manual_upsert(seeding.manual_pages(spark, d), located, last)


@query("s4_manual_upsert")
def _(spark, d):
    return _manual(spark, d).select(
        "lead_id", "action", F.coalesce("company_name", F.lit("")).alias("company_name"), "source_url", "website",
        "status", joined("emails").alias("emails"), joined("phones").alias("phones"), "body_text")


@query("s4_manual_rejects")
def _(spark, d):
    return leads.manual_rejects(seeding.manual_pages(spark, d))


@query("s5_report_append")
def _(spark, d):
    return reports.report_rows(enrichment.report(_enriched(spark, d)))


@query("s5_report_update")
def _(spark, d):
    report = reports.report_rows(enrichment.report(_enriched(spark, d)))
    changes = _manual(spark, d).withColumn("opportunity_score", F.lit(None).cast("int"))
    return reports.updated_report(report, changes)


@query("s5_report_in_place")
def _(spark, d):
    path = new_path(spark, "report")
    reports.write_report_table(reports.report_rows(enrichment.report(_enriched(spark, d))), path, span=50)
    reports.update_report_table(path, _manual(spark, d).withColumn("opportunity_score", F.lit(None).cast("int")), span=50)
    return reports.read_report_table(spark, path)


@query("s6_snapshot_columns")
def _(spark, d):
    old = seeding.new_leads(spark, d).select("lead_id", "company_name", "source_url")
    new = leads.fold_state(seeding.lead_events(spark, d)).select(
        (F.col("lead_id") + 1000000000).alias("lead_id"), "company_name", "opportunity_score")
    both = tables.with_added_columns(old, new)
    return both.select("lead_id", F.coalesce("company_name", F.lit("-")).alias("company_name"),
                       F.coalesce("source_url", F.lit("-")).alias("source_url"),
                       F.coalesce(F.col("opportunity_score").cast("string"), F.lit("-")).alias("opportunity_score"))


# --- pages --------------------------------------------------------------------

def _page_query(name, step, *columns):
    QUERIES[name] = lambda spark, d: pages.parse(seeding.seeded_pages(spark, d), step).selectExpr(
        "page_id", *columns)


_page_query("p01_html_quality", pages.quality, "usable", "reason", "text_length", "html_length")
_page_query("p02_visible_text", pages.text_layers, "text")
_page_query("p03_raw_text", pages.text_layers, "lower(raw_text) as raw_text")
_page_query("p04_title", pages.head_fields, "title")
_page_query("p05_meta_description", pages.head_fields, "description")
_page_query("p06_schema_types", pages.head_fields, "array_join(schema_types, '|') as schema_types")
_page_query("p08_mailto_emails", pages.emails, "array_join(mailto_emails, '|') as emails")
_page_query("p09_scanned_emails", pages.emails, "array_join(scanned_emails, '|') as emails")
_page_query("p10_obfuscated_emails", pages.emails, "array_join(obfuscated_emails, '|') as emails")
_page_query("p13_tel_phones", pages.phones, "array_join(tel_phones, '|') as phones")
_page_query("p14_text_phones", pages.phones, "array_join(text_phones, '|') as phones")
_page_query("p17_lead_form", pages.features, "lead_form")
_page_query("p18_keyword_features", pages.features, *vocab.FEATURES)
_page_query("p19_cta_count", pages.features, "cta_count")


@query("p12_ordered_contacts")
def _(spark, d):
    return pages.parse(seeding.seeded_pages(spark, d), pages.emails, pages.phones).select(
        "page_id", joined("emails").alias("emails"), joined("phones").alias("phones"))


@query("p07_anchors")
def _(spark, d):
    out = pages.links(pages.text_layers(seeding.seeded_pages(spark, d)))
    pair = F.transform("hrefs", lambda h, i: F.struct(h.alias("href"), F.get("link_texts", i).alias("text")))
    return exploded_rows(out.select("page_id", "link_count", pair.alias("a")), "a").select(
        "page_id", "link_count", "pos", "item.href", "item.text")


@query("p11_email_validity")
def _(spark, d):
    c = F.col
    page = seeding.seeded_pages(spark, d).select(F.lit("page").alias("origin"), c("page_id").alias("id"),
                                                 c("html").alias("body"))
    doc = tables.table(spark, d, "documents").select(F.lit("document").alias("origin"), c("doc_id").alias("id"),
                                                     c("text").alias("body"))
    found = page.unionByName(doc).select(
        "origin", "id", F.array_distinct(contacts.scan_emails(c("body"))).alias("found"))
    return exploded_rows(found, "found").select(
        "origin", "id", c("item").alias("email"), contacts.valid_email(c("item")).alias("valid"))


@query("p14_document_phones")
def _(spark, d):
    return tables.table(spark, d, "documents").select(
        "doc_id", joined(F.array_sort(contacts.text_phones(F.col("text")))).alias("phones"))


@query("p15_toll_free")
def _(spark, d):
    out = pages.text_layers(seeding.seeded_pages(spark, d))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(contacts.PHONE), F.lit(1)))
    return exploded_rows(out.select("page_id", found.alias("found")), "found").select(
        "page_id", F.col("item").alias("phone"), contacts.toll_free(F.col("item")).alias("toll_free"))


@query("p16_form_details")
def _(spark, d):
    out = pages.parse(seeding.seeded_pages(spark, d), pages.features).select(
        "page_id", "form_count", "form_details")
    return exploded_rows(out, "form_details").select(
        "page_id", "form_count", "pos", "item.action", joined("item.fields").alias("fields"), "item.text")


@query("p20_page_job")
def _(spark, d):
    good, _ = pages.page_job(seeding.seeded_pages(spark, d))
    return good.select("page_id", "reason", F.length("text").alias("text_chars"), joined("emails").alias("emails"),
                       joined("phones").alias("phones"), "form_count", "lead_form", *vocab.FEATURES, "cta_count")


@query("p20_page_rejects")
def _(spark, d):
    return pages.page_job(seeding.seeded_pages(spark, d))[1].select("page_id", "error")


# --- sites --------------------------------------------------------------------

def _websites(spark, d) -> DataFrame:
    return seeding.new_leads(spark, d).select(F.col("source_url").alias("website"))


#: Tests share the parsed tables between queries, by session and folder; elsewhere every query parses for itself.
SHARED: dict | None = None


def _once(spark, d, name, make) -> DataFrame:
    if SHARED is None:
        return stored(make(), name)
    key = (spark.sparkContext.applicationId, d, name)
    if key not in SHARED:
        SHARED[key] = stored(make(), name)
    return SHARED[key]


def _links(spark, d) -> DataFrame:
    """The parsed source pages."""
    return _once(spark, d, "parsed-sources", lambda: enrichment.parsed_sources(seeding.seeded_pages(spark, d)))


def _parsed(spark, d) -> DataFrame:
    """The parsed captures."""
    return _once(spark, d, "parsed-captures", lambda: enrichment.parsed_captures(seeding.captures(spark, d)))


def _sites(spark, d, use_browser=True) -> DataFrame:
    return sites.assemble(_websites(spark, d), _parsed(spark, d).drop("bucket"), use_browser)


@query("w1_domains")
def _(spark, d):
    c = F.col
    both = tables.pages(spark, d).select("page_id", "url").unionByName(
        seeding.seeded_pages(spark, d).select("page_id", "url"))
    return both.select("page_id", "url", urls.netloc(c("url")).alias("netloc"),
                       urls.site_domain(c("url")).alias("site_domain"), urls.bare_domain(c("url")).alias("bare_domain"))


@query("w2_resolved_links")
def _(spark, d):
    out = pages.links(pages.text_layers(seeding.seeded_pages(spark, d)))
    return exploded_rows(out.select("page_id", "url", "hrefs"), "hrefs").select(
        "page_id", "pos", urls.resolve(F.col("url"), F.trim("item")).alias("resolved"))


@query("w3_subpages")
def _(spark, d):
    out = sites.with_subpages(pages.parse(seeding.seeded_pages(spark, d), pages.links))
    return exploded_rows(out.select("page_id", "subpages"), "subpages").select(
        "page_id", F.col("pos").alias("rank"), F.col("item").alias("subpage"))


@query("w4_requested_pages")
def _(spark, d):
    requests, latest = sites.site_tables(_websites(spark, d), sites.light(_parsed(spark, d)))
    return sites.fetched(requests, latest).select(
        "website", "mode", "rank", "url", F.coalesce("channel", F.lit("missing")).alias("channel"),
        F.coalesce(F.col("usable").cast("string"), F.lit("-")).alias("usable"))


@query("w5_site_merge")
def _(spark, d):
    return _sites(spark, d).select("website", "text", joined("emails").alias("emails"),
                                   joined("phones").alias("phones"), joined("pages").alias("pages"))


@query("w5_page_details")
def _(spark, d):
    out = exploded_rows(_sites(spark, d).select("website", "page_details"), "page_details")
    return out.select("website", "pos", "item.url", "item.features.lead_form", "item.features.booking",
                      joined("item.emails").alias("emails"), joined("item.phones").alias("phones"),
                      "item.text_preview")


@query("w6_method")
def _(spark, d):
    return _sites(spark, d).select("website", "method", F.size("pages").alias("page_count"))


@query("w6_method_without_browser")
def _(spark, d):
    return _sites(spark, d, use_browser=False).select("website", "method", F.size("pages").alias("page_count"))


@query("w7_directories")
def _(spark, d):
    return seeding.new_leads(spark, d).select(
        "lead_id", "source_url", sites.is_directory(F.col("source_url")).alias("is_directory"))


@query("w8_official_website")
def _(spark, d):
    return sites.with_website(seeding.new_leads(spark, d), _links(spark, d)).select(
        "lead_id", "source_url", "website")


# --- analysis -----------------------------------------------------------------

def _analysed(spark, d) -> DataFrame:
    return analysis.analyze(analysis.from_sites(_sites(spark, d)))


def _analysed_pages(spark, d) -> DataFrame:
    return analysis.analyze(analysis.from_html(seeding.seeded_pages(spark, d)))


def _analysis_query(name, *columns):
    QUERIES[name] = lambda spark, d: _analysed(spark, d).selectExpr("website", *columns)


@query("a01_feature_rollup")
def _(spark, d):
    has = lambda name: F.exists("page_details", lambda p: p["features"][name]).alias(name)
    return _sites(spark, d).select("website", *map(has, analysis.PAGE_FEATURES))


_analysis_query("a02_signals", "signals.*")
_analysis_query("a03_text_form", "text_form")
_analysis_query("a04_contact_signal", "signals.contact_page")
_analysis_query("a05_contact_presence", "signals.email", "signals.phone",
                "size(emails) as email_count", "size(phones) as phone_count")
_analysis_query("a07_business_name", "business_name")
_analysis_query("a08_industry", "industry")
_analysis_query("a09_services", "array_join(services, '|') as services")
_analysis_query("a11_audiences", "array_join(audiences, '|') as audiences")
_analysis_query("a12_workflows", "array_join(workflows, '|') as workflows")
_analysis_query("a13_capabilities", "array_join(capabilities, '|') as capabilities",
                "array_join(conversion_paths, '|') as conversion_paths")
_analysis_query("a14_unknown_workflows", "array_join(unknown_workflows, '|') as unknown_workflows")
_analysis_query("a15_customer_journey", "array_join(journey, '|') as journey")
_analysis_query("a16_data_quality", "data_quality.*")
_analysis_query("a10_site_analysis", "business_name", "industry", "array_join(services, '|') as services",
                "content_length", "link_count", "array_join(pages, '|') as pages")


@query("a02_page_signals")
def _(spark, d):
    return _analysed_pages(spark, d).select("website", "signals.*")


def _evidence_rows(analysed) -> DataFrame:
    out = exploded_rows(analysed.select("website", F.map_entries("evidence").alias("e")), "e")
    return out.where(F.size("item.value") > 0).select(
        "website", F.col("item.key").alias("signal"), notes("item.value").alias("notes"))


@query("a06_signal_evidence")
def _(spark, d):
    return _evidence_rows(_analysed(spark, d))


@query("a06_page_evidence")
def _(spark, d):
    return _evidence_rows(_analysed_pages(spark, d))


@query("a10_page_analysis")
def _(spark, d):
    return opportunities.detect(_analysed_pages(spark, d)).select(
        "website", "business_name", "industry", joined("services").alias("services"), "title", "description",
        joined("schema_types").alias("schema_types"), "content_length", "link_count",
        "opportunity_score", "opportunity_band")


@query("a17_business_intelligence")
def _(spark, d):
    out = _analysed(spark, d).select("website", analysis.intelligence().alias("b"))
    return out.select(
        "website", "b.analysis_version", "b.business_profile.industry",
        joined("b.business_profile.audiences").alias("audiences"), joined("b.customer_journey").alias("journey"),
        joined("b.observed.website_capabilities").alias("capabilities"),
        joined("b.observed.workflows").alias("workflows"), joined("b.observed.services").alias("services"),
        joined("b.unknowns").alias("unknowns"), F.col("b.data_quality.score").alias("quality"))


# --- opportunities ------------------------------------------------------------

def _detected(spark, d) -> DataFrame:
    return enrichment.analysed_sites(_sites(spark, d))


def _opportunity_table(spark, d) -> DataFrame:
    return opportunities.exploded(_detected(spark, d), "website")


def _rule_query(number, rule):
    QUERIES[f"r{number:02d}_{rule.type}"] = lambda spark, d: _opportunity_table(spark, d).where(
        F.col("type") == rule.type).select(
        "website", "rank", "priority", "score", "impact", "confidence", "solution_fit",
        notes("evidence").alias("evidence"), joined("unknowns").alias("unknowns"))


for _number, _rule in enumerate(opportunities.RULES, 1):
    _rule_query(_number, _rule)


@query("k1_priority_score")
def _(spark, d):
    c = F.col
    lines = tables.table(spark, d, "lineitem")
    clamped = lines.select("l_orderkey", "l_linenumber", (c("l_quantity") * 3 - 20).cast("int").alias("impact"),
                           (c("l_discount") * 1000).cast("int").alias("confidence"),
                           (c("l_tax") * 1200).cast("int").alias("fit"))
    return clamped.select("l_orderkey", "l_linenumber", opportunities.priority_score(
        c("impact"), c("confidence"), c("fit")).alias("score"))


@query("k2_band")
def _(spark, d):
    return _opportunity_table(spark, d).groupBy("type", "priority").agg(F.count(F.lit(1)).alias("sites"))


@query("k3_best_per_type")
def _(spark, d):
    return opportunities.best_per_type(_scored_events(spark, d), "user_id").select("user_id", "type", "score", "rule_no")


def _scored_events(spark, d) -> DataFrame:
    """Events as scored candidates; users have several of one type."""
    c = F.col
    return tables.table(spark, d, "events").select(
        "user_id", c("event_type").alias("type"), (c("value") % 101).cast("int").alias("score"),
        c("event_id").alias("rule_no"))


@query("k4_rank")
def _(spark, d):
    best = opportunities.best_per_type(_scored_events(spark, d), "user_id")
    return opportunities.ranked(best, "user_id").select("user_id", "type", "score", "rank")


@query("k5_page_hints")
def _(spark, d):
    c = F.col
    return _sites(spark, d).select(
        "website", F.coalesce(opportunities.page_hint(c("pages"), "contact"), F.lit("")).alias("contact_page"),
        F.coalesce(opportunities.page_hint(c("pages"), "book", "appointment", "team"), F.lit("")).alias("other_page"))


@query("k6_overall_score")
def _(spark, d):
    b = F.col("score_breakdown")
    return _detected(spark, d).select(
        "website", "opportunity_score", "opportunity_band", F.coalesce(b["top_type"], F.lit("")).alias("top_type"),
        F.coalesce(b["top_opportunity"], F.lit(-1)).alias("top"),
        F.coalesce(b["secondary_opportunity"], F.lit(-1)).alias("second"), b["reason"].alias("reason"))


@query("k6_overall_from_table")
def _(spark, d):
    best = opportunities.best_per_type(_scored_events(spark, d), "user_id")
    return opportunities.overall_score(opportunities.ranked(best, "user_id"), "user_id").select(
        "user_id", "top", F.coalesce("second", F.lit(-1)).alias("second"), "top_type", "score", "band")


@query("k7_outreach_payload")
def _(spark, d):
    out = opportunities.outreach_payload(_detected(spark, d))
    p = F.from_json("payload", "business_name string, industry string, services array<string>, "
                    "opportunity_score int, top_opportunities array<struct<type:string,score:int>>, "
                    f"signals struct<{', '.join(f'{n}:boolean' for n in vocab.SIGNALS)}>, "
                    "signal_evidence map<string,array<struct<code:string,arg:string>>>, website string")
    # Every signal's notes as one text, in the order of the signals.
    told = F.array_join(F.array_compact(F.array(*[
        F.when(F.size(F.col("p.signal_evidence")[n]) > 0, F.concat(F.lit(f"{n}: "), notes(F.col("p.signal_evidence")[n])))
        for n in vocab.SIGNALS])), "; ")
    return out.select("website", p.alias("p")).select(
        "website", "p.business_name", "p.industry", joined("p.services").alias("services"), "p.opportunity_score",
        joined(F.transform("p.top_opportunities", lambda o: F.concat(
            o["type"], F.lit(":"), o["score"].cast("string")))).alias("top"),
        *_signals(F.col("p.signals")), told.alias("evidence"))


# --- lead state and dashboard -------------------------------------------------

def _state(spark, d) -> DataFrame:
    return leads.fold_state(seeding.lead_events(spark, d))


def _flat_state(state) -> DataFrame:
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return state.select("lead_id", "status", dash("website"), dash("company_name"), dash("emails"), dash("phones"),
                        dash("body_text"), dash("opportunity_score"), dash("analysis_json"), "created_at",
                        "updated_at", "last_seq")


def _snapshot(spark, d) -> DataFrame:
    """The folded state with the columns the dashboard shows."""
    return _state(spark, d).withColumn("source_url", F.concat(
        F.lit("https://source"), F.col("lead_id").cast("string"), F.lit(".example.org"))).withColumn("location", F.lit(""))


@query("l01_state_fold")
def _(spark, d):
    return _flat_state(_state(spark, d))


def _enriched(spark, d, use_browser=True) -> DataFrame:
    return enrichment.enrich(seeding.new_leads(spark, d), _links(spark, d), _parsed(spark, d), use_browser)


def _flat_enriched(df) -> DataFrame:
    return df.select("lead_id", "website", "method", "status", joined("emails").alias("emails"),
                     joined("phones").alias("phones"), "business_name", "industry", "opportunity_score",
                     "opportunity_band", joined(F.transform("opportunities", lambda o: o["type"])).alias("types"))


@query("lead_enrichment_in_place")
def _(spark, d):
    store = _page_store(spark, d)
    return _flat_enriched(enrichment.enrich(seeding.new_leads(spark, d), store.links(), store))


@query("l02_final_status")
def _(spark, d):
    return _enriched(spark, d).groupBy("status", "method").agg(F.count(F.lit(1)).alias("leads"))


@query("l02_failed_without_browser")
def _(spark, d):
    return _enriched(spark, d, use_browser=False).select(
        "lead_id", "website", "method", (F.col("status") == "FAILED").alias("failed"))


@query("lead_enrichment")
def _(spark, d):
    return _flat_enriched(_enriched(spark, d))


@query("l03_next_pending")
def _(spark, d):
    return _flat_state(leads.next_pending(_state(spark, d))).select("lead_id", "status", "website")


@query("l04_lead_by_id")
def _(spark, d):
    return _flat_state(leads.by_id(_state(spark, d), 17))


@query("l05_decoded_analysis")
def _(spark, d):
    return dashboard.decode_analysis(_snapshot(spark, d)).select(
        "lead_id", F.col("analysis").isNull().alias("no_analysis"),
        F.coalesce("analysis.business_name", F.lit("-")).alias("business_name"),
        F.coalesce("analysis.opportunity_score_band", F.lit("-")).alias("band"),
        F.coalesce(F.size("analysis.opportunities"), F.lit(-1)).alias("opportunity_count"))


@query("l06_latest_by_website")
def _(spark, d):
    return leads.latest_by_website(_state(spark, d)).select("website", "lead_id", "status")


@query("l07_recent_leads")
def _(spark, d):
    return dashboard.recent(_snapshot(spark, d)).select("lead_id", "status", "source_url", "updated_at")


@query("l08_dashboard_stats")
def _(spark, d):
    return dashboard.stats(_state(spark, d))


@query("l09_dashboard_rows")
def _(spark, d):
    out = dashboard.rows(dashboard.documents(dashboard.recent(_snapshot(spark, d))))
    return out.select(
        "lead_id", "name", "address", "status", F.coalesce("opportunity_score", F.lit(-1)).alias("score"),
        F.coalesce("band", F.lit("-")).alias("band"), joined("contacts").alias("contacts"),
        joined(F.transform("top_opportunities", lambda o: F.concat_ws(
            ":", o["title"], o["score"].cast("string"), o["confidence"].cast("string")))).alias("top"))


@query("l10_fallback_band")
def _(spark, d):
    return _scored_events(spark, d).select(
        F.col("rule_no").alias("event_id"), "score", opportunities.fallback_band(F.col("score")).alias("band"))


@query("l11_lead_detail")
def _(spark, d):
    out = dashboard.detail(dashboard.documents(_snapshot(spark, d)))
    number = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return out.select("lead_id", "name", "address", "status", number("opportunity_score"), "band", "email", "phone",
                      number("top_opportunity"), number("secondary_opportunity"), number("pos"),
                      F.coalesce("type", F.lit("-")).alias("type"), number("score"), number("confidence"))


# --- from pages to the dashboard -------------------------------------------------

def _stored_leads(spark, d) -> DataFrame:
    """Leads finished from pages, stored as events and folded again, with the columns the dashboard shows."""
    new = seeding.new_leads(spark, d)
    events = enrichment.to_events(_enriched(spark, d), F.lit("2024-01-01").cast("timestamp"))
    return leads.fold_state(events).join(new.select("lead_id", "source_url", "location"), "lead_id")


def _evidence(o) -> Column:
    return F.array_join(F.transform(o, lambda e: F.concat(e["code"], F.lit("="), e["arg"])), ",")


@query("a10_analysis_document")
def _(spark, d):
    a = F.col("analysis")
    out = dashboard.decode_analysis(_stored_leads(spark, d))
    return out.select(
        "lead_id", "status", a["url"].alias("url"), a["business_name"].alias("business_name"), a["industry"].alias("industry"),
        joined(a["services"]).alias("services"), a["content_length"].alias("content_length"), a["link_count"].alias("link_count"),
        joined(a["pages_analyzed"]).alias("pages"), F.size(a["page_details"]).alias("details"),
        *_signals(a["signals"]), a["opportunity_score"].alias("score"),
        a["opportunity_score_band"].alias("band"), F.coalesce(a["opportunity_score_breakdown"]["top_type"], F.lit("")).alias("top_type"),
        joined(F.transform(a["opportunities"], lambda o: o["type"])).alias("types"),
        joined(a["business_intelligence"]["business_profile"]["audiences"]).alias("audiences"))


@query("l05_stored_analysis")
def _(spark, d):
    return dashboard.decode_analysis(_stored_leads(spark, d)).select(
        "lead_id", "status", F.coalesce("website", F.lit("-")).alias("website"), F.coalesce("emails", F.lit("-")).alias("emails"),
        F.coalesce("phones", F.lit("-")).alias("phones"), F.coalesce("opportunity_score", F.lit(-1)).alias("score"),
        F.length(F.coalesce("body_text", F.lit(""))).alias("text_chars"),
        F.col("analysis").isNull().alias("no_analysis"), "last_seq")


@query("l09_stored_rows")
def _(spark, d):
    out = dashboard.rows(dashboard.documents(dashboard.recent(_stored_leads(spark, d))))
    return out.select("lead_id", "name", "address", "status", "opportunity_score", "band", joined("contacts").alias("contacts"),
                      joined(F.transform("top_opportunities", lambda o: F.concat(o["type"], F.lit(":"), o["score"]))).alias("top"))


@query("l11_stored_detail")
def _(spark, d):
    out = dashboard.detail(dashboard.documents(_stored_leads(spark, d)))
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return out.select(
        "lead_id", "name", "address", "status", "opportunity_score", "band", "email", "phone", dash("pos"), dash("type"),
        dash("priority"), dash("score"), dash("impact"), dash("confidence"),
        F.coalesce(_evidence("evidence"), F.lit("-")).alias("evidence"),
        (F.length(F.coalesce("recommendation", F.lit(""))) > 0).alias("recommended"))


# --- streams --------------------------------------------------------------------

def _streamed_state(spark, d) -> tuple[str, str, str]:
    """Folders of state changes, payloads and snapshot, from events that arrived in four files."""
    arriving, out, payloads, snapshot = (new_path(spark, n) for n in ("events", "lead-state", "lead-payloads", "lead-snapshot"))
    events = tables.table(spark, d, "events")
    events.repartition(4).write.parquet(arriving)
    stream = seeding.as_lead_events(jobs.file_stream(spark, arriving, events.schema))
    jobs.state_stream(stream, out, new_path(spark, "state-checkpoint")).awaitTermination()
    jobs.payload_stream(stream, payloads, new_path(spark, "payload-checkpoint")).awaitTermination()
    jobs.compact_state(spark, out, snapshot)
    return out, payloads, snapshot


def _page_store(spark, d) -> PageStore:
    """A new store that holds the parsed pages."""
    store = PageStore(spark, new_path(spark, "pages"), buckets=16, splits=4)
    store.append("all", _parsed(spark, d), _links(spark, d))
    return store


def _streamed_leads(spark, d, **options) -> str:
    """Folder of leads finished by the stream, four files in four micro-batches."""
    arriving = seeding.new_leads(spark, d)
    folder, out = (new_path(spark, n) for n in ("arriving", "finished"))
    arriving.repartition(4).write.parquet(folder)
    jobs.enrichment_stream(jobs.file_stream(spark, folder, arriving.schema), _page_store(spark, d), out,
                           new_path(spark, "lead-checkpoint"), **options).awaitTermination()
    return out


def _waited(spark, d) -> WaitingLeads:
    """Leads that came before any page: half the pages arrive by a stream, the others by a batch job, then time passes."""
    at = lambda minutes: F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr(f"interval {minutes} minutes")
    asked = seeding.new_leads(spark, d).withColumn("asked", at(0) + F.make_interval(mins=F.col("lead_id") % 60))
    pages, leads_folder = new_path(spark, "arriving-pages"), new_path(spark, "arriving-leads")
    asked.repartition(2).write.parquet(leads_folder)
    store = PageStore(spark, new_path(spark, "pages"), buckets=16, splits=4)
    service = WaitingLeads(store, new_path(spark, "service"), patience="6 hours")
    service.intake_stream(jobs.file_stream(spark, leads_folder, asked.schema), new_path(spark, "intake-checkpoint")).awaitTermination()
    captures = seeding.captures(spark, d)
    early = (F.xxhash64("url") % 2) == 0  # all captures of an address together
    captures.where(early).repartition(2).write.parquet(pages)
    jobs.parse_stream(jobs.file_stream(spark, pages, captures.schema, files=2), store, new_path(spark, "parse-checkpoint"), sources=False,
                      arrived=at(90)).awaitTermination()
    store.append("rest", enrichment.parsed_captures(captures.where(~early)), enrichment.parsed_sources(seeding.seeded_pages(spark, d)), at(120))
    checkpoint = new_path(spark, "waiting-checkpoint")
    for round_ in range(3):  # arrivals, addresses that source pages named anew, and those whose time is over
        service.waiting_stream(checkpoint).awaitTermination()
        service.tick(str(round_), at(600 + 600 * round_))
    service.waiting_stream(checkpoint).awaitTermination()
    service.finish_overdue(at(5000), "overdue")
    return service


@query("t1_pages_after_leads")
def _(spark, d):
    return _flat_enriched(_waited(spark, d).finished())


@query("t1_streamed_enrichment")
def _(spark, d):
    return _flat_enriched(spark.read.parquet(_streamed_leads(spark, d)))


@query("t1_rejects")
def _(spark, d):
    rejects = new_path(spark, "rejects")
    _streamed_leads(spark, d, use_browser=False, rejects=rejects)
    return spark.read.parquet(rejects).select("lead_id", "website", "reason")


@query("s2_refused_captures")
def _(spark, d):
    return enrichment.refused_captures(seeding.captures(spark, d)).where("page_id >= 0")


@query("t2_streamed_state")
def _(spark, d):
    out, payloads, snapshot = _streamed_state(spark, d)
    return _flat_state(jobs.current_state(spark, out, payloads, snapshot))


@query("t3_live_stats")
def _(spark, d):
    return jobs.live_stats(spark, _streamed_state(spark, d)[0])


@query("l03_stored_pending")
def _(spark, d):
    return _flat_state(jobs.next_pending(spark, *_streamed_state(spark, d))).select("lead_id", "status", "website")


@query("l04_stored_lead")
def _(spark, d):
    return _flat_state(jobs.lead_by_id(spark, *_streamed_state(spark, d), 17))
