"""DuckDB query per registered name, put together from the common table expressions."""

import re

from leadloom.functions import vocab
from oracle import leads as L
from oracle import pages as P
from oracle.pages import q

CTES = {**P.CTES, **L.CTES}
FEATS = list(vocab.FEATURES)


def full(select: str, websites: str = "newweb") -> str:
    """``select`` with every common table expression it needs, in order."""
    ctes = {n: s.replace("WEBSITES", websites) for n, s in CTES.items()}
    ctes["newweb"] = "SELECT DISTINCT source_url AS website FROM newleads"
    needed, queue = [], [select]
    while queue:
        text = queue.pop()
        for name in ctes:
            if name not in needed and re.search(rf"(?:FROM|JOIN) {name}\b", text):
                needed.append(name)
                queue.append(ctes[name])
    order, seen = [], set()

    def visit(name):
        if name in seen:
            return
        seen.add(name)
        for other in needed:
            if other != name and re.search(rf"(?:FROM|JOIN) {other}\b", ctes[name]):
                visit(other)
        order.append(name)

    for name in needed:
        visit(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in order)
    return f"WITH {head}\n{select}" if head else select


def lst(c):
    return f"array_to_string({c}, '|')"


SEED = "WHERE src = 'seed'"
dash = lambda c: f"coalesce({c}::VARCHAR, '-') AS {c}"
STATE = ("lead_id, status, " + ", ".join(dash(c) for c in ("website", "company_name", "emails", "phones", "body_text",
         "opportunity_score", "analysis_json")) + ", created_at, updated_at, last_seq")
STATS = ("count(*) AS total, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'PROCESSING') AS processing, "
         "count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed, "
         "count(*) FILTER (WHERE opportunity_score >= 80) AS high_opportunity, round_even(avg(opportunity_score), 1) AS average_score")
NAME = "coalesce(nullif(company_name, ''), nullif(doc->>'$.business_name', ''), 'Unknown') AS name"
BAND4 = "CASE WHEN {0} >= 80 THEN 'high' WHEN {0} >= 60 THEN 'medium' WHEN {0} >= 40 THEN 'low' ELSE 'weak' END"
SHOWN = ("coalesce(nullif(doc->>'$.opportunity_score_band', ''), " + BAND4.format("coalesce(opportunity_score, 0)") + ")")
DONE = (f"SELECT lead_id, website, method, status, {lst('emails')} AS emails, {lst('phones')} AS phones, business_name, industry, "
        "score AS opportunity_score, band AS opportunity_band, types FROM done")
SITE_SIGNALS = ", ".join("services_sig AS services" if n == "services" else n for n in vocab.SIGNALS)


def queries() -> dict[str, str]:
    out = {
        "s1_link_intake": """SELECT 100 + row_number() OVER (ORDER BY page_id, i) AS lead_id, link AS source_url, 'PENDING' AS status FROM (
            SELECT page_id, i, trim(raw, ' ' || chr(9)) AS link FROM (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (
            SELECT page_id, string_split('  ' || url || ' ' || chr(10) || chr(10) || array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), chr(10))
            || chr(10) || 'httpx://odd' || page_id || chr(10) || 'HTTP://UPPER' || chr(10) || chr(9) || url, chr(10)) AS l FROM pages))) WHERE starts_with(link, 'http')""",
        "s2_crawl_admission": """SELECT page_id, status_code, CASE WHEN url = '' THEN 'empty_url' WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_scheme'
            WHEN status_code >= 400 THEN 'http_error' WHEN kind NOT LIKE '%text/html%' AND kind NOT LIKE '%application/xhtml+xml%' THEN 'not_html' ELSE 'ok' END AS verdict
            FROM (SELECT page_id, CASE page_id % 17 WHEN 2 THEN '' WHEN 3 THEN 'ftp://' || url ELSE url END AS url,
            CASE page_id % 11 WHEN 4 THEN 404 WHEN 5 THEN 503 WHEN 6 THEN 399 ELSE 200 END AS status_code,
            CASE page_id % 7 WHEN 1 THEN 'application/xhtml+xml' WHEN 2 THEN 'application/pdf' WHEN 3 THEN '' ELSE 'text/html; charset=utf-8' END AS kind FROM seeded)""",
        "s3_page_source": "SELECT page_id, url, length(html)::INT AS html_chars FROM pages",
        "s4_manual_upsert": f"""SELECT lead_id, action, coalesce(company_name, '') AS company_name, source_url, website, status, {lst('emails')} AS emails,
            {lst('phones')} AS phones, body_text FROM manual_out""",
        "s4_manual_rejects": f"""SELECT seq, CASE WHEN trim(url) = '' THEN 'url_required' ELSE 'html_required' END AS error FROM manual
            WHERE trim(url) = '' OR {P.strip('html')} = ''""",
        "s5_report_append": "SELECT * FROM report",
        "s5_report_update": """SELECT * FROM report WHERE lead_id NOT IN (SELECT lead_id FROM manual_out) UNION ALL
            SELECT lead_id, coalesce(nullif(company_name, ''), 'Unknown'), source_url, website, array_to_string(emails, ', '), array_to_string(phones, ', '),
            status, '', '' FROM manual_out""",
        "s6_snapshot_columns": """SELECT lead_id, coalesce(company_name, '-') AS company_name, source_url, '-' AS opportunity_score FROM newleads UNION ALL
            SELECT lead_id + 1000000000, coalesce(company_name, '-'), '-', coalesce(opportunity_score::VARCHAR, '-') FROM state""",
        "p01_html_quality": f"""SELECT page_id, reason = 'ok' AS usable, reason, CASE WHEN reason IN ('empty', 'small_html') THEN 0 ELSE length(plain_text) END::INT AS text_length,
            CASE WHEN reason = 'empty' THEN 0 ELSE length(html) END::INT AS html_length FROM quality {SEED}""",
        "p02_visible_text": f"SELECT page_id, text FROM texts {SEED}",
        "p03_raw_text": f"SELECT page_id, lower(raw_text) AS raw_text FROM texts {SEED}",
        "p04_title": f"SELECT page_id, title FROM heads {SEED}",
        "p05_meta_description": f"SELECT page_id, description FROM heads {SEED}",
        "p06_schema_types": f"SELECT page_id, {lst('schema_types')} AS schema_types FROM heads {SEED}",
        "p07_anchors": f"SELECT page_id, (count(*) OVER (PARTITION BY page_id))::INT AS link_count, pos::INT AS pos, href, text FROM anchors {SEED}",
        "p08_mailto_emails": f"SELECT page_id, {lst('hi')} AS emails FROM emails {SEED}",
        "p09_scanned_emails": f"SELECT d.page_id, {lst('coalesce(s.l, [])')} AS emails FROM docs d LEFT JOIN scanned s USING (src, page_id) {SEED}",
        "p10_obfuscated_emails": f"SELECT d.page_id, {lst('coalesce(s.l, [])')} AS emails FROM docs d LEFT JOIN hidden s USING (src, page_id) {SEED}",
        "p11_email_validity": f"""SELECT DISTINCT origin, id, email, {P.valid_email('email')} AS valid FROM (SELECT origin, id, lower(unnest(regexp_extract_all(body, {q(P.EMAIL)}))) AS email
            FROM (SELECT 'page' AS origin, page_id AS id, html AS body FROM seeded UNION ALL SELECT 'document', doc_id, text FROM documents))""",
        "p12_ordered_contacts": f"SELECT page_id, {lst('emails')} AS emails, {lst('phones')} AS phones FROM emails JOIN phones USING (src, page_id) {SEED}",
        "p13_tel_phones": f"SELECT d.page_id, {lst('coalesce(s.l, [])')} AS phones FROM docs d LEFT JOIN tels s USING (src, page_id) {SEED}",
        "p14_text_phones": f"SELECT d.page_id, {lst('coalesce(s.l, [])')} AS phones FROM docs d LEFT JOIN textphones s USING (src, page_id) {SEED}",
        "p14_document_phones": f"""SELECT doc_id, {lst("list_sort(list_distinct(coalesce(list(p) FILTER (WHERE NOT " + P.toll_free('p') + "), [])))")} AS phones
            FROM (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS p FROM (SELECT doc_id, {P.text_phones('text')} AS l FROM documents)) GROUP BY doc_id""",
        "p15_toll_free": f"""SELECT DISTINCT page_id, phone, {P.toll_free('phone')} AS toll_free FROM (SELECT page_id, unnest({P.text_phones('text')}) AS phone FROM texts {SEED})""",
        "p16_form_details": f"""SELECT f.page_id, g.form_count, f.pos::INT AS pos, f.action, {lst('f.fields')} AS fields, f.text FROM forms f JOIN formflags g USING (src, page_id)
            WHERE f.src = 'seed' AND f.pos < 5""",
        "p17_lead_form": f"SELECT page_id, lead_form FROM feats {SEED}",
        "p18_keyword_features": f"SELECT page_id, {', '.join(FEATS)} FROM feats {SEED}",
        "p19_cta_count": f"SELECT page_id, cta_count FROM feats {SEED}",
        "p20_page_job": f"""SELECT f.page_id, k.reason, length(t.text)::INT AS text_chars, {lst('e.emails')} AS emails, {lst('p.phones')} AS phones, f.form_count, f.lead_form,
            {', '.join('f.' + n for n in FEATS)}, f.cta_count FROM feats f JOIN quality k USING (src, page_id) JOIN texts t USING (src, page_id)
            JOIN emails e USING (src, page_id) JOIN phones p USING (src, page_id) WHERE f.src = 'seed' AND k.reason <> 'empty'""",
        "p20_page_rejects": f"SELECT page_id, 'empty_html' AS error FROM seeded WHERE {P.strip('html')} = ''",
        "w1_domains": f"""SELECT page_id, url, {P.netloc('url')} AS netloc, {P.site_domain('url')} AS site_domain, {P.bare_domain('url')} AS bare_domain
            FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM seeded)""",
        "w2_resolved_links": f"SELECT page_id, pos::INT AS pos, {P.resolved('url', 'h')} AS resolved FROM (SELECT *, trim(href) AS h FROM anchors {SEED})",
        "w3_subpages": f"SELECT page_id, (rank - 1)::INT AS rank, full_url AS subpage FROM subpages {SEED}",
        "w4_requested_pages": """SELECT website, mode, rank::INT AS rank, url, 'http' AS channel, ok::VARCHAR AS usable FROM answers WHERE over_http
            UNION ALL SELECT a.website, a.mode, a.rank::INT, a.url, 'browser', c.usable::VARCHAR FROM answers a JOIN caps c ON c.url = a.url AND c.channel = 'browser'
            UNION ALL SELECT website, mode, rank::INT, url, 'missing', '-' FROM answers WHERE NOT over_http AND NOT in_browser""",
        "w5_site_merge": f"SELECT website, text, {lst('emails')} AS emails, {lst('phones')} AS phones, {lst('pages')} AS pages FROM sites",
        "w5_page_details": f"""SELECT website, (row_number() OVER (PARTITION BY website ORDER BY rank) - 1)::INT AS pos, url, lead_form, booking, {lst('emails')} AS emails,
            {lst('phones')} AS phones, substr(text, 1, 500) AS text_preview FROM parts""",
        "w6_method": "SELECT website, method, len(pages)::INT AS page_count FROM sites",
        "w6_method_without_browser": """SELECT h.website, CASE h.mode WHEN 'http' THEN 'http' ELSE 'failed' END AS method,
            (count(*) FILTER (WHERE h.mode = 'http' AND a.ok))::INT AS page_count FROM homes h JOIN answers a USING (website) GROUP BY h.website, h.mode""",
        "w7_directories": f"SELECT lead_id, source_url, {P.any_of(P.bare_domain('source_url'), vocab.DIRECTORY_DOMAINS)} AS is_directory FROM newleads",
        "w8_official_website": "SELECT lead_id, source_url, website FROM located",
        "a01_feature_rollup": "SELECT website, " + ", ".join(f"any_{n} AS {n}" for n in ["lead_form", *FEATS]) + " FROM sites",
        "a02_signals": f"SELECT website, {SITE_SIGNALS} FROM site_an".replace("site_an", "site_sig"),
        "a02_page_signals": f"SELECT website, {SITE_SIGNALS} FROM page_sig",
        "a03_text_form": "SELECT website, text_form FROM site_sig",
        "a04_contact_signal": "SELECT website, contact_page FROM site_sig",
        "a05_contact_presence": "SELECT website, email, phone, len(emails)::INT AS email_count, len(phones)::INT AS phone_count FROM site_sig",
        "a06_signal_evidence": f"SELECT * FROM ({L.note_list('site')})",
        "a06_page_evidence": f"SELECT * FROM ({L.note_list('page')})",
        "a07_business_name": f"SELECT website, {L.NAME} AS business_name FROM site_an",
        "a08_industry": "SELECT website, industry FROM site_an",
        "a09_services": f"SELECT website, {lst('services')} AS services FROM site_an",
        "a10_site_analysis": f"SELECT website, {L.NAME} AS business_name, industry, {lst('services')} AS services, length(nt)::INT AS content_length, link_count, {lst('pages')} AS pages FROM site_an",
        "a10_page_analysis": f"""SELECT a.website, {L.NAME} AS business_name, industry, {lst('services')} AS services, title, description, {lst('schema_types')} AS schema_types,
            length(nt)::INT AS content_length, link_count, o.score AS opportunity_score, o.band AS opportunity_band FROM page_an a JOIN page_score o USING (website)""",
        "a11_audiences": f"SELECT website, {lst('audiences')} AS audiences FROM site_an",
        "a12_workflows": f"SELECT website, {lst('workflows')} AS workflows FROM site_an",
        "a13_capabilities": f"SELECT website, {lst('capabilities')} AS capabilities, {lst(L.PATHS)} AS conversion_paths FROM site_an",
        "a14_unknown_workflows": f"SELECT website, {lst(L.UNKNOWN)} AS unknown_workflows FROM site_an",
        "a15_customer_journey": f"SELECT website, {lst(L.JOURNEY)} AS journey FROM site_an",
        "a16_data_quality": f"SELECT website, {L.QUALITY} AS score, nt <> '' AS text_present, len(pages)::INT AS pages_analyzed, len(capabilities)::INT AS signal_count FROM site_an",
        "a17_business_intelligence": f"""SELECT website, 'phase4-v2' AS analysis_version, industry, {lst('audiences')} AS audiences, {lst(L.JOURNEY)} AS journey,
            {lst('capabilities')} AS capabilities, {lst('workflows')} AS workflows, {lst('services')} AS services, {lst(L.UNKNOWN)} AS unknowns, {L.QUALITY} AS quality FROM site_an""",
        "k1_priority_score": """SELECT l_orderkey, l_linenumber, round_even(greatest(0, least(100, i))::DOUBLE * 0.45::DOUBLE + greatest(0, least(100, c))::DOUBLE * 0.30::DOUBLE
            + greatest(0, least(100, f))::DOUBLE * 0.25::DOUBLE, 0)::INT AS score FROM (SELECT l_orderkey, l_linenumber, trunc(l_quantity * 3 - 20)::INT AS i,
            trunc(l_discount * 1000)::INT AS c, trunc(l_tax * 1200)::INT AS f FROM lineitem)""",
        "k2_band": "SELECT type, priority, count(*) AS sites FROM site_opps GROUP BY ALL",
        "k3_best_per_type": "SELECT user_id, type, score, rule_no FROM best",
        "k4_rank": "SELECT user_id, type, score, rank FROM best_ranked",
        "k5_page_hints": f"""SELECT website, coalesce({L.hint('contact')}, '') AS contact_page, coalesce({L.hint('book', 'appointment', 'team')}, '') AS other_page FROM sites""",
        "k6_overall_score": """SELECT website, score AS opportunity_score, band AS opportunity_band, coalesce(top_type, '') AS top_type, coalesce(top, -1) AS top,
            coalesce(second, -1) AS second, CASE WHEN top IS NULL THEN 'no_opportunity' ELSE 'strongest_opportunity' END AS reason FROM site_score""",
        "k6_overall_from_table": f"""SELECT user_id, top, coalesce(second, -1) AS second, top_type, score, {L.bands('score')} AS band FROM (SELECT *,
            round_even(top::DOUBLE * 0.75::DOUBLE + coalesce(second::DOUBLE * 0.25::DOUBLE, 0), 0)::INT AS score FROM (SELECT user_id, max(score) FILTER (WHERE rank = 1) AS top,
            max(score) FILTER (WHERE rank = 2) AS second, max(type) FILTER (WHERE rank = 1) AS top_type FROM best_ranked GROUP BY user_id))""",
        "k7_outreach_payload": f"""SELECT a.website, {L.NAME} AS business_name, industry, {lst('services')} AS services, o.score AS opportunity_score, o.top3 AS top,
            {', '.join('services_sig AS services_signal' if n == 'services' else n for n in vocab.SIGNALS)}, coalesce(n.evidence, '') AS evidence FROM site_an a JOIN site_score o USING (website) LEFT JOIN (
                SELECT website, string_agg(signal || ': ' || notes, '; ' ORDER BY list_position([{', '.join(q(n) for n in vocab.SIGNALS)}], signal)) AS evidence
                FROM ({L.note_list('site')}) WHERE notes <> '' GROUP BY website) n USING (website) WHERE o.top IS NOT NULL""",
        "a10_analysis_document": f"""SELECT d.lead_id, d.status, d.website AS url, d.business_name, d.industry, {lst('a.services')} AS services,
            length(a.nt)::INT AS content_length, a.link_count, {lst('a.pages')} AS pages, len(a.pages)::INT AS details, {', '.join('a.services_sig AS services_signal' if n == 'services' else f'a.{n}' for n in vocab.SIGNALS)},
            d.score, d.band, coalesce(o.top_type, '') AS top_type, d.types, {lst('a.audiences')} AS audiences
            FROM done d JOIN site_an a USING (website) JOIN site_score o USING (website)""",
        "l05_stored_analysis": """SELECT lead_id, status, website, array_to_string(emails, ', ') AS emails, array_to_string(phones, ', ') AS phones, score,
            length(text)::INT AS text_chars, false AS no_analysis, lead_id * 5 + 4 AS last_seq FROM done""",
        "l09_stored_rows": f"""SELECT d.lead_id, coalesce(nullif(d.company_name, ''), nullif(d.business_name, ''), 'Unknown') AS name, d.website AS address, d.status,
            d.score AS opportunity_score, d.band, array_to_string(list_filter([array_to_string(d.emails, ', '), array_to_string(d.phones, ', ')], lambda x: x <> ''), '|') AS contacts,
            coalesce(t.top, '') AS top FROM done d LEFT JOIN (SELECT website, string_agg(type || ':' || score, '|' ORDER BY rank) FILTER (WHERE rank <= 4) AS top
                FROM site_opps GROUP BY website) t USING (website) ORDER BY d.lead_id DESC LIMIT 100""",
        "l11_stored_detail": f"""SELECT d.lead_id, coalesce(nullif(d.company_name, ''), nullif(d.business_name, ''), 'Unknown') AS name, d.website AS address, d.status,
            d.score AS opportunity_score, d.band, coalesce(nullif(array_to_string(d.emails, ', '), ''), 'Not found') AS email,
            coalesce(nullif(array_to_string(d.phones, ', '), ''), 'Not found') AS phone, {', '.join(f"coalesce({e}::VARCHAR, '-') AS {n}" for n, e in (
                ('pos', '(o.rank - 1)'), ('type', 'o.type'), ('priority', 'o.priority'), ('score', 'o.score'), ('impact', 'o.impact'), ('confidence', 'o.confidence'),
                ('evidence', "replace(o.evidence, '|', ',')")))}, o.type IS NOT NULL AS recommended
            FROM done d LEFT JOIN site_opps o USING (website)""",
        "l01_state_fold": f"SELECT {STATE} FROM state",
        "l02_final_status": "SELECT status, method, count(*) AS leads FROM done GROUP BY ALL",
        "l02_failed_without_browser": """SELECT l.lead_id, CASE WHEN l.website = 'NOT_FOUND' OR h.mode = 'http' THEN l.website ELSE 'ERROR' END AS website,
            CASE WHEN l.website = 'NOT_FOUND' THEN 'none' WHEN h.mode = 'http' THEN 'http' ELSE 'failed' END AS method,
            l.website <> 'NOT_FOUND' AND h.mode <> 'http' AS failed FROM located l LEFT JOIN homes h USING (website)""",
        "lead_enrichment": DONE,
        "lead_enrichment_in_place": DONE,
        "t1_pages_after_leads": DONE,
        "l03_next_pending": f"SELECT lead_id, status, {dash('website')} FROM state WHERE status = 'PENDING' ORDER BY lead_id LIMIT 1",
        "l04_lead_by_id": f"SELECT {STATE} FROM state WHERE lead_id = 17",
        "l05_decoded_analysis": """SELECT lead_id, doc IS NULL AS no_analysis, coalesce(doc->>'$.business_name', '-') AS business_name,
            coalesce(doc->>'$.opportunity_score_band', '-') AS band, coalesce(json_array_length(doc, '$.opportunities'), -1)::INT AS opportunity_count FROM decoded""",
        "l06_latest_by_website": "SELECT website, max(lead_id) AS lead_id, arg_max(status, lead_id) AS status FROM state WHERE website IS NOT NULL GROUP BY website",
        "l07_recent_leads": "SELECT lead_id, status, source_url, updated_at FROM decoded ORDER BY lead_id DESC LIMIT 100",
        "l08_dashboard_stats": f"SELECT {STATS} FROM state",
        "l09_dashboard_rows": f"""SELECT lead_id, {NAME}, coalesce(nullif(website, ''), source_url) AS address, status, coalesce(opportunity_score, -1) AS score,
            CASE WHEN opportunity_score IS NULL THEN '-' ELSE {SHOWN} END AS band, coalesce(array_to_string([nullif(emails, ''), nullif(phones, '')], '|'), '') AS contacts,
            coalesce(array_to_string(list_transform(from_json(doc->'$.opportunities', '["json"]')[1:4], lambda o: (o->>'$.title') || ':' || (o->>'$.score') || ':' || (o->>'$.confidence')), '|'), '') AS top
            FROM decoded ORDER BY lead_id DESC LIMIT 100""",
        "l10_fallback_band": f"SELECT rule_no AS event_id, score, {BAND4.format('score')} AS band FROM scored",
        "l11_lead_detail": f"""SELECT lead_id, {NAME}, coalesce(nullif(website, ''), source_url) AS address, status, coalesce(opportunity_score, -1) AS opportunity_score, {SHOWN} AS band,
            coalesce(nullif(emails, ''), 'Not found') AS email, coalesce(nullif(phones, ''), 'Not found') AS phone,
            coalesce((doc->>'$.opportunity_score_breakdown.top_opportunity')::INT, -1) AS top_opportunity,
            coalesce((doc->>'$.opportunity_score_breakdown.secondary_opportunity')::INT, -1) AS secondary_opportunity,
            coalesce(i - 1, -1)::INT AS pos, coalesce(o->>'$.type', '-') AS type, coalesce((o->>'$.score')::INT, -1) AS score, coalesce((o->>'$.confidence')::INT, -1) AS confidence
            FROM (SELECT *, unnest(CASE WHEN len(l) > 0 THEN l ELSE [NULL] END) AS o, unnest(CASE WHEN len(l) > 0 THEN range(1, len(l) + 1) ELSE [NULL] END) AS i
                  FROM (SELECT *, coalesce(from_json(doc->'$.opportunities', '["json"]'), []) AS l FROM decoded))""",
        "t1_streamed_enrichment": DONE,
        "t1_rejects": """SELECT l.lead_id, l.website, 'no_page' AS reason FROM located l LEFT JOIN homes h USING (website)
            WHERE l.website <> 'NOT_FOUND' AND h.mode <> 'http'""",
        "s2_refused_captures": """SELECT page_id, url, 'http' AS channel, CASE WHEN page_id % 29 = 9 THEN 'http_error' ELSE 'not_html' END AS verdict
            FROM docs WHERE src = 'seed' AND page_id % 23 <> 6 AND (page_id % 29 = 9 OR page_id % 31 = 12)""",
        "l03_stored_pending": f"SELECT lead_id, status, {dash('website')} FROM state WHERE status = 'PENDING' ORDER BY lead_id LIMIT 1",
        "l04_stored_lead": f"SELECT {STATE} FROM state WHERE lead_id = 17",
        "t2_streamed_state": f"SELECT {STATE} FROM state",
        "t3_live_stats": f"SELECT {STATS} FROM state",
    }
    kinds = ["appointment_lifecycle", "inquiry_conversion", "consultation_conversion", "intake_coordination", "audience_routing", "recruitment_workflow",
             "membership_conversion", "retention_reactivation", "reputation_follow_up", "commerce_lifecycle", "conversion_path"]
    for n, kind in enumerate(kinds, 1):
        out[f"r{n:02d}_{kind}"] = (f"SELECT website, rank, priority, score, impact, confidence, fit AS solution_fit, evidence, unknowns "
                                   f"FROM site_opps WHERE type = '{kind}'")
    out["s1_streamed_intake"], out["s5_report_in_place"] = out["s1_link_intake"], out["s5_report_update"]
    leads_first = {"s5_report_in_place", "t1_rejects", "a10_analysis_document", "l05_stored_analysis", "l09_stored_rows", "l11_stored_detail", "lead_enrichment", "l02_final_status", "l02_failed_without_browser", "s5_report_append", "s5_report_update", "t1_streamed_enrichment", "lead_enrichment_in_place", "t1_pages_after_leads"}
    return {n: full(s, "located" if n in leads_first else "newweb") for n, s in out.items()}
