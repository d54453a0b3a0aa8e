"""DuckDB side, part two: analysis, opportunities, lead state and dashboard."""

from leadloom.functions import vocab
from oracle.pages import EMAIL, H, WS, any_of, attr, count_of, q, rx, strip, unentity

PHONE_ANY = r"(?:^|[^0-9])\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}(?:[^0-9]|$)"
FEATS = list(vocab.FEATURES)


def cases(pairs, other="NULL"):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def names(pairs):
    """List of the names whose condition holds, in order."""
    inner = ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for n, c in pairs)
    return f"list_filter([{inner}], lambda x: x IS NOT NULL)"


def flow(n):
    return f"list_contains(workflows, '{n}')"


def group(n):
    return f"list_contains(audiences, '{n}')"


TITLED = ("array_to_string(list_transform(regexp_extract_all(label, '[A-Za-z]+|[^A-Za-z]+'), "
          "lambda w: upper(w[1]) || lower(w[2:])), '')")
LABEL = (r"translate(split_part(regexp_replace(split_part(list_last(string_split(website, '//')), '/', 1), '^www\.', ''), '.', 1), '-_', '  ')")


def analysis(kind):
    """CTEs <kind>_sig and <kind>_an over <kind>_in."""
    site = kind == "site"
    feature = (lambda n: f"CASE WHEN len(pages) > 0 THEN any_{n} ELSE {any_of('alltext', vocab.FEATURES[n])} END") if site \
        else (lambda n: any_of("alltext", vocab.FEATURES[n]))
    contact_url = "len(list_filter(pages, lambda p: contains(lower(p), '/contact') OR contains(lower(p), 'contact-us'))) > 0"
    sig = f"""SELECT *,
        {any_of('low', vocab.CONTACT_WORDS)} OR {contact_url} AS contact_page,
        {', '.join(f'{feature(n)} AS {n}' for n in FEATS)},
        {'any_lead_form OR ' if site else ''}has_form OR text_form AS lead_form,
        has_tel OR regexp_matches(low, {q(PHONE_ANY)}) OR len(phones) > 0 AS phone,
        regexp_matches(alltext, {q(EMAIL)}) OR len(emails) > 0 AS email,
        {any_of('alltext', vocab.SERVICE_SIGNAL_WORDS)} AS services_sig
        FROM (SELECT *, {count_of('low', vocab.TEXT_FORM_FIELD_WORDS)} >= 2 AND {any_of('low', vocab.TEXT_FORM_ACTION_WORDS)} AS text_form
              FROM (SELECT *, lower(nt) AS low, CASE WHEN html = '' THEN lower(nt) ELSE lower(html) || ' ' || lower(nt) END AS alltext
                    FROM (SELECT *, trim({rx('text', WS + '+', q(' '))}) AS nt FROM {kind}_in)))"""
    value = "lower(nt || ' ' || array_to_string(schema_types, ' '))"
    an = f"""SELECT *, {TITLED.replace('label', '(' + LABEL + ')')} AS host_name,
        {cases([(any_of(value, w), q(n)) for n, w in vocab.INDUSTRIES.items()], "'unknown'")} AS industry,
        {names([(s, f"contains(low, {q(s)})") for s in vocab.SERVICES])} AS services,
        {names([(g, any_of('low', w)) for g, w in vocab.AUDIENCES.items()])} AS audiences,
        {names([(g, any_of('low', w)) for g, w in vocab.WORKFLOWS.items()])} AS workflows,
        {names([(n, 'services_sig' if n == 'services' else n) for n in vocab.SIGNALS])} AS capabilities,
        regexp_extract(nt, {q("(?i)(?:welcome to|about)" + chr(92) + "s+([A-Z][A-Za-z0-9 &'.,-]{2,60})")}, 1) AS named,
        trim(regexp_split_to_array(title, {q(chr(92) + 's+[|–-]' + chr(92) + 's+')})[1]) AS head
        FROM {kind}_sig"""
    return {f"{kind}_sig": sig, f"{kind}_an": an}


NAME = "CASE WHEN head <> '' THEN head WHEN named <> '' THEN trim(named, ' .,') ELSE host_name END"


def some(cond, items):
    return f"CASE WHEN {cond} THEN [{', '.join(map(q, items))}] ELSE [] END"


UNKNOWN = "list_concat(" + ", ".join([
    some("booking", ["confirmation", "reminders", "rescheduling", "no_show_recovery"]),
    some(f"lead_form OR {flow('consultation')}", ["response_routing", "qualification", "follow_up"]),
    some(f"{flow('intake')} OR {flow('referral')}", ["document_collection", "handoffs", "status_updates"]),
    some(f"{flow('recruitment')} OR {group('employees')}", ["applicant_screening", "interview_scheduling", "candidate_follow_up"]),
    some(f"{flow('membership')} OR {group('members')}", ["onboarding", "retention", "billing_workflow"])]) + ")"
JOURNEY = names([
    ("discover", "true"), ("audience_route", "len(audiences) >= 2"), ("inquire", "phone OR email OR lead_form"),
    ("referral", flow("referral")), ("consultation", flow("consultation")), ("book", "booking"),
    ("intake", flow("intake")), ("membership", flow("membership")),
    ("ongoing_follow_up", f"{flow('follow_up')} OR {flow('recall')}"), ("review", "reviews")])
QUALITY = ("least(100, 25 + 5 * len(capabilities) + CASE WHEN text <> '' THEN 20 ELSE 0 END + least(20, 4 * len(pages)))::INT")
PATHS = names([("appointment_or_consultation", "booking"), ("inquiry_form", "lead_form"), ("phone", "phone"),
               ("email", "email"), ("live_chat", "live_chat"), ("transaction", "ecommerce")])


def hint(*words):
    return f"list_filter(pages, lambda p: {any_of('lower(p)', words)})[1]"


HC = "industry = 'healthcare'"
DIRECT = "CASE WHEN email OR phone THEN 'direct_contact=' END"


def rule(n, kind, fires, impact, confidence, fit, evidence, unknowns, source):
    return (f"SELECT website, {n} AS rule_no, '{kind}' AS type, {impact} AS impact, {confidence} AS confidence, {fit} AS fit, "
            f"array_to_string([{', '.join(evidence)}], '|') AS evidence, '{unknowns}' AS unknowns FROM {source} WHERE {fires}")


def rules(source):
    book, contact = hint("book", "appointment", "schedule"), hint("contact")
    return " UNION ALL ".join([
        rule(1, "appointment_lifecycle", "booking", f"CASE WHEN {HC} THEN 90 ELSE 82 END",
             f"CASE WHEN {book} IS NULL THEN 76 ELSE 82 END", 92,
             ["'booking_visible='", f"'booking_page=' || {book}", f"CASE WHEN {HC} THEN 'healthcare_model=' END", DIRECT],
             "reminder_automation|scheduling_integration", source),
        rule(2, "inquiry_conversion", "lead_form", 87, f"CASE WHEN {contact} IS NULL THEN 77 ELSE 84 END", 94,
             ["'form_visible='", f"'contact_page=' || {contact}", DIRECT], "inquiry_routing", source),
        rule(3, "consultation_conversion", f"{flow('consultation')} AND NOT lead_form AND NOT booking", 84, 78, 93,
             ["'consultation_described='"], "consultation_process", source),
        rule(4, "intake_coordination", f"{flow('intake')} OR {flow('referral')}", f"CASE WHEN {HC} THEN 91 ELSE 84 END", 83, 96,
             [f"CASE WHEN {flow('intake')} THEN 'intake_described=' END", f"CASE WHEN {flow('referral')} THEN 'referral_described=' END"],
             "intake_ownership", source),
        rule(5, "audience_routing", "len(audiences) >= 2", 88, 85, 95,
             ["'audiences=' || array_to_string(audiences, ', ')", f"CASE WHEN {group('referrers')} THEN 'referrers_addressed=' END"],
             "routing_rules", source),
        rule(6, "recruitment_workflow", f"{flow('recruitment')} OR {group('employees')}", 78, 80, 88,
             ["'recruitment_visible='"], "applicant_tracking", source),
        rule(7, "membership_conversion", f"{flow('membership')} OR {group('members')}", 89, 84, 94,
             ["'membership_visible='"], "membership_systems", source),
        rule(8, "retention_reactivation", f"{flow('follow_up')} OR {flow('recall')}", 86, 79, 92,
             [f"CASE WHEN {flow('follow_up')} THEN 'follow_up_described=' END", f"CASE WHEN {flow('recall')} THEN 'recall_described=' END"],
             "recall_process", source),
        rule(9, "reputation_follow_up", "reviews AND NOT review_cta AND (booking OR lead_form OR services_sig)", 65, 68, 86,
             ["'reviews_visible='", "'no_review_request='"], "review_requests", source),
        rule(10, "commerce_lifecycle", "ecommerce", 80, 82, 82, ["'transaction_visible='"], "commerce_systems", source),
        rule(11, "conversion_path", "contact_page AND NOT lead_form AND NOT booking AND NOT ecommerce AND (services_sig OR phone OR email)",
             72, 88, 84, ["'contact_visible='", "'no_conversion_path='"], "other_conversion_paths", source)])


def bands(score, last="low"):
    return f"CASE WHEN {score} >= 80 THEN 'high' WHEN {score} >= 60 THEN 'medium' ELSE '{last}' END"


def opportunity_tables(kind):
    score = "round_even(impact::DOUBLE * 0.45::DOUBLE + confidence::DOUBLE * 0.30::DOUBLE + fit::DOUBLE * 0.25::DOUBLE, 0)::INT"
    total = "round_even(top::DOUBLE * 0.75::DOUBLE + coalesce(second::DOUBLE * 0.25::DOUBLE, 0), 0)::INT"
    return {
        f"{kind}_opps": f"""SELECT *, row_number() OVER (PARTITION BY website ORDER BY score DESC, rule_no)::INT AS rank, {bands('score')} AS priority
            FROM (SELECT *, {score} AS score FROM ({rules(kind + '_an')}))""",
        f"{kind}_score": f"""SELECT a.website, o.top, o.second, o.top_type, o.types, o.top3, coalesce({total}, 0) AS score,
            CASE WHEN o.top IS NULL THEN 'weak' ELSE {bands(total)} END AS band FROM {kind}_an a LEFT JOIN (
            SELECT website, max(score) FILTER (WHERE rank = 1) AS top, max(score) FILTER (WHERE rank = 2) AS second,
                max(type) FILTER (WHERE rank = 1) AS top_type, string_agg(type, '|' ORDER BY rank) AS types,
                string_agg(type || ':' || score, '|' ORDER BY rank) FILTER (WHERE rank <= 3) AS top3
            FROM {kind}_opps GROUP BY website) o USING (website)""",
    }


def note_list(kind):
    """website, signal, notes rows."""
    site = kind == "site"
    three = lambda n, code: (f"list_transform(pages_{n}[1:3], lambda p: '{code}=' || p)" if site else "[]::VARCHAR[]")
    first = "list_transform(list_filter(pages, lambda p: contains(lower(p), 'contact'))[1:1], lambda p: 'contact_page=' || p)"
    rows = [("contact_page", f"list_concat(['contact_content='], {first})", "contact_page"),
            ("booking", f"list_concat(['booking_capability='], {three('booking', 'booking_page')})", "booking"),
            ("lead_form", f"list_concat({three('lead_form', 'form_page')}, CASE WHEN has_form THEN ['html_form='] ELSE [] END, "
                          "CASE WHEN text_form THEN ['text_form='] ELSE [] END)", "lead_form"),
            ("phone", "['phone_signals=' || greatest(len(phones), 1)]", "phone"),
            ("email", "['email_signals=' || greatest(len(emails), 1)]", "email"),
            ("services", "['detected=']", "services_sig")]
    rows += [(n, f"list_concat(['detected='], {three(n, 'feature_page')})", n) for n in FEATS if n != "booking"]
    return " UNION ALL ".join(f"SELECT website, '{n}' AS signal, array_to_string({v}, '|') AS notes FROM {kind}_an WHERE {c}"
                              for n, v, c in rows)


E_ITEMS = " || ".join(
    "CASE WHEN value > {} THEN ',{}' ELSE '' END".format(b, '{"type":"%s","title":"%s","score":%d,"confidence":%d}' % row)
    for b, *row in [(b, *r) for b, r in [
        (2, ("intake_coordination", "Intake", 90, 83)), (6, ("audience_routing", "Routing", 89, 85)),
        (12, ("inquiry_conversion", "Inquiries", 88, 84)), (20, ("recruitment_workflow", "Hiring", 81, 80)),
        (30, ("reputation_follow_up", "Reviews", 71, 68))]] for row in [tuple(row)])

LAST = "arg_max({{'v': {0}}}, seq) FILTER (WHERE {1})"


def last(value, cond):
    return "(arg_max({'v': %s}, seq) FILTER (WHERE %s)).v" % (value, cond)


CTES = {
    "site_in": """SELECT *, '' AS html, '' AS title, '' AS description, []::VARCHAR[] AS schema_types, 0 AS link_count,
        false AS has_form, false AS has_tel FROM sites""",
    "types": """SELECT src, page_id, list_sort(list_distinct(list(t))) AS schema_types FROM (SELECT src, page_id,
            unnest(CASE json_type(item, '$."@type"') WHEN 'ARRAY' THEN from_json(item->'$."@type"', '["varchar"]')
                WHEN 'VARCHAR' THEN [item->>'$."@type"'] ELSE [] END) AS t FROM jsonld) GROUP BY ALL""",
    "metas": f"""SELECT src, page_id, first(c ORDER BY i) AS description FROM (SELECT src, page_id, i, {strip(attr('m', 'content'))} AS c FROM
        (SELECT src, page_id, unnest(l) AS m, generate_subscripts(l, 1) AS i FROM (SELECT src, page_id, regexp_extract_all(base, {q(H + r'<meta\s[^>]*>')}) AS l FROM d0))
        WHERE lower({attr('m', 'name')}) = 'description') GROUP BY ALL""",
    "heads": f"""SELECT d.src, d.page_id, {strip(unentity("regexp_extract(d.base, " + q(H + '<title[^>]*>(.*?)</title') + ", 1)"))} AS title,
        coalesce(m.description, '') AS description, coalesce(t.schema_types, []) AS schema_types, coalesce(a.n, 0)::INT AS link_count,
        coalesce(a.tel, false) AS has_tel FROM d0 d LEFT JOIN metas m USING (src, page_id) LEFT JOIN types t USING (src, page_id)
        LEFT JOIN (SELECT src, page_id, count(*) AS n, bool_or(starts_with(lower(href), 'tel:')) AS tel FROM anchors GROUP BY ALL) a USING (src, page_id)""",
    "page_in": """SELECT t.url AS website, t.raw_text AS text, t.html, []::VARCHAR[] AS pages, []::VARCHAR[] AS emails, []::VARCHAR[] AS phones,
        h.title, h.description, h.schema_types, h.link_count, h.has_tel, coalesce(f.form_count, 0) > 0 AS has_form
        FROM texts t JOIN heads h USING (src, page_id) LEFT JOIN formflags f USING (src, page_id) WHERE t.src = 'seed'""",
    **analysis("site"), **analysis("page"), **opportunity_tables("site"), **opportunity_tables("page"),
    "done": f"""SELECT l.lead_id, coalesce(l.company_name, '') AS company_name, l.location, l.source_url, l.website,
        CASE WHEN l.website = 'NOT_FOUND' THEN 'none' ELSE s.method END AS method,
        CASE WHEN len(s.emails) = 0 AND len(s.phones) = 0 THEN 'MISSING_DATA' ELSE 'COMPLETED' END AS status,
        s.emails, s.phones, s.text, {NAME.replace('head', 'a.head').replace('named', 'a.named').replace('host_name', 'a.host_name')} AS business_name,
        a.industry, o.score, o.band, coalesce(o.types, '') AS types
        FROM located l JOIN sites s USING (website) JOIN site_an a USING (website) JOIN site_score o USING (website)""",
    "report": """SELECT lead_id, coalesce(nullif(company_name, ''), nullif(business_name, ''), 'Unknown') AS company, source_url AS source, website,
        array_to_string(emails, ', ') AS emails, array_to_string(phones, ', ') AS phones, status,
        CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS text, score::VARCHAR AS score FROM done""",
    # --- manual pages ---
    "manual": f"""SELECT page_id * 2 AS seq, CASE WHEN page_id % 13 = 1 THEN '  ' ELSE ' ' || url || ' ' END AS url, html, 'seed' AS src, page_id FROM seeded
        UNION ALL SELECT page_id * 2 + 1, url, html, src, page_id FROM docs WHERE src = 'raw'""",
    "manual_sites": f"""SELECT trim(url) AS website, min(seq) AS first_seq, arg_max(src, seq) AS src, arg_max(page_id, seq) AS page_id
        FROM manual WHERE trim(url) <> '' AND {strip('html')} <> '' GROUP BY 1""",
    "manual_done": """SELECT m.website, m.first_seq, e.emails, p.phones, t.text AS body_text,
        CASE WHEN len(e.emails) = 0 AND len(p.phones) = 0 THEN 'MISSING_DATA' ELSE 'COMPLETED' END AS status, k.lead_id, k.company_name, k.source_url
        FROM manual_sites m JOIN emails e USING (src, page_id) JOIN phones p USING (src, page_id) JOIN texts t USING (src, page_id)
        LEFT JOIN (SELECT website, max(lead_id) AS lead_id, arg_max({'v': company_name}, lead_id).v AS company_name, arg_max(source_url, lead_id) AS source_url
                   FROM located GROUP BY website) k USING (website)""",
    "manual_out": """SELECT lead_id, 'update' AS action, company_name, source_url, website, status, emails, phones, body_text FROM manual_done WHERE lead_id IS NOT NULL
        UNION ALL SELECT (SELECT max(lead_id) FROM located) + row_number() OVER (ORDER BY first_seq), 'insert', 'Unknown', 'Manual HTML', website, status,
            emails, phones, body_text FROM manual_done WHERE lead_id IS NULL""",
    # --- lead state ---
    "changes": f"""SELECT event_id AS seq, user_id AS lead_id, ts, kind,
        CASE WHEN kind <> 'status' THEN NULL WHEN event_type = 'error' THEN 'FAILED'
             ELSE ['PENDING', 'PROCESSING', 'ENRICHED', 'COMPLETED', 'MISSING_DATA'][event_id % 5 + 1] END AS status,
        CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'click' AND event_id % 2 = 0
             THEN 'https://firm' || (user_id % 97) || '.example.org' END AS website,
        CASE WHEN event_type = 'view' AND event_id % 9 = 0 THEN '' WHEN event_type = 'view' AND event_id % 4 = 1 THEN 'Firm ' || user_id END AS company_name,
        CASE WHEN kind = 'scraped' THEN CASE WHEN event_id % 3 <> 0 THEN 'a' || user_id || '@firm.org, b@firm.org' ELSE '' END END AS emails,
        CASE WHEN kind = 'scraped' THEN CASE WHEN event_id % 5 = 0 THEN '310-555-' || lpad(user_id::VARCHAR, 4, '0') WHEN event_id % 5 <> 1 THEN '' END END AS phones,
        CASE WHEN kind = 'scraped' THEN repeat('text ' || event_id || ' ', (event_id % 90)::INT) END AS body_text,
        CASE WHEN kind = 'analysis' THEN score END AS score,
        CASE WHEN kind <> 'analysis' THEN NULL WHEN event_id % 7 = 0 THEN '{{broken' WHEN event_id % 11 = 0 THEN ''
             ELSE '{{"business_name":"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Studio ' || user_id END || '",'
                || CASE WHEN event_id % 4 <> 0 THEN '"opportunity_score_band":"high",' ELSE '' END
                || '"opportunity_score_breakdown":{{"top_opportunity":' || score || ',"secondary_opportunity":null}},"opportunities":['
                || substr({E_ITEMS}, 2) || ']}}' END AS analysis_json
        FROM (SELECT *, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'status' WHEN event_type = 'purchase' THEN 'scraped' ELSE 'analysis' END AS kind,
              CASE WHEN event_id % 13 <> 0 THEN trunc(value % 101)::INT END AS score FROM events)""",
    "state": f"""SELECT lead_id, coalesce({last('status', "kind = 'status'")}, 'PENDING') AS status,
        {last('website', "kind = 'status' AND website IS NOT NULL")} AS website,
        {last('company_name', "kind = 'status' AND company_name IS NOT NULL")} AS company_name,
        {last('emails', "kind = 'scraped'")} AS emails, {last('phones', "kind = 'scraped'")} AS phones,
        {last('body_text', "kind = 'scraped'")} AS body_text, {last('score', "kind = 'analysis'")} AS opportunity_score,
        {last('analysis_json', "kind = 'analysis'")} AS analysis_json, min(ts) AS created_at, arg_max(ts, seq) AS updated_at, max(seq) AS last_seq
        FROM changes GROUP BY lead_id""",
    "decoded": """SELECT *, 'https://source' || lead_id || '.example.org' AS source_url,
        CASE WHEN analysis_json <> '' AND json_valid(analysis_json) THEN analysis_json::JSON END AS doc FROM state""",
    "scored": """SELECT user_id, event_type AS type, trunc(value % 101)::INT AS score, event_id AS rule_no FROM events""",
    "best": """SELECT user_id, type, score, rule_no FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY score DESC, rule_no) AS k
        FROM scored) WHERE k = 1""",
    "best_ranked": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rule_no)::INT AS rank FROM best",
}
