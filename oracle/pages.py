"""DuckDB side, part one: the test view, page parsing and sites.

Written on its own from the operator descriptions.  Only fixed lists (words, seed
snippets) are shared with the Spark side, as data.
"""

from leadloom.functions import vocab
from leadloom.sources import seeding


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def count_of(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, {q(w)})::INT" for w in words) + ")"


WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{2000}-\x{200A}\x{3000}]"
WSM = r"[\s\x01\x{000B}\x{0085}\x{00A0}\x{2000}-\x{200A}\x{3000}]"
INSIDE = r"""(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*"""
TAG = rf"<[!?/a-zA-Z]{INSIDE}>"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def rx(column, pattern, by):
    return f"regexp_replace({column}, {q(pattern)}, {by}, 'g')"


def unentity(x):
    for name, char in (("&nbsp;", "chr(160)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&eacute;", "'é'"),
                       ("&ndash;", "'–'"), ("&#64;", "'@'"), ("&#0000000064;", "'@'"), ("&#150;", "'–'"), ("&#39;", "''''"), ("&lt;", "'<'"), ("&gt;", "'>'"),
                       ("&quot;", "'\"'"), ("&amp;", "'&'")):
        x = f"replace({x}, {q(name)}, {char})"
    return x


def strip(x):
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def marks(x):
    return rx(x, TAG, "chr(1)")


def flat(x):
    return f"trim({rx(unentity(marks(x)), WSM + '+', q(' '))})"


def nodes(x):
    inner = rx(unentity(marks(x)), rf"{WS}*\x01{WSM}*", q(" "))
    return strip(inner)


def attr(tag, name):
    v = f"regexp_extract({tag}, {q(rf'''(?is)^<[a-z]+(?:[^>]*?\s){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)''')}, 1)"
    return unentity(rx(v, "^[\"']|[\"']$", "''"))


def origin(b):
    return (f"(CASE {b} % 3 WHEN 0 THEN 'https://www.site' || ({b}) || '.example.net' "
            f"WHEN 1 THEN 'http://Site' || ({b}) || '.example.org' "
            f"ELSE 'https://site' || ({b}) || '.example.net:8443' END)")


def home(b):
    return f"({origin(b)} || CASE WHEN {b} % 2 = 0 THEN '/' ELSE '/home/index.html' END)"


PAGE_URL = (f"(CASE page_id % 5 WHEN 0 THEN {home('(page_id // 5)')} WHEN 1 THEN {origin('(page_id // 5)')} || '/contact-us' "
            f"WHEN 2 THEN {origin('(page_id // 5)')} || '/about' WHEN 3 THEN {origin('(page_id // 5)')} || '/people/team.html' "
            f"ELSE {origin('(page_id // 5)')} || '/services?ref=nav' END)")


def filled(x):
    for mark, value in (("{id4}", "lpad((page_id % 10000)::VARCHAR, 4, '0')"), ("{id}", "page_id::VARCHAR"),
                        ("{origin}", origin("(page_id // 5)")),
                        ("{host}", f"regexp_replace({origin('(page_id // 5)')}, '^[a-z]+://', '')"),
                        ("{next}", home("(page_id // 5 + 1)"))):
        x = f"replace({x}, {q(mark)}, {value})"
    return x


def resolved(base, href):
    """Absolute address of href on base."""
    root = f"regexp_extract({base}, '^([a-zA-Z]+://[^/?#]*)', 1)"
    path = f"regexp_extract({base}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
    folder = f"regexp_replace(CASE {path} WHEN '' THEN '/' ELSE {path} END, '[^/]*$', '')"
    own = f"regexp_extract({href}, '^([^?#]*)', 1)"
    tail = f"regexp_extract({href}, '^[^?#]*(.*)$', 1)"

    def dots(p):
        p = f"replace({p}, '/./', '/')"
        p = f"regexp_replace({p}, '/[^/.]+/\\.\\./', '/')"
        return f"regexp_replace({p}, '^/\\.\\./', '/')"
    return (f"(CASE WHEN {href} = '' THEN {base} WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^([a-zA-Z]+:)', 1) || {href} "
            f"WHEN starts_with({href}, '#') THEN regexp_replace({base}, '#.*$', '') || {href} "
            f"WHEN starts_with({href}, '?') THEN {root} || {path} || {href} "
            f"WHEN starts_with({href}, '/') THEN {root} || {dots(own)} || {tail} "
            f"ELSE {root} || {dots(f'{folder} || {own}')} || {tail} END)")


def netloc(u):
    return f"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def site_domain(u):
    return f"regexp_replace({netloc(u)}, '^www\\.', '')"


def bare_domain(u):
    return f"replace({netloc(u)}, 'www.', '')"


def valid_email(e):
    domain = f"split_part({e}, '@', 2)"
    ghost = " OR ".join(f"{domain} = {q(g)} OR ends_with({domain}, {q('.' + g)})" for g in vocab.GHOST_DOMAINS)
    return (f"(length({e}) - length(replace({e}, '@', '')) = 1 AND split_part({e}, '@', 1) <> '' "
            f"AND contains({domain}, '.') AND NOT ({ghost}))")


def toll_free(p):
    digits = rx(p, "[^0-9]", "''")
    return (f"(SELECT length(n) >= 10 AND substr(n, 1, 3) IN ('800','833','844','855','866','877','888') FROM "
            f"(SELECT CASE WHEN length(dd) = 11 AND starts_with(dd, '1') THEN substr(dd, 2) ELSE dd END AS n "
            f"FROM (SELECT {digits} AS dd)))")


def text_phones(x):
    """Digit runs are fenced first, since RE2 cannot look around."""
    fenced = rx(x, "([0-9]+)", r"chr(1) || '\1' || chr(1)")
    pattern = (r"((?:\+?\x011\x01?[\s.-]?\(?\x01?|\(?\x01)\d{3}\x01?\)?[\s.-]?\x01?\d{3}\x01?[\s.-]?\x01?\d{4})\x01")
    return (f"list_transform(regexp_extract_all({fenced}, {q(pattern)}, 1), lambda x: replace(x, chr(1), ''))")


SEED_ROWS = ", ".join(f"({i}, {m}, {r}, {q(t)})" for i, (m, r, t) in enumerate(seeding.SEEDS))
NAV_ROWS = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(seeding.NAVIGATION))
H = "(?is)"

CTES = {
    "seeds": f"SELECT * FROM (VALUES {SEED_ROWS}) t(ord, m, r, snippet)",
    "navs": f"SELECT * FROM (VALUES {NAV_ROWS}) t(n, nav)",
    "extra": """SELECT p.page_id, coalesce(string_agg(s.snippet, '' ORDER BY s.ord), '') AS snippets
        FROM pages p LEFT JOIN seeds s ON p.page_id % s.m = s.r GROUP BY p.page_id""",
    "seeded": f"""SELECT page_id, {PAGE_URL} AS url,
        CASE WHEN page_id % 31 = 5 THEN ' ' || chr(10) || ' ' || chr(9) || ' '
             WHEN page_id % 37 = 7 THEN {filled(q(seeding.SMALL_PAGE))}
             WHEN page_id % 41 = 6 THEN {filled(q(seeding.THIN_PAGE))}
             ELSE replace(html, '</footer>', {filled("(snippets || CASE WHEN page_id % 5 = 0 THEN nav ELSE '' END)")} || '</footer>')
        END AS html
        FROM pages JOIN extra USING (page_id) JOIN navs ON n = (page_id // 5) % 4""",
    "docs": f"""SELECT 'seed' AS src, page_id, url, html FROM seeded
        UNION ALL SELECT 'browser', page_id, {PAGE_URL}, replace(html, '</footer>',
            '<p>Seen in a browser. Contact us. Book now.</p>' || {filled(q(seeding.NAVIGATION[0]))} || '</footer>')
            FROM pages WHERE page_id % 3 <> 1
        UNION ALL SELECT 'raw', page_id, {PAGE_URL}, html FROM pages WHERE page_id % 5 = 2""",
    "d0": "SELECT *, " + rx(rx(rx(rx("html", H + "<!--.*?-->", "chr(1)"),
                                  H + r"<script\b[^>]*>.*?</script\s*>", "chr(1)"),
                               H + r"<style\b[^>]*>.*?</style\s*>", "chr(1)"),
                            H + r"<template\b[^>]*>.*?</template\s*>", "chr(1)") + " AS base FROM docs",
    "d1": "SELECT *, " + rx(rx("base", H + r"<noscript\b[^>]*>.*?</noscript\s*>", "chr(1)"),
                            H + r"<svg\b[^>]*>.*?</svg\s*>", "chr(1)") + " AS plain FROM d0",
    "d2": "SELECT *, " + rx(rx(rx("plain", H + r"<iframe\b[^>]*>.*?</iframe\s*>", "chr(1)"),
                               H + r"<div\b[^>]*style=\"[^\">]*display: *none[^>]*>.*?</div>", "chr(1)"),
                            r'(?s)<span aria-hidden="true">.*?</span>|<p style="display:none">.*?</div>', "chr(1)") + " AS shown FROM d1",
    "texts": f"SELECT *, {flat('shown')} AS text, {flat('plain')} AS plain_text, {nodes('base')} AS raw_text FROM d2",
    "quality": "SELECT src, page_id, CASE WHEN " + strip("html") + " = '' THEN 'empty' WHEN length(html) < 500 THEN 'small_html' "
        + " ".join(f"WHEN contains(lower(plain_text), {q(p)}) THEN {q('blocked: ' + p)}" for p in vocab.BLOCK_PHRASES)
        + " WHEN length(plain_text) < 100 THEN 'little_text' ELSE 'ok' END AS reason, plain_text, html FROM texts",
    "anchors0": f"""SELECT src, page_id, url, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT src, page_id, url,
        regexp_extract_all(base, {q(H + rf"<a(?:\s{INSIDE})?>.*?</a>")}) AS l FROM d0)""",
    "anchors": f"SELECT src, page_id, url, pos, a, {attr('a', 'href')} AS href, {nodes('a')} AS text FROM anchors0",
    "mailto": f"""SELECT src, page_id, list_sort(list_distinct(list(e))) AS l FROM (SELECT src, page_id,
        lower({strip("split_part(substr(" + strip('href') + ", 8), '?', 1)")}) AS e FROM anchors
        WHERE starts_with(lower({strip('href')}), 'mailto:')) WHERE {valid_email('e')} GROUP BY ALL""",
    "scanned": f"""SELECT src, page_id, list_sort(list_distinct(list(e))) AS l FROM (SELECT src, page_id, lower(unnest(list_concat(
        regexp_extract_all(html, {q(EMAIL)}), regexp_extract_all({unentity("array_to_string(regexp_extract_all(base, " + q(TAG) + "), ' ')")}, {q(EMAIL)})))) AS e
        FROM d0) WHERE {valid_email('e')} GROUP BY ALL""",
    "hidden": f"""SELECT src, page_id, list_sort(list_distinct(list(e))) AS l FROM (SELECT src, page_id,
        lower(regexp_replace(unnest(regexp_extract_all({unentity('html')}, {q(r'(?i)[a-z0-9._%+-]+\s*(?:\[at\]|\(at\)|\sat\s)\s*[a-z0-9.-]+\s*(?:\[dot\]|\(dot\)|\sdot\s)[a-z]{2,}')})),
        {q(r'(?i)^([a-z0-9._%+-]+)\s*(?:\[at\]|\(at\)|\sat\s)\s*([a-z0-9.-]+)\s*(?:\[dot\]|\(dot\)|\sdot\s)([a-z]{2,})$')}, {q(r'\1@\2.\3')})) AS e
        FROM docs) WHERE {valid_email('e')} GROUP BY ALL""",
    "emails": """SELECT t.src, t.page_id, coalesce(m.l, []) AS hi, list_sort(list_distinct(list_filter(
            list_concat(coalesce(s.l, []), coalesce(h.l, [])), lambda x: NOT list_contains(coalesce(m.l, []), x)))) AS lo,
            list_concat(coalesce(m.l, []), list_sort(list_distinct(list_filter(
            list_concat(coalesce(s.l, []), coalesce(h.l, [])), lambda x: NOT list_contains(coalesce(m.l, []), x))))) AS emails
        FROM docs t LEFT JOIN mailto m USING (src, page_id) LEFT JOIN scanned s USING (src, page_id) LEFT JOIN hidden h USING (src, page_id)""",
    "tels": f"""SELECT src, page_id, list_sort(list_distinct(list(p))) AS l FROM (SELECT src, page_id, {strip("substr(" + strip('href') + ", 5)")} AS p FROM
        (SELECT src, page_id, {attr('a', 'href')} AS href FROM (SELECT src, page_id, unnest(regexp_extract_all(shown, {q(H + r'<a\s[^>]*>')})) AS a FROM d2))
        WHERE starts_with(lower({strip('href')}), 'tel:')) WHERE p <> '' AND NOT {toll_free('p')} GROUP BY ALL""",
    "textphones": f"""SELECT src, page_id, list_sort(list_distinct(list(p))) AS l FROM (SELECT src, page_id, unnest({text_phones('text')}) AS p FROM texts)
        WHERE NOT {toll_free('p')} GROUP BY ALL""",
    "phones": """SELECT d.src, d.page_id, list_concat(coalesce(t.l, []), list_sort(list_filter(coalesce(x.l, []),
            lambda e: NOT list_contains(coalesce(t.l, []), e)))) AS phones
        FROM docs d LEFT JOIN tels t USING (src, page_id) LEFT JOIN textphones x USING (src, page_id)""",
    "forms0": f"""SELECT src, page_id, unnest(l) AS f, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT src, page_id,
        regexp_extract_all(base, {q(H + r'<form\b[^>]*>.*?</form>')}) AS l FROM d0)""",
    "forms": f"""SELECT src, page_id, pos, {attr('f', 'action')} AS action, substr({nodes('f')}, 1, 300) AS text,
        list_filter(list_transform(regexp_extract_all(f, {q(H + r'<(?:input|textarea|select)(?:\s[^>]*)?>')}), lambda t: substr(trim(
            {attr('t', 'name')} || ' ' || {attr('t', 'id')} || ' ' || {attr('t', 'placeholder')} || ' ' || {attr('t', 'aria-label')}), 1, 120)),
            lambda v: v <> '') AS fields FROM forms0""",
    "formflags": f"""SELECT src, page_id, count(*)::INT AS form_count, bool_or(len(fields) >= 2 OR {any_of('lower(text)', vocab.FORM_ACTION_WORDS)}) AS good
        FROM forms GROUP BY ALL""",
    "ctas": f"""SELECT src, page_id, count(*)::INT AS n FROM (SELECT src, page_id, lower(text) AS t FROM anchors UNION ALL
        SELECT src, page_id, lower({nodes('b')}) FROM (SELECT src, page_id, unnest(regexp_extract_all(base, {q(H + r'<button\b[^>]*>.*?</button>')})) AS b FROM d0))
        WHERE {any_of('t', vocab.CTA_WORDS)} GROUP BY ALL""",
    "feats": "SELECT t.src, t.page_id, coalesce(f.form_count, 0) AS form_count, coalesce(c.n, 0) AS cta_count, "
        + f"coalesce(f.good, false) OR ({count_of('lower(raw_text)', vocab.FORM_FIELD_WORDS)} >= 2 AND {any_of('lower(raw_text)', vocab.FORM_ACTION_WORDS)}) AS lead_form, "
        + ", ".join(f"{any_of('hay', w)} AS {n}" for n, w in vocab.FEATURES.items())
        + """ FROM (SELECT *, lower(html) || ' ' || lower(raw_text) AS hay FROM texts) t
        LEFT JOIN formflags f USING (src, page_id) LEFT JOIN ctas c USING (src, page_id)""",
    "sublinks": f"""SELECT src, page_id, full_url, arg_max(prio, pos) AS prio FROM (
        SELECT src, page_id, url, pos, {resolved('url', 'h')} AS full_url,
            CASE WHEN contains(lower(h || ' ' || text), 'contact') THEN 0 WHEN contains(lower(h || ' ' || text), 'about') THEN 1
                 WHEN contains(lower(h || ' ' || text), 'team') THEN 2 WHEN contains(lower(h || ' ' || text), 'service') THEN 3 END AS prio
        FROM (SELECT *, {strip('href')} AS h FROM anchors)
        WHERE h <> '' AND NOT (starts_with(h, '#') OR starts_with(h, 'mailto:') OR starts_with(h, 'tel:') OR starts_with(h, 'javascript:')))
        WHERE prio IS NOT NULL AND {site_domain('full_url')} = {site_domain('url')} GROUP BY ALL""",
    "subpages": """SELECT src, page_id, full_url, rank FROM (SELECT *, row_number() OVER (PARTITION BY src, page_id ORDER BY prio, full_url) AS rank
        FROM sublinks) WHERE rank <= 3""",
    "jsonld": f"""SELECT src, page_id, unnest(CASE json_type(j) WHEN 'ARRAY' THEN from_json(j, '["json"]') ELSE [j::JSON] END) AS item FROM (SELECT src, page_id,
        unnest(regexp_extract_all(html, {q(H + r'<script type="application/ld\+json">(.*?)</script>')}, 1)) AS j FROM docs) WHERE json_valid(j)""",
    # --- leads and sites ---
    "newleads": f"""SELECT page_id + 1 AS lead_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Company ' || page_id END AS company_name,
        CASE page_id % 2 WHEN 0 THEN 'North' ELSE '' END AS location,
        CASE WHEN page_id % 19 = 3 THEN 'https://www.LinkedIn.com/company/' || page_id WHEN page_id % 23 = 4 THEN 'Manual HTML'
             WHEN page_id % 29 = 8 THEN 'http://missing' || page_id || '.example.org/' ELSE {PAGE_URL} END AS source_url FROM pages""",
    "outlinks": f"""SELECT page_id, url, pos, href, trim({rx(unentity(rx(rx('a', TAG, "''"), r'\x01', "''")), WS + '+', q(' '))}) AS t,
        {attr('a', 'data-testid')} AS testid FROM anchors WHERE src = 'seed'""",
    "exits": f"""SELECT url, arg_min(href, k) AS official FROM (SELECT url, href, pos + 100000 * CASE
            WHEN contains(lower(t), 'visit website') THEN 0 WHEN contains(lower(t), 'business website') THEN 1
            WHEN contains(lower(t), 'official site') THEN 2 WHEN contains(lower(t), 'website') THEN 3
            WHEN contains(href, 'biz_redir') THEN 4 WHEN testid = 'bizWebsiteLink' THEN 5 END AS k FROM outlinks
            WHERE regexp_matches(href, '^https?://') AND {bare_domain('href')} <> '' AND {bare_domain('href')} <> {bare_domain('url')}
              AND NOT contains({bare_domain('href')}, 'google.com')) WHERE k IS NOT NULL GROUP BY url""",
    "located": f"""SELECT n.*, CASE WHEN NOT regexp_matches(n.source_url, '^https?://') THEN 'NOT_FOUND'
        WHEN {any_of(bare_domain('n.source_url'), vocab.DIRECTORY_DOMAINS)} THEN 'UNSCRAPABLE'
        ELSE coalesce(x.official, n.source_url) END AS website FROM newleads n LEFT JOIN exits x ON x.url = n.source_url""",
    "caps": """SELECT 'http' AS channel, d.src, d.page_id, d.url, q.reason = 'ok' AS usable FROM docs d JOIN quality q USING (src, page_id)
        WHERE d.src = 'seed' AND d.page_id % 23 <> 6 AND d.page_id % 29 <> 9 AND d.page_id % 31 <> 12
        UNION ALL SELECT 'browser', d.src, d.page_id, d.url, q.reason = 'ok' FROM docs d JOIN quality q USING (src, page_id) WHERE d.src = 'browser'""",
    # WEBSITES is replaced by the table of websites a query starts from.
    "homes": """SELECT w.website, CASE WHEN h.usable THEN 'http' WHEN b.url IS NOT NULL THEN 'browser' ELSE 'none' END AS mode,
        CASE WHEN h.usable THEN 'seed' ELSE b.src END AS src, CASE WHEN h.usable THEN h.page_id ELSE b.page_id END AS page_id
        FROM (SELECT DISTINCT website FROM WEBSITES) w LEFT JOIN caps h ON h.url = w.website AND h.channel = 'http'
        LEFT JOIN caps b ON b.url = w.website AND b.channel = 'browser'""",
    "requests": """SELECT website, mode, 0 AS rank, website AS url FROM homes UNION ALL
        SELECT h.website, h.mode, s.rank, s.full_url FROM homes h JOIN subpages s USING (src, page_id)""",
    "answers": """SELECT r.website, r.mode, r.rank, r.url, h.url IS NOT NULL AS over_http, coalesce(h.usable, false) AS ok, b.url IS NOT NULL AS in_browser,
        h.page_id AS hp, b.page_id AS bp FROM requests r LEFT JOIN caps h ON h.url = r.url AND h.channel = 'http'
        LEFT JOIN caps b ON b.url = r.url AND b.channel = 'browser'""",
    "picked": """SELECT website, mode, rank, url, src, page_id, src = 'browser' AS helped FROM (SELECT *,
            CASE WHEN mode = 'http' AND ok THEN 'seed' WHEN in_browser AND (mode = 'browser' OR (mode = 'http' AND over_http)) THEN 'browser' END AS src,
            CASE WHEN mode = 'http' AND ok THEN hp ELSE bp END AS page_id FROM answers) WHERE src IS NOT NULL""",
    "parts": """SELECT p.*, t.text, e.emails, ph.phones, f.* EXCLUDE (src, page_id) FROM picked p JOIN texts t USING (src, page_id)
        JOIN emails e USING (src, page_id) JOIN phones ph USING (src, page_id) JOIN feats f USING (src, page_id)""",
    "sites": """SELECT h.website, h.mode, CASE h.mode WHEN 'http' THEN CASE WHEN bool_or(p.helped) THEN 'http+playwright' ELSE 'http' END
            ELSE 'playwright' END AS method,
        coalesce(substr(string_agg(p.text, ' ' ORDER BY p.rank) FILTER (WHERE p.text <> ''), 1, 15000), '') AS text,
        list_sort(list_distinct(coalesce(flatten(list(p.emails) FILTER (WHERE p.url IS NOT NULL)), []))) AS emails,
        list_sort(list_distinct(coalesce(flatten(list(p.phones) FILTER (WHERE p.url IS NOT NULL)), []))) AS phones,
        coalesce(list(p.url ORDER BY p.rank) FILTER (WHERE p.url IS NOT NULL), []) AS pages, """
        + ", ".join(f"coalesce(bool_or(p.{n}), false) AS any_{n}" for n in ["lead_form", *vocab.FEATURES]) + ", "
        + ", ".join(f"coalesce(list(p.url ORDER BY p.rank) FILTER (WHERE p.{n}), []) AS pages_{n}" for n in ["lead_form", *vocab.FEATURES])
        + " FROM homes h LEFT JOIN parts p USING (website) GROUP BY h.website, h.mode",
}
