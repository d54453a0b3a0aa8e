"""Test views over the given tables.

The raw ``pages`` mention none of the words this engine looks for, so the checked
queries run on the whole table with short snippets added by rule: every page is
used, and the work grows with it.  Blocks of five consecutive page ids form a site
(home page, contact, about, team, services) whose addresses follow from the id, so
building the view needs no shuffle.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.sources import tables
from leadloom.sources.tables import table

#: The given pages are one file of one row group; the test view deals them out, by their number.  Real tables have many files.
SPLITS = 16
SPLIT_ROWS = 2000

# (modulus, remainder, html): added to pages with page_id % modulus = remainder.
# {id} is the page id, {id4} its last four digits, {origin} scheme and host of the
# page's site, {next} the home page of the next site.
SEEDS = [
    (3, 0, "<p>Contact us or get in touch with our office.</p>"),
    (7, 1, '<a class="btn" href="/book">Book <b>online</b></a>'),
    (11, 3, "<p>Make an appointment today.</p>"),
    (6, 1, '<form action="/ask" method="post"><select name="branch" aria-label="Nearest branch"></select>'
           "<input type='tel' id='callback' placeholder='Number for a call back'><input name=\"arrival\">"
           '<textarea placeholder="What can we do?"></textarea><button>Contact the desk</button></form>'),
    (13, 2, '<form action="/find?a=1&amp;b=2"><input name=q id="news" aria-label="Search &quot;x&quot;">'
            "<input type=hidden value=1><button>Go</button></form>"),
    (17, 4, "<form></form><form></form><form></form><form></form><form></form>"
            '<form action="/six"><select name="topic" id="t"></select><input name="when">'
            "<button>Request a call</button></form>"),
    (19, 5, "<p>Full name please, then contact us.</p>"),
    (5, 2, '<a href="mailto:Info{id}@Firm{id}.org?subject=Hi">Mail</a>'),
    (23, 1, '<a href="MAILTO: a@firm{id}.org,b@firm{id}.org ">Two</a>'),
    (9, 4, "<p>Write to office{id}@practice{id}.net or hello@studio{id}.co.uk.</p>"),
    (14, 3, "<p>desk{id} [at] bureau{id} [dot]org, not front{id} (at) bureau{id} (dot) org, "
            "but crew{id} at bureau{id} dot net</p>"),
    (21, 8, '<p>x@sub.google.com</p><img src="logo@2x.png" alt="logo">'),
    (15, 7, '<img alt="hid&#64;attr{id}.org"><p>i&#64;text{id}.org &amp;lt; &eacute;&nbsp;&ndash;</p>'),
    (4, 1, "<p>Call (310) 555-{id4} or 310.555.{id4}</p>"),
    (9, 2, '<a href="tel:+1-310-555-{id4}">Call now</a>'),
    (12, 5, '<a href="tel:1-800-555-{id4}">Free</a><a href=tel:911>911</a><p>888-555-1234 '
            "212-555-0001 212-555-0002 123456789012</p>"),
    (16, 9, '<div class="x" style="Display: none">Secret <a href="tel:212-555-0000">t</a> checkout</div>'
            '<span aria-hidden="true">hidden span</span>'),
    (18, 11, '<noscript>noscript checkout</noscript><iframe src="/map">frame text</iframe>'
             "<svg><text>vector</text></svg>"),
    (10, 3, '<a href="https://www.facebook.com/firm{id}">Follow</a>'),
    (8, 5, "<button>Add to cart</button><p>Checkout</p>"),
    (9, 7, "<p>Read our testimonials</p>"),
    (25, 3, "<p>Leave a review</p>"),
    (13, 6, "<p>Subscribe to our newsletter</p>"),
    (14, 9, "<p>Chat with us</p>"),
    (6, 4, "<p>Our services and treatments</p>"),
    (8, 1, "<p>A medical clinic with a physician; primary care and telemedicine.</p>"),
    (11, 5, "<p>Real estate by a realtor.</p>"),
    (13, 8, "<p>Law firm with an attorney.</p>"),
    (17, 6, "<p>Bookkeeping, accounting and tax preparation.</p>"),
    (12, 7, "<p>Plumbing, roofing and HVAC contractor.</p>"),
    (7, 3, "<p>New patients welcome</p>"),
    (9, 1, "<p>For clients and customers</p>"),
    (11, 7, "<p>Families and caregivers</p>"),
    (13, 3, "<p>A referring provider sends referrals</p>"),
    (16, 1, "<p>Supervision for professionals</p>"),
    (19, 2, "<p>Careers: we are hiring, join our team</p>"),
    (17, 9, "<p>Membership for a monthly fee</p>"),
    (10, 7, "<p>Intake and registration</p>"),
    (8, 3, "<p>Free consultation</p>"),
    (15, 4, "<p>Follow-up and ongoing care</p>"),
    (20, 13, "<p>Reactivation for a return visit</p>"),
    (14, 5, "<p>Financing and insurance</p>"),
    (22, 3, "<p>Care coordination</p>"),
    (6, 5, "<p>Welcome to Harbor Point {id} Dental Studio, Inc.</p>"),
    (21, 2, "<p>More about our crew</p>"),
    (9, 3, '<script type="application/ld+json">{"@context":"https://schema.org","@type":"MedicalClinic"}</script>'),
    (26, 5, '<script type="application/ld+json">[{"@type":["Store","Place"]},{"name":"x"},{"@type":"Store"}]</script>'),
    (27, 2, '<script type="application/ld+json">{"@type": broken</script>'),
    (28, 3, '<script type="application/ld+json">{"@graph":[{"@type":"Dentist"}]}</script>'),
    (5, 4, '<meta name="Description" content="Clinic {id} &amp; partners ">'),
    (7, 5, "<meta content='Second {id}' name=description>"),
    (24, 5, "<p>Just a moment, checking your browser</p>"),
    (29, 3, '<script>var s = "captcha";</script>'),
    (30, 11, "<p>A captcha page: Access Denied</p>"),
    (6, 2, '<a href="{next}">Visit Website</a>'),
    (10, 9, '<a href="https://maps.google.com/x">Website</a><a href="/out?biz_redir=1">biz</a>'
            '<a data-testid="bizWebsiteLink" href="{next}">Go</a>'),
    (12, 3, '<a href="https://low.example.edu/">our WEBSITE</a><a href="{next}">Business <i>Website</i></a>'),
    (15, 2, '<a rel="x" href="{next}"><span>Official</span> site</a>'),
    (14, 13, '<a href="https://out.example.edu/?biz_redir={id}&amp;x=1">biz</a>'),
    (20, 3, '<p class="a"">Stray quote {id}</p><p title=don\'t>Apostrophe</p><p>Between</p><p title=can\'t>After</p>'),
    (22, 9, '<a href="/stray-{id}"">Contact the crew</a>'),
    (25, 11, '<script data-x=don\'t>var hidden = "checkout";</script>'),
    (18, 5, "<p>z{id}&#0000000064;zero{id}.org &#150; dash</p>"),
    (27, 13, '<div class="box"><p style="display:none">Lost {id}<span>inner</span></div><p>Found {id}</p>'),
]

# Links on the home page, by block % 4.
NAVIGATION = [
    '<a href="/contact-us">Contact</a><a href="/about">About us</a>'
    '<a href="/people/team.html">Our team</a><a href="/services?ref=nav">Services</a>',
    '<a href="{origin}/services?ref=nav">Contact</a><a href="../about">Read</a>'
    '<a href="/services?ref=nav">More</a><a href="#contact">Contact</a>',
    '<a href="https://other.example.edu/contact">Contact</a><a href="javascript:contact()">Contact</a>'
    '<a href=" /people/./x/../team.html ">People</a><a href="/imprint">About this site</a>'
    '<a href="mailto:contact@firm{id}.org">Contact</a><a href="/contact-us">Write</a>',
    '<a href="/contact-us#form">Form</a><a href="/contact-us">Contact</a><a href="/">Contact home</a>'
    '<a href="?tab=team">Tab</a><a href="//{host}/about">Us</a>',
]

SMALL_PAGE = "<html><body>Under construction {id}</body></html>"
THIN_PAGE = "<html><body><!-- " + "filler " * 90 + "--><p>Thin {id}</p></body></html>"


def _fill(text: Column, page_id: Column) -> Column:
    block = F.floor(page_id / 5)
    for mark, value in (("{id4}", F.lpad((page_id % 10000).cast("string"), 4, "0")),
                        ("{id}", page_id.cast("string")), ("{origin}", _origin(block)),
                        ("{host}", F.regexp_replace(_origin(block), "^[a-z]+://", "")),
                        ("{next}", _home(block + 1))):
        text = F.replace(text, F.lit(mark), value)
    return text


def _origin(block: Column) -> Column:
    b = block.cast("string")
    return (F.when(block % 3 == 0, F.concat(F.lit("https://www.site"), b, F.lit(".example.net")))
            .when(block % 3 == 1, F.concat(F.lit("http://Site"), b, F.lit(".example.org")))
            .otherwise(F.concat(F.lit("https://site"), b, F.lit(".example.net:8443"))))


def _home(block: Column) -> Column:
    return F.concat(_origin(block), F.when(block % 2 == 0, "/").otherwise("/home/index.html"))


def _page_url(page_id: Column) -> Column:
    block, part = F.floor(page_id / 5), page_id % 5
    return (F.when(part == 0, _home(block))
            .otherwise(F.concat(_origin(block), F.when(part == 1, "/contact-us").when(part == 2, "/about")
                                .when(part == 3, "/people/team.html").otherwise("/services?ref=nav"))))


def splits(spark: SparkSession, folder: str) -> int:
    """Parts of the test view: enough small ones that no core waits long for the last."""
    return max(SPLITS, -(-tables.pages(spark, folder).count() // SPLIT_ROWS))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder).repartition(splits(spark, folder))


def seeded_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, html of every raw page with site address and snippets."""
    return seed(pages(spark, folder))


def seed(raw: DataFrame, *kept: str) -> DataFrame:
    page_id = F.col("page_id")
    rules = F.from_json(F.lit(json.dumps([dict(m=m, r=r, html=text) for m, r, text in SEEDS])),
                        "array<struct<m:long,r:long,html:string>>")
    fitting = F.filter(rules, lambda s: page_id % s["m"] == s["r"])
    extra = F.array_join(F.transform(fitting, lambda s: s["html"]), "")
    block = F.floor(page_id / 5)
    nav = F.when(page_id % 5 == 0, F.element_at(F.array(*map(F.lit, NAVIGATION)), (block % 4 + 1).cast("int"))
                 ).otherwise("")
    full = F.replace(F.col("html"), F.lit("</footer>"),
                     F.concat(_fill(F.concat(extra, nav), page_id), F.lit("</footer>")))
    return raw.select(
        "page_id", _page_url(page_id).alias("url"),
        F.when(page_id % 31 == 5, F.lit(" \n\t "))
        .when(page_id % 37 == 7, _fill(F.lit(SMALL_PAGE), page_id))
        .when(page_id % 41 == 6, _fill(F.lit(THIN_PAGE), page_id))
        .otherwise(full).alias("html"), *kept)


def crawl_log(spark: SparkSession, folder: str) -> DataFrame:
    """The seeded pages as a crawl log with status codes and content types."""
    p = F.col("page_id")
    return seeded_pages(spark, folder).select(
        "page_id",
        F.when(p % 17 == 2, "").when(p % 17 == 3, F.concat(F.lit("ftp://"), F.col("url")))
        .otherwise(F.col("url")).alias("url"),
        F.when(p % 11 == 4, 404).when(p % 11 == 5, 503).when(p % 11 == 6, 399).otherwise(200)
        .alias("status_code"),
        F.when(p % 7 == 1, "Application/XHTML+XML").when(p % 7 == 2, "application/pdf")
        .when(p % 7 == 3, F.lit(None).cast("string")).otherwise("text/HTML; charset=utf-8")
        .alias("content_type"),
        "html")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Seeded pages as fetched over HTTP, and browser captures of a part of them.

    Over HTTP some pages are missing, and some have an older capture that is nearly empty.  A browser capture
    shows the raw page, so a page that is blocked over HTTP can be whole there.
    """
    p, raw = F.col("page_id"), pages(spark, folder)
    shown = F.replace(F.col("raw_html"), F.lit("</footer>"), F.concat(
        F.lit("<p>Seen in a browser. Contact us. Book now.</p>"), _fill(F.lit(NAVIGATION[0]), p), F.lit("</footer>")))
    # Some HTTP answers are errors or no pages: they count as not fetched.
    status = F.when(p % 29 == 9, 404).otherwise(200)
    kind = F.when(p % 31 == 12, "application/pdf").otherwise("text/html; charset=utf-8")
    capture = lambda channel, html, page_id=p: F.struct(
        page_id.alias("page_id"), F.lit(channel).alias("channel"), html.alias("html"),
        (status if channel == "http" else F.lit(None).cast("int")).alias("status_code"),
        (kind if channel == "http" else F.lit(None).cast("string")).alias("content_type"))
    # One branch for both channels: over a union everything after it is planned twice.
    return (
        seed(raw.withColumn("raw_html", F.col("html")), "raw_html")
        .select("url", F.inline_outer(F.array_compact(F.array(
            F.when(p % 23 != 6, capture("http", F.col("html"))), F.when(p % 3 != 1, capture("browser", shown)),
            F.when((p % 4 == 1) & (p % 23 != 6), capture("http", F.lit("<p>Older</p>"), p - 1_000_000_000))))))
        .where("channel is not null").select("page_id", "url", "html", "channel", "status_code", "content_type"))


def new_leads(spark: SparkSession, folder: str) -> DataFrame:
    """One lead per page: lead_id, company_name, location, source_url."""
    return as_leads(pages(spark, folder))


def as_leads(raw: DataFrame) -> DataFrame:
    p = F.col("page_id")
    return raw.select(
        (p + 1).alias("lead_id"),
        F.when(p % 4 == 0, F.lit(None).cast("string")).when(p % 4 == 1, "")
        .otherwise(F.concat(F.lit("Company "), p.cast("string"))).alias("company_name"),
        F.when(p % 2 == 0, "North").otherwise("").alias("location"),
        F.when(p % 19 == 3, F.concat(F.lit("https://www.LinkedIn.com/company/"), p.cast("string")))
        .when(p % 23 == 4, "Manual HTML")
        .when(p % 29 == 8, F.concat(F.lit("http://missing"), p.cast("string"), F.lit(".example.org/")))
        .otherwise(_page_url(p)).alias("source_url"))


def link_lists(spark: SparkSession, folder: str) -> DataFrame:
    """One pasted list of links per page: request_id, links (lines of text)."""
    p = F.col("page_id")
    hrefs = F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), "\n")
    return pages(spark, folder).select(
        p.alias("request_id"),
        F.concat(F.lit("  "), F.col("url"), F.lit(" \n\n"), hrefs, F.lit("\nhttpx://odd"), p.cast("string"),
                 F.lit("\nHTTP://UPPER\n\t"), F.col("url")).alias("links"))


def manual_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages handed in by hand: seq, url, html; a url can come twice, some are empty."""
    p = F.col("page_id")
    one = seeded_pages(spark, folder).select(
        (p * 2).alias("seq"),
        F.when(p % 13 == 1, "  ").otherwise(F.concat(F.lit(" "), F.col("url"), F.lit(" "))).alias("url"),
        "html")
    two = pages(spark, folder).where(p % 5 == 2).select(
        (p * 2 + 1).alias("seq"), _page_url(p).alias("url"), "html")
    return one.unionByName(two)


def lead_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as lead state changes."""
    return as_lead_events(table(spark, folder, "events"))


def as_lead_events(events: DataFrame) -> DataFrame:
    """seq, lead_id, ts, kind and the fields that kind sets.

    click and view events set a status, purchase a scrape result, signup an
    analysis, error a failure.
    """
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    kind = (F.when(F.col("event_type").isin("click", "view", "error"), "status")
            .when(F.col("event_type") == "purchase", "scraped").otherwise("analysis"))
    score = F.when(e % 13 == 0, F.lit(None).cast("int")).otherwise((F.col("value") % 101).cast("int"))
    nothing = F.lit(None).cast("string")
    items = F.concat_ws(",", *[
        F.when(F.col("value") > bound, F.concat(
            F.lit(f'{{"type":"{name}","title":"{title}","score":{sc},"confidence":{cf}}}')))
        for bound, name, title, sc, cf in (
            (2, "intake_coordination", "Intake", 90, 83), (6, "audience_routing", "Routing", 89, 85),
            (12, "inquiry_conversion", "Inquiries", 88, 84), (20, "recruitment_workflow", "Hiring", 81, 80),
            (30, "reputation_follow_up", "Reviews", 71, 68))])
    name = F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("Studio "), u))
    document = F.concat(
        F.lit('{"business_name":"'), name, F.lit('",'),
        F.when(e % 4 != 0, F.lit('"opportunity_score_band":"high",')).otherwise(""),
        F.lit('"opportunity_score_breakdown":{"top_opportunity":'), score.cast("string"),
        F.lit(',"secondary_opportunity":null},"opportunities":['), items, F.lit("]}"))
    return events.select(
        e.alias("seq"), F.col("user_id").alias("lead_id"), "ts", kind.alias("kind"),
        F.when(kind == "status", F.when(F.col("event_type") == "error", "FAILED").otherwise(
            F.element_at(F.array(*map(F.lit, ["PENDING", "PROCESSING", "ENRICHED", "COMPLETED",
                                              "MISSING_DATA"])), (e % 5 + 1).cast("int")))).alias("status"),
        F.when(F.col("event_type") == "error", "ERROR")
        .when((F.col("event_type") == "click") & (e % 2 == 0),
              F.concat(F.lit("https://firm"), (F.col("user_id") % 97).cast("string"), F.lit(".example.org")))
        .alias("website"),
        F.when((F.col("event_type") == "view") & (e % 9 == 0), "")
        .when((F.col("event_type") == "view") & (e % 4 == 1), F.concat(F.lit("Firm "), u)).alias("company_name"),
        F.when((kind == "scraped") & (e % 3 != 0), F.concat(F.lit("a"), u, F.lit("@firm.org, b@firm.org")))
        .when(kind == "scraped", "").otherwise(nothing).alias("emails"),
        F.when((kind == "scraped") & (e % 5 == 0), F.concat(F.lit("310-555-"), F.lpad(u, 4, "0")))
        .when((kind == "scraped") & (e % 5 != 1), "").otherwise(nothing).alias("phones"),
        F.when(kind == "scraped", F.repeat(F.concat(F.lit("text "), e.cast("string"), F.lit(" ")),
                                           (e % 90).cast("int"))).alias("body_text"),
        F.when(kind == "analysis", score).alias("score"),
        F.when((kind == "analysis") & (e % 7 == 0), "{broken").when((kind == "analysis") & (e % 11 == 0), "")
        .when(kind == "analysis", document).alias("analysis_json"))
