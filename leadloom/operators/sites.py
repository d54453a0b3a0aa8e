"""Site job: home pages, their best subpages and the merged site row.

``captures`` are page fetches: page_id, url, html, channel ('http' or 'browser').
Which subpages a page leads to depends on that page alone, so it is worked out in
the page job.  The site steps read parsed captures only; no html reaches them.

Joins have one row per key on their right side, read from a table or through an exchange of its own, so adaptive
execution can split a key that is hot on the left.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import urls, vocab
from leadloom.functions.html import raw_values
from leadloom.functions.text import collapse, decode_all, strip
from leadloom.operators import pages
from leadloom.session import stored

RANKS = range(vocab.SUBPAGES_KEPT + 1)  # 0 is the home page


def with_subpages(df: DataFrame) -> DataFrame:
    """Adds ``subpages``: up to three same-site links worth reading, best first.

    Needs url, hrefs and link_texts.  Of several links to one address the last one
    counts: sorted by address and position, only the last of each run is kept.
    """
    c = F.col
    skip = lambda h: reduce(lambda a, b: a | b, [h.startswith(p) for p in ("#", "mailto:", "tel:", "javascript:")])
    rank = lambda s: F.least(*[F.when(s.contains(w), p) for w, p in vocab.SUBPAGE_WORDS.items()])
    home = urls.site_domain(c("url"))
    return (
        df.withColumn("_links", F.transform("hrefs", lambda h, i: F.struct(
            strip(h).alias("href"), F.get("link_texts", i).alias("text"), i.alias("pos"))))
        .withColumn("_links", F.filter("_links", lambda a: (a["href"] != "") & ~skip(a["href"])))
        # Few links have a rank, and only these are resolved.
        .withColumn("_links", F.transform("_links", lambda a: F.struct(
            a["href"].alias("href"), a["pos"].alias("pos"), F.lower(F.concat(a["href"], F.lit(" "), a["text"])).alias("words"))))
        .withColumn("_links", F.transform("_links", lambda a: F.struct(
            a["href"].alias("href"), a["pos"].alias("pos"), rank(a["words"]).alias("rank"))))
        .withColumn("_links", F.transform(F.filter("_links", lambda a: a["rank"].isNotNull()), lambda a: F.struct(
            urls.resolve(c("url"), a["href"]).alias("url"), a["pos"].alias("pos"), a["rank"].alias("rank"))))
        .withColumn("_links", F.array_sort(F.filter("_links", lambda a: urls.site_domain(a["url"]) == home)))
        .withColumn("_links", F.filter("_links", lambda a, i: F.coalesce(
            F.get("_links", i + 1)["url"] != a["url"], F.lit(True))))
        .withColumn("subpages", F.transform(
            F.slice(F.array_sort(F.transform("_links", lambda a: F.struct(
                a["rank"].alias("rank"), a["url"].alias("url")))), 1, vocab.SUBPAGES_KEPT),
            lambda a: a["url"]))
        .drop("_links"))


def parsed_captures(captures: DataFrame) -> DataFrame:
    """url, channel, page_id, usable, subpages and the payload that goes into a site; row-local.

    A site keeps the first 15,000 characters of its joined text, so no page needs
    to carry more than that.
    """
    parsed = with_subpages(pages.parse(captures, pages.quality, pages.emails, pages.phones, pages.features))
    return parsed.select(
        "url", "channel", "page_id", "usable", (F.col("reason") == "empty").alias("blank"), "subpages",
        F.struct("url", F.substring("text", 1, vocab.SITE_TEXT_CHARS).alias("text"), "emails", "phones",
                 F.struct(*pages.FEATURE_COLUMNS).alias("features")).alias("page"))


def latest_captures(parsed: DataFrame) -> DataFrame:
    """One parsed capture per url and channel: over HTTP the last usable one if there is any, else the last.

    The choice is made on ids alone; the payload follows by a join whose key holds the id, so a page captured
    millions of times is no hot key.
    """
    usable = F.when((F.col("channel") == "browser") | F.col("usable"), F.col("page_id"))
    chosen = parsed.groupBy("url", "channel").agg(F.coalesce(F.max(usable), F.max("page_id")).alias("page_id"))
    return parsed.join(chosen, ["url", "channel", "page_id"], "left_semi")


def home_pages(websites: DataFrame, latest: DataFrame) -> DataFrame:
    """website, mode and the subpages its home page leads to, per distinct website.

    mode: http when the HTTP page is usable, else browser when there is a capture, else none.
    """
    http_ok, in_browser = (F.col("channel") == "http") & F.col("usable"), F.col("channel") == "browser"
    light = latest.select(F.col("url").alias("website"), "channel", "usable", "subpages")
    found = websites.join(light, "website", "left").groupBy("website").agg(
        F.any_value(F.when(http_ok, F.col("subpages")), True).alias("http"), F.max(http_ok).alias("has_http"),
        F.any_value(F.when(in_browser, F.col("subpages")), True).alias("browser"), F.max(in_browser).alias("has_browser"))
    return found.select(
        "website",
        F.when(F.col("has_http"), "http").when(F.col("has_browser"), "browser").otherwise("none").alias("mode"),
        F.when(F.col("has_http"), F.col("http")).otherwise(F.col("browser")).alias("subpages"))


def requested_pages(homes: DataFrame) -> DataFrame:
    """website, mode, rank, url: the pages each site asks for, the home page as rank 0."""
    urls_wanted = F.concat(F.array("website"), F.coalesce("subpages", F.expr("cast(array() as array<string>)")))
    return homes.select("website", "mode", F.posexplode(urls_wanted).alias("rank", "url"))


def fetched(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Requests left join the captures that count."""
    return requests.join(latest.drop("subpages", "blank"), "url", "left")


#: What tells a capture from others; a page store adds where it keeps it.
CAPTURE = ("url", "channel", "page_id")


def picked(requests: DataFrame, latest: DataFrame, use_browser: bool = True, place: tuple = ()) -> DataFrame:
    """website, method and the captures that go into the site, home page first; decided without any page's text.

    At most four requests with two captures each are weighed per site.  ``place`` names further columns of ``latest``.
    """
    c = F.col
    rows = fetched(requests, latest)
    capture = F.when(c("channel").isNotNull(), F.struct(*CAPTURE, *place))

    def at(rank, channel):
        return F.any_value(F.when((c("rank") == rank) & (c("channel") == channel), capture), True)

    folded = rows.groupBy("website").agg(
        F.first("mode").alias("mode"),
        *[at(r, "http").alias(f"http{r}") for r in RANKS],
        *[F.max(F.when((c("rank") == r) & (c("channel") == "http"), c("usable"))).alias(f"ok{r}") for r in RANKS],
        *[at(r, "browser").alias(f"browser{r}") for r in RANKS])

    def from_browser(r):
        # In a site read over HTTP the browser only stands in for unusable pages.
        wanted = (c("mode") == "browser") | ((c("mode") == "http") & ~c(f"ok{r}"))
        return wanted & c(f"browser{r}").isNotNull() & F.lit(use_browser)

    picks = F.array_compact(F.array(*[
        F.when((c("mode") == "http") & c(f"ok{r}"), c(f"http{r}")).when(from_browser(r), c(f"browser{r}"))
        for r in RANKS]))
    helped = reduce(lambda a, b: a | b, [F.coalesce(from_browser(r), F.lit(False)) for r in RANKS])
    return folded.select(
        "website",
        F.when(c("mode") == "http", F.when(helped, "http+playwright").otherwise("http"))
        .when(F.lit(use_browser), "playwright").otherwise("failed").alias("method"), picks.alias("picks"))


def wanted_captures(picks: DataFrame) -> DataFrame:
    """website, method, n_picks, pos and the columns of each picked capture."""
    return picks.select("website", "method", F.size("picks").alias("n_picks"), F.posexplode("picks").alias("pos", "capture")).select(
        "website", "method", "n_picks", "pos", "capture.*")


def gathered(fetched_pages: DataFrame, *keys: str) -> DataFrame:
    """Per website (and ``keys``) its picked pages as columns page0 to page3."""
    return fetched_pages.groupBy(*keys, "website").agg(
        F.first("method").alias("method"), F.first("n_picks").alias("n_picks"),
        *[F.any_value(F.when(F.col("pos") == r, F.col("page")), True).alias(f"page{r}") for r in RANKS])


def merged_sites(found: DataFrame) -> DataFrame:
    """One row per website: method, text, emails, phones, pages, page_details; from ``gathered`` pages."""
    out = found.select("website", "method", F.array_compact(F.array(*[f"page{r}" for r in RANKS])).alias("picks"))
    texts = F.filter(F.transform("picks", lambda p: p["text"]), lambda t: t != "")
    union = lambda field: F.array_sort(F.array_distinct(F.flatten(F.transform("picks", lambda p: p[field]))))
    return out.select(
        "website", "method", F.substring(F.array_join(texts, " "), 1, vocab.SITE_TEXT_CHARS).alias("text"),
        union("emails").alias("emails"), union("phones").alias("phones"),
        F.transform("picks", lambda p: p["url"]).alias("pages"),
        F.transform("picks", lambda p: F.struct(
            p["url"].alias("url"), p["features"].alias("features"), p["emails"].alias("emails"),
            p["phones"].alias("phones"),
            F.substring(p["text"], 1, vocab.PREVIEW_CHARS).alias("text_preview"))).alias("page_details"))


def unread(picks: DataFrame, like: DataFrame) -> DataFrame:
    """Websites of which no capture counts, with the columns of ``gathered`` pages."""
    none = picks.where(F.size("picks") == 0)
    return none.select(*[F.lit(0).alias(n) if n == "n_picks" else F.col(n) if n in ("website", "method")
                         else F.lit(None).cast(like.schema[n].dataType).alias(n) for n in like.columns])


def light(parsed: DataFrame, *place: str) -> DataFrame:
    """What decides which captures count, without their payload."""
    return parsed.select(*CAPTURE, "usable", "blank", "subpages", *place)


def site_tables(websites: DataFrame, captures: DataFrame, use_browser: bool = True):
    """(requests, captures that count) of the distinct, non-null ``websites.website``; both are written once.

    ``captures`` are ``light`` rows.
    """
    if not use_browser:
        captures = captures.where("channel = 'http'")
    # An empty browser capture cannot be parsed: it counts as missing.
    latest = stored(latest_captures(captures.where("channel = 'http' or not blank")), "latest-captures")
    distinct = websites.select("website").where("website is not null").distinct()
    return stored(requested_pages(home_pages(distinct, latest)), "page-requests"), latest


def assemble(websites: DataFrame, parsed: DataFrame, use_browser: bool = True) -> DataFrame:
    """Merged site rows for the distinct, non-null values of ``websites.website``, from parsed captures.

    Which captures count is decided on light rows; of the payload only what goes into a site moves.
    """
    picks = stored(picked(*site_tables(websites, light(parsed), use_browser), use_browser), "picks")
    found = gathered(parsed.select(*CAPTURE, "page").join(wanted_captures(picks), list(CAPTURE)))
    return merged_sites(found.unionByName(unread(picks, found)))


# --- from a source page to the official website ------------------------------

def is_directory(url: Column) -> Column:
    """The host contains a known directory's name."""
    domain = urls.bare_domain(url)
    return reduce(lambda a, b: a | b, [domain.contains(d) for d in vocab.DIRECTORY_DOMAINS])


def official_links(source_pages: DataFrame) -> DataFrame:
    """url and ``official``: the first outside link of the best link pattern, if any.

    Patterns in order: four link texts (any case), an address part, a test id.
    """
    c = F.col
    source = urls.bare_domain(c("url"))

    def outside(a):
        domain = urls.bare_domain(a["href"])
        return ((a["href"].startswith("http://") | a["href"].startswith("https://"))
                & (domain != "") & (domain != source) & ~domain.contains("google.com"))

    has_text = lambda words: lambda a: F.lower(a["text"]).contains(words.lower())
    patterns = [has_text(words) for words in vocab.WEBSITE_LINK_TEXTS]
    patterns.append(lambda a: a["href"].contains(vocab.WEBSITE_LINK_HREF))
    patterns.append(lambda a: a["testid"] == vocab.WEBSITE_LINK_TESTID)
    layered = pages.text_layers(source_pages).withColumn("_anchors", pages.html.elements(c("_base"), "a"))
    return (
        layered.withColumns({
            "_text_raw": F.transform("_anchors", lambda a: F.regexp_replace(F.regexp_replace(
                pages.html.content_of(a), pages.html.TAG, ""), pages.html.MARK, "")),
            "_href_raw": raw_values(c("_anchors"), "href"), "_id_raw": raw_values(c("_anchors"), "data-testid")})
        .withColumns({"_texts": F.transform(decode_all("_text_raw"), lambda t: collapse(t)),
                      "_hrefs": decode_all("_href_raw"), "_ids": decode_all("_id_raw")})
        .withColumn("_out", F.transform("_hrefs", lambda h, i: F.struct(
            h.alias("href"), F.get("_texts", i).alias("text"), F.get("_ids", i).alias("testid"))))
        .withColumn("_out", F.filter("_out", outside))
        .select("url", "page_id", F.coalesce(*[
            F.get(F.filter("_out", p), 0)["href"] for p in patterns]).alias("official")))


def with_website(leads: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``website`` to leads: UNSCRAPABLE, the official link, the source itself or NOT_FOUND.

    ``links`` are ``official_links`` rows; the last page of an address counts, found by its id alone.  Many leads can
    name the same source page.  ``source_known`` tells whether the source page has been read.
    """
    c = F.col
    last = links.groupBy("url").agg(F.max("page_id").alias("page_id"))
    one = links.join(last, ["url", "page_id"], "left_semi").dropDuplicates(["url"])
    # The key is worked out anew, so the join has an exchange of its own on either side.
    one = one.select(F.concat("url", F.lit("")).alias("source_url"), "official", F.lit(True).alias("source_known"))
    is_http = c("source_url").startswith("http://") | c("source_url").startswith("https://")
    return leads.join(one, "source_url", "left").withColumn("website", (
        F.when(~F.coalesce(is_http, F.lit(False)), "NOT_FOUND")
        .when(is_directory(c("source_url")), "UNSCRAPABLE")
        .otherwise(F.coalesce("official", "source_url")))).drop("official").withColumn(
        "source_known", F.coalesce("source_known", F.lit(False)))
