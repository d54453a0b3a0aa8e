"""Analysis job: signals, evidence, names, classes and the business summary.

Input is one row per site (``sites.assemble``) or per single page
(``from_html``), with these columns: website, text, html, pages, page_details,
emails, phones, title, description, schema_types, link_count, has_form, has_tel.
Everything is row-local.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import vocab
from leadloom.functions.text import collapse, contains_any, count_words, detect_groups, names_of, strip
from leadloom.operators import pages

EMAIL_ANY = r"[a-zA-Z0-9._%+-]@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_ANY = r"(?U)(?=[(\d])(?<!\d)\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}(?!\d)"
PAGE_FEATURES = ["lead_form", *vocab.FEATURES]


def from_sites(sites: DataFrame) -> DataFrame:
    """Analysis input of merged sites: no html, hence no title, schema types or links."""
    return sites.select(
        "website", "text", F.lit("").alias("html"), "pages", "page_details", "emails", "phones",
        F.lit("").alias("title"), F.lit("").alias("description"),
        F.expr("cast(array() as array<string>)").alias("schema_types"), F.lit(0).alias("link_count"),
        F.lit(False).alias("has_form"), F.lit(False).alias("has_tel"),
        *[c for c in sites.columns if c == "method"])


def from_html(raw: DataFrame) -> DataFrame:
    """Analysis input of single pages (url, html) looked at without site context."""
    c = F.col
    empty = "cast(array() as array<string>)"
    out = pages.links(pages.head_fields(pages.text_layers(raw)))
    return out.select(
        c("url").alias("website"), c("raw_text").alias("text"), c("_html").alias("html"),
        F.expr(empty).alias("pages"),
        F.expr("cast(array() as array<struct<url:string,features:struct<lead_form:boolean>>>)").alias("page_details"),
        F.expr(empty).alias("emails"), F.expr(empty).alias("phones"),
        "title", "description", "schema_types", "link_count",
        (F.size(pages.html.elements(c("_base"), "form")) > 0).alias("has_form"),
        F.exists("hrefs", lambda h: F.lower(h).startswith("tel:")).alias("has_tel"))


def signals(df: DataFrame) -> DataFrame:
    """Adds normal_text, lower_text, text_form and twelve flags ``sig_<name>``.

    Flags are plain columns: fields of a struct would be inlined, and so worked out
    again, at every place that reads them.
    """
    c = F.col
    has_feature = lambda name: F.exists("page_details", lambda d: d["features"][name])
    # With page details the page flags decide, even when all of them are false.
    feature = lambda name: F.when(F.size("page_details") > 0, has_feature(name)).otherwise(
        contains_any("_all", vocab.FEATURES[name])) if _details_have(df, name) else contains_any(
        "_all", vocab.FEATURES[name])
    text_form = ((count_words("lower_text", vocab.TEXT_FORM_FIELD_WORDS) >= 2)
                 & contains_any("lower_text", vocab.TEXT_FORM_ACTION_WORDS))
    contact_url = F.exists("pages", lambda p: F.lower(p).contains("/contact") | F.lower(p).contains("contact-us"))
    flags = {
        "contact_page": contains_any("lower_text", vocab.CONTACT_WORDS) | contact_url,
        "booking": feature("booking"),
        "lead_form": has_feature("lead_form") | c("has_form") | c("text_form"),
        "phone": c("has_tel") | c("lower_text").rlike(PHONE_ANY) | (F.size("phones") > 0),
        "email": c("_all").rlike(EMAIL_ANY) | (F.size("emails") > 0),
        "services": contains_any("_all", vocab.SERVICE_SIGNAL_WORDS),
        **{n: feature(n) for n in vocab.FEATURES if n != "booking"},
    }
    return (
        df.withColumn("normal_text", collapse(c("text")))
        .withColumn("lower_text", F.lower("normal_text"))
        .withColumns({"text_form": text_form, "_all": F.when(c("html") == "", c("lower_text")).otherwise(
            F.concat(F.lower("html"), F.lit(" "), c("lower_text")))})
        .withColumns({f"sig_{n}": flags[n] for n in vocab.SIGNALS})
        .drop("_all"))


def signal(name: str) -> Column:
    return F.col(f"sig_{name}")


def _details_have(df: DataFrame, name: str) -> bool:
    fields = df.schema["page_details"].dataType.elementType["features"].dataType.names
    return name in fields


def evidence(df: DataFrame) -> DataFrame:
    """Adds ``evidence``: signal name to a list of (code, arg), empty for false signals."""
    note = lambda code, arg="": F.struct(F.lit(code).alias("code"), F.lit(arg).alias("arg")
                                         if isinstance(arg, str) else arg.alias("arg"))
    none = F.expr("cast(array() as array<struct<code:string,arg:string>>)")

    def page_notes(name, code):
        if not _details_have(df, name):
            return none
        hits = F.slice(F.filter("page_details", lambda d: d["features"][name]), 1, 3)
        return F.transform(hits, lambda d: note(code, d["url"]))

    def when_true(cond, code):
        return F.when(cond, F.array(note(code))).otherwise(none)

    at_least_one = lambda col: F.greatest(F.size(col), F.lit(1)).cast("string")
    contact_pages = F.filter("pages", lambda p: F.lower(p).contains("contact"))
    lists = {n: F.array(note("detected")) for n in vocab.SIGNALS}
    lists["contact_page"] = F.concat(F.array(note("contact_content")), F.transform(
        F.slice(contact_pages, 1, 1), lambda p: note("contact_page", p)))
    lists["booking"] = F.concat(F.array(note("booking_capability")), page_notes("booking", "booking_page"))
    lists["lead_form"] = F.concat(page_notes("lead_form", "form_page"), when_true(F.col("has_form"), "html_form"),
                                  when_true(F.col("text_form"), "text_form"))
    lists["email"] = F.array(note("email_signals", at_least_one("emails")))
    lists["phone"] = F.array(note("phone_signals", at_least_one("phones")))
    for n in ("social", "ecommerce", "reviews", "newsletter", "live_chat", "review_cta"):
        lists[n] = F.concat(lists[n], page_notes(n, "feature_page"))
    return df.withColumn("evidence", F.map_from_arrays(
        F.array(*map(F.lit, vocab.SIGNALS)),
        F.array(*[F.when(signal(n), lists[n]).otherwise(none) for n in vocab.SIGNALS])))


def business_name(title: Column, text: Column, url: Column) -> Column:
    """From the title, else from "welcome to / about ...", else from the host."""
    head = strip(F.element_at(F.split(title, rf"(?U)\s+[|–-]\s+"), 1))
    # Fixed value: the pattern of a name in the text.
    named = F.regexp_extract(text, r"(?i)(?:welcome to|about)\s+([A-Z][A-Za-z0-9 &'.,-]{2,60})", 1)
    host = F.regexp_replace(F.substring_index(F.substring_index(url, "//", -1), "/", 1), r"^www\.", "")
    label = F.translate(F.substring_index(host, ".", 1), "-_", "  ")
    # Each run of letters is capitalised, also right after a digit.
    titled = F.array_join(F.transform(F.regexp_extract_all(label, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")
    return (F.when(head != "", head).when(named != "", F.regexp_replace(named, "^[ .,]+|[ .,]+$", ""))
            .otherwise(titled))


def industry(value: str) -> Column:
    """First industry with a word in a column of text and schema types in lower case."""
    return F.coalesce(*[F.when(contains_any(value, words), F.lit(name))
                        for name, words in vocab.INDUSTRIES.items()], F.lit("unknown"))


def classes(df: DataFrame) -> DataFrame:
    """Adds business_name, industry, services, audiences, workflows, capabilities, conversion_paths."""
    c = F.col
    paths = {"appointment_or_consultation": "booking", "inquiry_form": "lead_form", "phone": "phone",
             "email": "email", "live_chat": "live_chat", "transaction": "ecommerce"}
    # A column of its own: in the expression it would be put into lower case again for every word.
    value = F.lower(F.concat("normal_text", F.lit(" "), F.array_join("schema_types", " ")))
    return df.withColumn("_industry", value).withColumns({
        "business_name": business_name(c("title"), c("normal_text"), c("website")),
        "industry": industry("_industry"),
        "services": names_of(vocab.SERVICES, [contains_any("lower_text", [t]) for t in vocab.SERVICES]),
        "audiences": detect_groups("lower_text", vocab.AUDIENCES),
        "workflows": detect_groups("lower_text", vocab.WORKFLOWS),
        "capabilities": names_of(vocab.SIGNALS, [signal(n) for n in vocab.SIGNALS]),
        "conversion_paths": names_of(paths, [signal(n) for n in paths.values()]),
    }).drop("_industry")


def summary(df: DataFrame) -> DataFrame:
    """Adds unknown_workflows, journey and data_quality."""
    c = F.col
    flow = lambda n: F.array_contains("workflows", n)
    group = lambda n: F.array_contains("audiences", n)
    block = lambda cond, items: F.when(cond, F.array(*map(F.lit, items))).otherwise(
        F.expr("cast(array() as array<string>)"))
    unknown = F.array_distinct(F.concat(
        block(signal("booking"), ["confirmation", "reminders", "rescheduling", "no_show_recovery"]),
        block(signal("lead_form") | flow("consultation"), ["response_routing", "qualification", "follow_up"]),
        block(flow("intake") | flow("referral"), ["document_collection", "handoffs", "status_updates"]),
        block(flow("recruitment") | group("employees"),
              ["applicant_screening", "interview_scheduling", "candidate_follow_up"]),
        block(flow("membership") | group("members"), ["onboarding", "retention", "billing_workflow"])))
    steps = {
        "discover": F.lit(True),
        "audience_route": F.size("audiences") >= 2,
        "inquire": signal("phone") | signal("email") | signal("lead_form"),
        "referral": flow("referral"),
        "consultation": flow("consultation"),
        "book": signal("booking"),
        "intake": flow("intake"),
        "membership": flow("membership"),
        "ongoing_follow_up": flow("follow_up") | flow("recall"),
        "review": signal("reviews"),
    }
    count = F.size("capabilities")
    score = F.least(F.lit(100), 25 + 5 * count + F.when(c("text") != "", 20).otherwise(0)
                    + F.least(F.lit(20), 4 * F.size("pages")))
    return df.withColumns({
        "unknown_workflows": unknown,
        "journey": names_of(steps, steps.values()),
        "data_quality": F.struct(
            score.alias("score"), (c("normal_text") != "").alias("text_present"),
            F.size("pages").alias("pages_analyzed"), count.alias("signal_count")),
    })


def intelligence() -> Column:
    """The business summary as one struct."""
    return F.struct(
        F.lit(vocab.ANALYSIS_VERSION).alias("analysis_version"),
        F.struct("industry", "audiences", "services").alias("business_profile"),
        F.col("journey").alias("customer_journey"),
        F.struct(F.col("capabilities").alias("website_capabilities"), "conversion_paths", "audiences",
                 "workflows", "services").alias("observed"),
        F.col("unknown_workflows").alias("unknowns"), "data_quality")


def analyze(df: DataFrame) -> DataFrame:
    """All analysis columns, the struct ``signals`` and content_length of the normalised text."""
    out = summary(classes(evidence(signals(df))))
    return out.withColumns({
        "signals": F.struct(*[signal(n).alias(n) for n in vocab.SIGNALS]),
        "content_length": F.length("normal_text")})
