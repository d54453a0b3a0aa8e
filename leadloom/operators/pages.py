"""Page job: one row per raw page in, one row of parsed columns out.  No shuffle.

Steps are separate ``withColumn`` calls so a costly string is computed once and
read many times; columns a query does not ask for are pruned by the optimizer.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import contacts, html, vocab
from leadloom.functions.text import (contains_any, count_words, decode_all, decode_entities, is_blank,
                                     strip)

FEATURE_COLUMNS = ["form_count", "lead_form", "form_details", *vocab.FEATURES, "cta_count"]


def text_layers(df: DataFrame) -> DataFrame:
    """Adds three texts of ``html``.

    raw_text: all text but script, style and template, inner white space kept.
    plain_text: also without noscript and svg (what the quality gate reads).
    text: also without iframe and hidden elements (what a visitor sees).
    """
    c = F.col
    return (
        df.withColumn("_html", F.coalesce("html", F.lit("")))
        .withColumns({"_low": F.lower("_html"), "_base": html.drop_code(c("_html"))})
        .withColumns({"_plain": html.drop_noscript_svg(c("_base"), c("_low")), "_raw_marks": html.tags_to_marks(c("_base"))})
        # Most pages have nothing more to drop: then the earlier text is reused.
        .withColumns({"_framed": html.drop_iframe(c("_plain"), c("_low")),
                      "_less_marks": F.when(c("_plain") != c("_base"), html.tags_to_marks(c("_plain"))),
                      "_raw": decode_entities("_raw_marks")})
        .withColumn("_tokens", html.hidden_tokens(c("_framed"), c("_low")))
        .withColumn("_kinds", html.token_kinds("_tokens"))
        .withColumn("_spans", html.shown_spans("_kinds"))
        .withColumns({"_shown": html.shown(c("_framed"), "_tokens", "_spans"), "raw_text": html.joined_text(c("_raw")),
                      "plain_text": html.flat_text(F.coalesce(decode_entities("_less_marks"), c("_raw")))})
        .withColumn("_least_marks", F.when(c("_shown") != c("_plain"), html.tags_to_marks(c("_shown"))))
        .withColumn("text", F.coalesce(html.flat_text(decode_entities("_least_marks")), c("plain_text"))))


def quality(df: DataFrame) -> DataFrame:
    """Adds usable, reason, text_length, html_length; needs ``text_layers``."""
    c = F.col
    size = F.length("_html")
    # Most pages hold none of the phrases, which takes few scans to see.
    phrase = F.when(contains_any("_plain_lower", vocab.BLOCK_PHRASES), F.coalesce(
        *[F.when(c("_plain_lower").contains(p), F.lit(p)) for p in vocab.BLOCK_PHRASES]))
    reason = F.coalesce(
        F.when(is_blank(c("_html")), "empty"), F.when(size < vocab.MIN_HTML_CHARS, "small_html"),
        F.concat(F.lit("blocked: "), phrase),
        F.when(F.length("plain_text") < vocab.MIN_TEXT_CHARS, "little_text"), F.lit("ok"))
    return df.withColumn("_plain_lower", F.lower("plain_text")).withColumn("reason", reason).withColumns({
        "usable": c("reason") == "ok",
        "text_length": F.when(c("reason").isin("empty", "small_html"), 0).otherwise(F.length("plain_text")),
        "html_length": F.when(c("reason") == "empty", 0).otherwise(size)})


def head_fields(df: DataFrame) -> DataFrame:
    """Adds title, description and schema_types; needs ``text_layers``."""
    c = F.col
    title = F.regexp_extract("_base", rf"(?is)<title(?=[\s/>]){html.ATTRS}>(.*?)(?:</title|\z)", 1)
    metas = F.filter(html.open_tags(c("_base"), "meta"), lambda t: F.lower(strip(
        html.attribute(html.attrs_of(t), "name"))) == "description")
    scripts = F.filter(
        F.regexp_extract_all("_html", F.lit(
            rf"(?is)<!--.*?-->|<script(?=[\s/>]){html.ATTRS}>.*?(?=</script)"), F.lit(0)),
        lambda s: html.attribute(html.attrs_of(s), "type") == "application/ld+json")
    # In brackets, text after the document makes it invalid, or a second element.
    listed = lambda b: F.try_parse_json(F.concat(F.lit("["), b, F.lit("]")))
    bodies = F.filter(F.transform(scripts, html.content_of), lambda b: listed(b).isNotNull()
                      & F.try_variant_get(listed(b), "$[1]", "variant").isNull())
    items = F.flatten(F.transform(bodies, lambda b: F.coalesce(
        F.from_json(b, "array<struct<`@type`:string>>"),
        F.expr("cast(array() as array<struct<`@type`:string>>)"))))
    kinds = F.filter(F.transform(items, lambda i: i["@type"]), lambda k: k.isNotNull() & (k != ""))
    names = F.flatten(F.transform(kinds, lambda k: F.when(
        k.startswith("["), F.coalesce(F.from_json(k, "array<string>"), F.array(k))).otherwise(F.array(k))))
    return df.withColumns({
        "_title": title,
        "_meta": F.coalesce(html.attribute(html.attrs_of(F.get(metas, 0)), "content"), F.lit("")),
        "schema_types": F.when(c("_html").contains("ld+json"), F.array_sort(F.array_distinct(names)))
        .otherwise(F.expr("cast(array() as array<string>)")),
    }).withColumns({"title": strip(decode_entities("_title")), "description": strip(decode_entities("_meta"))})


def links(df: DataFrame) -> DataFrame:
    """Adds hrefs and link_texts (same positions, one entry per anchor) and link_count."""
    c = F.col
    return df.withColumn("_anchors", html.elements(c("_base"), "a")).withColumns({
        "_href_raw": html.raw_values(c("_anchors"), "href"),
        "_link_marks": html.marked_contents(c("_anchors")),
        "link_count": F.size(F.filter("_anchors", lambda a: html.has_attribute(html.attrs_of(a), "href"))),
    }).withColumns({"hrefs": decode_all("_href_raw"),
                    "link_texts": F.transform(decode_all("_link_marks"), html.joined_text)})


def emails(df: DataFrame) -> DataFrame:
    """Adds mailto_emails, scanned_emails, obfuscated_emails and their ordered union emails."""
    c = F.col
    coded_tags = F.regexp_extract_all("_base", F.lit(rf"<[a-zA-Z](?=[^>]*&){html.ATTRS}>"), F.lit(0))
    # A coded @ or letter needs one of these; most pages have none and are not scanned.
    maybe_coded = c("_html").contains("@") | c("_html").contains("&#") | c("_html").contains("&commat;")
    maybe_obfuscated = c("_low").contains("dot") | c("_html").contains("&#")
    valid = lambda a: F.array_sort(F.array_distinct(F.filter(a, contacts.valid_email)))
    return (
        df.withColumns({"_coded_raw": F.when(maybe_coded, F.array_join(coded_tags, " ")).otherwise(""),
                        "_unescaped": F.when(maybe_obfuscated, decode_entities("_html")).otherwise("")})
        .withColumn("_coded", decode_entities("_coded_raw"))
        .withColumns({
            "mailto_emails": F.array_sort(contacts.mailto_emails(c("hrefs"))),
            "scanned_emails": valid(F.concat(contacts.scan_emails(c("_html")), contacts.scan_emails(c("_coded")))),
            "obfuscated_emails": valid(contacts.obfuscated_emails(c("_unescaped")))})
        .withColumn("emails", contacts.high_first(
            c("mailto_emails"), F.concat("scanned_emails", "obfuscated_emails"))))


def phones(df: DataFrame) -> DataFrame:
    """Adds tel_phones, text_phones and their ordered union phones."""
    c = F.col
    return (
        df.withColumn("_shown_raw", F.when(c("_shown") == c("_base"), c("_href_raw")).otherwise(
            html.raw_values(html.elements(c("_shown"), "a"), "href")))
        .withColumns({"tel_phones": F.array_sort(contacts.tel_phones(decode_all("_shown_raw"))),
                      "text_phones": F.array_sort(contacts.text_phones(c("text")))})
        .withColumn("phones", contacts.high_first(c("tel_phones"), c("text_phones"))))


def features(df: DataFrame) -> DataFrame:
    """Adds the form columns, the seven keyword flags and cta_count."""
    c = F.col

    def raw_labels(form):
        tags = html.open_tags(form, "input|textarea|select")
        return F.transform(tags, lambda t: F.concat_ws(" ", *[
            html.attribute(html.attrs_of(t), n) for n in ("name", "id", "placeholder", "aria-label")]))

    def labels(decoded):
        cut = F.transform(decoded, lambda l: F.substring(strip(l), 1, vocab.FORM_LABEL_CHARS))
        return F.filter(cut, lambda l: l != "")

    def is_lead(form):
        return (F.size(form["fields"]) >= 2) | contains_any(form["lower"], vocab.FORM_ACTION_WORDS)

    cta = lambda a: F.size(F.filter(F.transform(a, F.lower), lambda t: contains_any(t, vocab.CTA_WORDS)))
    return (
        df.withColumns({"_form_html": html.elements(c("_base"), "form", c("_low")),
                        "_button_html": html.elements(c("_base"), "button", c("_low")), "_lower": F.lower("raw_text")})
        .withColumns({"_form_marks": html.marked_contents(c("_form_html")),
                      "_action_raw": html.raw_values(c("_form_html"), "action"),
                      "_label_raw": F.transform("_form_html", raw_labels),
                      "_button_marks": html.marked_contents(c("_button_html")),
                      "_haystack": F.concat(c("_low"), F.lit(" "), c("_lower"))})
        .withColumns({"_form_texts": F.transform(decode_all("_form_marks"), html.joined_text),
                      "_actions": decode_all("_action_raw"),
                      "_labels": F.transform(decode_all("_label_raw", 2), labels),
                      "_button_texts": F.transform(decode_all("_button_marks"), html.joined_text)})
        .withColumn("_forms", F.transform("_labels", lambda l, i: F.struct(
            F.get("_actions", i).alias("action"), l.alias("fields"),
            F.substring(F.get("_form_texts", i), 1, vocab.FORM_TEXT_CHARS).alias("text"))))
        .withColumns({
            "form_count": F.size("_forms"),
            "form_details": F.slice("_forms", 1, vocab.FORM_DETAILS_KEPT),
            "lead_form": F.exists(F.transform("_forms", lambda f: F.struct(f["fields"].alias("fields"), F.lower(f["text"]).alias("lower"))), is_lead) | (
                (count_words("_lower", vocab.FORM_FIELD_WORDS) >= 2)
                & contains_any("_lower", vocab.FORM_ACTION_WORDS)),
            **{n: contains_any("_haystack", w) for n, w in vocab.FEATURES.items()},
            "cta_count": cta(c("link_texts")) + cta(c("_button_texts"))}))


# Each step and the steps it builds on.
STEPS = {text_layers: [], quality: [text_layers], head_fields: [text_layers], links: [text_layers],
         emails: [links], phones: [links], features: [links]}


def parse(df: DataFrame, *steps) -> DataFrame:
    """Page columns of the given steps and those they build on (default: all).

    The input columns stay, helper columns go.
    """
    wanted = set(steps or STEPS)
    for step in reversed(STEPS):
        if step in wanted:
            wanted.update(STEPS[step])
    out = df
    for step in STEPS:
        if step in wanted:
            out = step(out)
    return out.drop(*[n for n in out.columns if n.startswith("_")])


def page_job(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed pages, and the rows whose html is blank (they cannot be parsed)."""
    blank = is_blank(F.col("html"))
    return parse(df.where(~blank)), df.where(blank).withColumn("error", F.lit("empty_html"))
