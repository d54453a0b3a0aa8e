"""Signals, classes, rules and scores on hand-written input."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import vocab
from leadloom.operators import analysis, opportunities

BASE = ("contact_page", "phone", "email", "services")


def detect(spark, on, text="", pages=(), industry="unknown"):
    df = spark.createDataFrame([("w", text, list(pages), industry)], "website string, text string, pages array<string>, industry string")
    df = df.withColumns({f"sig_{n}": F.lit(n in on) for n in vocab.SIGNALS}).withColumn("lower_text", F.lower("text"))
    df = df.withColumns({"audiences": analysis.detect_groups("lower_text", vocab.AUDIENCES),
                         "workflows": analysis.detect_groups("lower_text", vocab.WORKFLOWS)})
    return opportunities.detect(df).first()


def scores(row):
    return {o.type: o.score for o in row.opportunities}


def test_booking_in_healthcare(spark):
    row = detect(spark, ["booking", "email", "phone"], pages=["https://e.org/appointments"], industry="healthcare")
    best = row.opportunities[0]
    assert (best.score, best.impact, best.confidence, best.solution_fit) == (88, 90, 82, 92)
    assert (row.opportunity_score, row.opportunity_band) == (66, "medium")
    assert best.unknowns and [e.code for e in best.evidence] == [
        "booking_visible", "booking_page", "healthcare_model", "direct_contact"]


@pytest.mark.parametrize("on, text, pages, industry, expected, overall", [
    (("lead_form",), "name email phone message submit contact form", ["https://e.org/contact/"], "healthcare",
     {"inquiry_conversion": 88}, 66),
    (("booking",), "book appointment schedule online healthcare patient", ["https://e.org/appointments/"], "healthcare",
     {"appointment_lifecycle": 88}, 66),
    ((), "families caregivers professionals referrals home care services", ["https://e.org/", "https://e.org/contact/"],
     "healthcare", {"intake_coordination": 90, "audience_routing": 89, "conversion_path": 80}, 90),
    ((), "patient intake forms referral referrals enrollment care coordination", ["https://e.org/referrals/"], "healthcare",
     {"intake_coordination": 90, "audience_routing": 89, "conversion_path": 80}, 90),
    ((), "products services treatments patient information", ["https://e.org/"], "healthcare", {"conversion_path": 80}, 60),
    (("ecommerce",), "shop now add to cart checkout products", ["https://e.org/shop/"], "ecommerce",
     {"commerce_lifecycle": 81}, 61)])
def test_rules(spark, on, text, pages, industry, expected, overall):
    row = detect(spark, BASE + on, text, pages, industry)
    assert scores(row) == expected and row.opportunity_score == overall


@pytest.mark.parametrize("on, text, pages, industry, kind, score", [
    (("booking",), "", [], "healthcare", "appointment_lifecycle", 86), (("booking",), "", [], "x", "appointment_lifecycle", 83),
    (("booking",), "", ["/book"], "x", "appointment_lifecycle", 84), (("lead_form",), "", [], "x", "inquiry_conversion", 86),
    ((), "free consultation", [], "x", "consultation_conversion", 84), ((), "intake", [], "x", "intake_coordination", 87),
    ((), "we are hiring", [], "x", "recruitment_workflow", 81), ((), "remember", [], "x", "membership_conversion", 89),
    ((), "come back", [], "x", "retention_reactivation", 85), (("reviews", "services"), "", [], "x", "reputation_follow_up", 71)])
def test_rule_scores(spark, on, text, pages, industry, kind, score):
    assert scores(detect(spark, on, text, pages, industry))[kind] == score


def test_nothing_found(spark):
    row = detect(spark, [])
    assert (row.opportunity_score, row.opportunity_band, row.score_breakdown.top_opportunity) == (0, "weak", None)


def test_overall_score_rounds_half_to_even(spark):
    rows = [("a", "x", 94, 1), ("a", "y", 86, 2), ("a", "z", 68, 3), ("b", "x", 90, 1), ("b", "y", 60, 2), ("c", "x", 71, 9)]
    table = spark.createDataFrame(rows, "k string, type string, score int, rule_no int")
    got = {r.k: (r.score, r.band, r.top_type) for r in opportunities.overall_score(opportunities.ranked(table, "k"), "k").collect()}
    assert got == {"a": (92, "high", "x"), "b": (82, "high", "x"), "c": (53, "low", "x")}


def page_rows(spark, html):
    df = spark.createDataFrame([("https://www.24h-plumb_ing.example.org:80/x", html)], "url string, html string")
    return opportunities.detect(analysis.analyze(analysis.from_html(df))).first()


def test_single_page_mode(spark):
    row = page_rows(spark, "<html><title>Dental Clinic</title><body>Our products include whitening products. "
                           "Contact us for appointments.</body></html>")
    assert not row.signals.ecommerce and row.signals.booking and row.signals.contact_page
    assert (row.business_name, row.industry) == ("Dental Clinic", "unknown")
    assert scores(row) == {"appointment_lifecycle": 83} and row.opportunity_score == 62
    row = page_rows(spark, "<html><title>Online Store</title><body>Buy now and add to cart. Checkout securely.</body></html>")
    assert row.signals.ecommerce and row.industry == "ecommerce" and scores(row) == {"commerce_lifecycle": 81}


def test_names(spark):
    assert page_rows(spark, "<title>Acme – Best | In town</title>").business_name == "Acme"
    assert page_rows(spark, "<p>Welcome to Blue Door, Inc. Enjoy</p>").business_name == "Blue Door, Inc. Enjoy"
    assert page_rows(spark, "<p>nothing</p>").business_name == "24H Plumb Ing"


def site(spark, text, features, emails=(), phones=(), pages=("https://e.org", "https://e.org/contact/")):
    flags = ", ".join(f"{n} boolean" for n in analysis.PAGE_FEATURES)
    details = [(pages[-1], tuple(bool(features.get(n)) for n in analysis.PAGE_FEATURES))] if features is not None else []
    df = spark.createDataFrame(
        [("https://e.org", text, list(pages), details, list(emails), list(phones))],
        f"website string, text string, pages array<string>, page_details array<struct<url:string,features:struct<{flags.replace(' boolean', ':boolean')}>>>, "
        "emails array<string>, phones array<string>")
    return opportunities.detect(analysis.analyze(analysis.from_sites(df))).first()


def test_page_flags_decide_over_text(spark):
    row = site(spark, "E Clinic Contact Us services physician", {"lead_form": True}, ["i@e.org"], ["310-555-1212"])
    assert row.signals.lead_form and row.industry == "healthcare" and scores(row)["inquiry_conversion"] == 88
    assert [(e.code, e.arg) for e in row.evidence["lead_form"]] == [("form_page", "https://e.org/contact/")]
    assert not site(spark, "book now", {}).signals.booking
    assert site(spark, "book now", None).signals.booking


def test_presence_without_contacts(spark):
    row = site(spark, "write a@b.co or 800-555-1212", {})
    assert row.signals.email and row.signals.phone
    assert [(e.code, e.arg) for e in row.evidence["email"]] == [("email_signals", "1")]


def test_journey_quality_and_unknowns(spark):
    row = site(spark, "families and clients: membership, intake, follow-up, free consultation, call 310 555 1212", {"booking": True, "reviews": True})
    assert row.journey == ["discover", "audience_route", "inquire", "consultation", "book", "intake", "membership",
                           "ongoing_follow_up", "review"]
    assert row.unknown_workflows[:4] == ["confirmation", "reminders", "rescheduling", "no_show_recovery"]
    assert len(set(row.unknown_workflows)) == len(row.unknown_workflows)
    quality = row.data_quality
    assert quality.score == 25 + 5 * quality.signal_count + 20 + 8 and quality.text_present
