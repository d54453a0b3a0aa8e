"""Opportunity job: rules to candidates, priority scores, ranks and the lead score."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import vocab
from leadloom.functions.text import contains_any, exploded_rows
from leadloom.operators.analysis import signal
from leadloom.operators.rules import RULES


def priority_score(impact: Column, confidence: Column, fit: Column) -> Column:
    """Weighted mean of the three inputs clamped to 0..100, rounded half to even."""
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("double")
    return F.bround(clamp(impact) * vocab.WEIGHT_IMPACT + clamp(confidence) * vocab.WEIGHT_CONFIDENCE
                    + clamp(fit) * vocab.WEIGHT_FIT).cast("int")


def band(score: Column) -> Column:
    return (F.when(score >= vocab.BAND_HIGH, "high").when(score >= vocab.BAND_MEDIUM, "medium")
            .otherwise("low"))


def fallback_band(score: Column) -> Column:
    """Band the dashboard shows when no analysis is stored."""
    return (F.when(score >= vocab.BAND_HIGH, "high").when(score >= vocab.BAND_MEDIUM, "medium")
            .when(score >= vocab.BAND_LOW, "low").otherwise("weak"))


def page_hint(pages: Column, *words: str) -> Column:
    """First page address holding one of the words, or null."""
    return F.get(F.filter(pages, lambda p: contains_any(F.lower(p), words)), 0)


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``opportunities``: the rules that fire, best score first, ties in rule order.

    Needs the flags ``sig_<name>`` and the columns pages, industry, audiences, workflows.
    """
    c = F.col
    s = lambda n: F.coalesce(signal(n), F.lit(False))
    flow = lambda n: F.array_contains("workflows", n)
    group = lambda n: F.array_contains("audiences", n)
    healthcare = c("industry") == "healthcare"
    reachable = s("email") | s("phone")

    # Per rule: when it fires, the page that raises its confidence, and its evidence
    # as (condition, code, argument).
    parts = {
        "appointment_lifecycle": (s("booking"), c("_booking_page"), [
            (F.lit(True), "booking_visible", F.lit("")),
            (c("_booking_page").isNotNull(), "booking_page", c("_booking_page")),
            (healthcare, "healthcare_model", F.lit("")), (reachable, "direct_contact", F.lit(""))]),
        "inquiry_conversion": (s("lead_form"), c("_contact_page"), [
            (F.lit(True), "form_visible", F.lit("")),
            (c("_contact_page").isNotNull(), "contact_page", c("_contact_page")),
            (reachable, "direct_contact", F.lit(""))]),
        "consultation_conversion": (flow("consultation") & ~s("lead_form") & ~s("booking"), None, [
            (F.lit(True), "consultation_described", F.lit(""))]),
        "intake_coordination": (flow("intake") | flow("referral"), None, [
            (flow("intake"), "intake_described", F.lit("")),
            (flow("referral"), "referral_described", F.lit(""))]),
        "audience_routing": (F.size("audiences") >= 2, None, [
            (F.lit(True), "audiences", F.array_join("audiences", ", ")),
            (group("referrers"), "referrers_addressed", F.lit(""))]),
        "recruitment_workflow": (flow("recruitment") | group("employees"), None, [
            (F.lit(True), "recruitment_visible", F.lit(""))]),
        "membership_conversion": (flow("membership") | group("members"), None, [
            (F.lit(True), "membership_visible", F.lit(""))]),
        "retention_reactivation": (flow("follow_up") | flow("recall"), None, [
            (flow("follow_up"), "follow_up_described", F.lit("")),
            (flow("recall"), "recall_described", F.lit(""))]),
        "reputation_follow_up": (
            s("reviews") & ~s("review_cta") & (s("booking") | s("lead_form") | s("services")), None, [
                (F.lit(True), "reviews_visible", F.lit("")), (F.lit(True), "no_review_request", F.lit(""))]),
        "commerce_lifecycle": (s("ecommerce"), None, [(F.lit(True), "transaction_visible", F.lit(""))]),
        "conversion_path": (
            s("contact_page") & ~s("lead_form") & ~s("booking") & ~s("ecommerce")
            & (s("services") | reachable), None, [
                (F.lit(True), "contact_visible", F.lit("")), (F.lit(True), "no_conversion_path", F.lit(""))]),
    }

    def candidate(number, rule):
        fires, page, notes = parts[rule.type]
        impact = F.lit(rule.impact) if rule.healthcare_impact is None else F.when(
            healthcare, rule.healthcare_impact).otherwise(rule.impact)
        confidence = F.lit(rule.confidence) if page is None else F.when(
            page.isNotNull(), rule.page_confidence).otherwise(rule.confidence)
        score = priority_score(impact, confidence, F.lit(rule.fit))
        found = F.array_compact(F.array(*[
            F.when(cond, F.struct(F.lit(code).alias("code"), arg.alias("arg"))) for cond, code, arg in notes]))
        return F.when(fires, F.struct(
            (-score).alias("_order"), F.lit(number).alias("rule_no"), F.lit(rule.type).alias("type"),
            F.lit(rule.title).alias("title"), band(score).alias("priority"), score.alias("score"),
            impact.alias("impact"), confidence.alias("confidence"), F.lit(rule.fit).alias("solution_fit"),
            found.alias("evidence"), F.array(*map(F.lit, rule.unknowns)).alias("unknowns"),
            F.lit(rule.action).alias("recommendation")))

    fired = F.array_compact(F.array(*[candidate(i, r) for i, r in enumerate(RULES, 1)]))
    return (
        df.withColumns({"_contact_page": page_hint(c("pages"), "contact"),
                        "_booking_page": page_hint(c("pages"), "book", "appointment", "schedule")})
        .withColumn("opportunities", F.transform(F.array_sort(fired), lambda o: o.dropFields("_order")))
        .drop("_contact_page", "_booking_page"))


def lead_score(df: DataFrame) -> DataFrame:
    """Adds opportunity_score, opportunity_band and score_breakdown from ``opportunities``."""
    top, second = F.get("opportunities", 0), F.get("opportunities", 1)
    score = F.coalesce(F.bround(top["score"].cast("double") * vocab.WEIGHT_TOP + F.coalesce(
        second["score"].cast("double") * vocab.WEIGHT_SECOND, F.lit(0.0))).cast("int"), F.lit(0))
    return (
        df.withColumn("opportunity_score", score)
        .withColumn("opportunity_band", F.when(F.size("opportunities") == 0, "weak").otherwise(
            band(F.col("opportunity_score"))))
        .withColumn("score_breakdown", F.struct(
            top["score"].alias("top_opportunity"), second["score"].alias("secondary_opportunity"),
            top["type"].alias("top_type"),
            F.when(F.size("opportunities") == 0, "no_opportunity").otherwise("strongest_opportunity").alias("reason"))))


def detect(df: DataFrame) -> DataFrame:
    """Opportunities and the lead score of analysed rows."""
    return lead_score(candidates(df))


def exploded(df: DataFrame, key: str) -> DataFrame:
    """The opportunity table: one row per lead and opportunity, with its rank."""
    return exploded_rows(df.select(key, "opportunities"), "opportunities").select(
        key, (F.col("pos") + 1).alias("rank"), "item.*")


def best_per_type(table: DataFrame, key: str) -> DataFrame:
    """One row per (key, type): the highest score, the earlier rule on a tie."""
    fields = [n for n in table.columns if n not in (key, "type")]
    return table.groupBy(key, "type").agg(
        F.max_by(F.struct(*fields), F.struct("score", -F.col("rule_no"))).alias("best")).select(key, "type", "best.*")


def ranked(table: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` by score within a key, ties in rule order; a key has at most one row per type."""
    return table.withColumn("rank", F.row_number().over(
        Window.partitionBy(key).orderBy(F.desc("score"), "rule_no")))


def overall_score(table: DataFrame, key: str) -> DataFrame:
    """score and band per key from a ranked opportunity table, as ``lead_score`` on rows."""
    at = lambda n, field: F.max(F.when(F.col("rank") == n, F.col(field)))
    two = table.where("rank <= 2").groupBy(key).agg(
        at(1, "score").alias("top"), at(2, "score").alias("second"), at(1, "type").alias("top_type"))
    score = F.bround(F.col("top") * vocab.WEIGHT_TOP + F.coalesce(
        F.col("second") * vocab.WEIGHT_SECOND, F.lit(0.0))).cast("int")
    return two.withColumn("score", score).withColumn("band", band(F.col("score")))


def outreach_payload(df: DataFrame) -> DataFrame:
    """website and ``payload`` (JSON) of rows with at least one opportunity."""
    payload = F.struct(
        "business_name", "industry", "services", "opportunity_score",
        F.transform(F.slice("opportunities", 1, 3), lambda o: o.dropFields("rule_no")).alias("top_opportunities"),
        "signals", F.col("evidence").alias("signal_evidence"), "website")
    return df.where(F.size("opportunities") > 0).select(
        "website", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
