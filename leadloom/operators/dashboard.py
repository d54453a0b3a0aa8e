"""Dashboard queries over the lead snapshot."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadloom.functions import vocab
from leadloom.operators.opportunities import fallback_band

_NOTES = "array<struct<code:string, arg:string>>"
_FLAGS = ", ".join(f"{n}:boolean" for n in ["lead_form", *vocab.FEATURES])
OPPORTUNITY = ("struct<type:string, title:string, priority:string, score:int, impact:int, confidence:int, solution_fit:int, "
               f"evidence:{_NOTES}, unknowns:array<string>, recommendation:string>")
#: The stored analysis document, whole.
ANALYSIS_SCHEMA = f"""
    url string, business_name string, industry string, services array<string>, title string, description string,
    schema_types array<string>, signals struct<{", ".join(f"{n}:boolean" for n in vocab.SIGNALS)}>,
    signal_evidence map<string, {_NOTES}>, opportunity_score int, opportunity_score_band string,
    opportunity_score_breakdown struct<top_opportunity:int, secondary_opportunity:int, top_type:string, reason:string>,
    opportunities array<{OPPORTUNITY}>, content_length int, link_count int, pages_analyzed array<string>,
    page_details array<struct<url:string, features:struct<form_count:int, {_FLAGS}, cta_count:int>,
        emails:array<string>, phones:array<string>, text_preview:string>>,
    business_intelligence struct<analysis_version:string,
        business_profile:struct<industry:string, audiences:array<string>, services:array<string>>,
        customer_journey:array<string>,
        observed:struct<website_capabilities:array<string>, conversion_paths:array<string>, audiences:array<string>,
            workflows:array<string>, services:array<string>>,
        unknowns:array<string>,
        data_quality:struct<score:int, text_present:boolean, pages_analyzed:int, signal_count:int>>
"""
DEFAULT_ROWS, MAX_ROWS = 100, 500


def _fields(schema: str) -> list[tuple[str, str]]:
    """(name, type) of the top level of a schema text."""
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema).fields]


def documents(leads: DataFrame) -> DataFrame:
    """``document`` as a VARIANT instead of the JSON text; null when that is empty or broken.

    The text is parsed once; views read by path what they show and decode nothing else.
    """
    return leads.withColumn("document", F.try_parse_json("analysis_json")).drop("analysis_json")


def _read(path: str, kind: str) -> Column:
    return F.try_variant_get("document", f"$.{path}", kind)


def decode_analysis(leads: DataFrame) -> DataFrame:
    """``analysis`` struct with the whole document instead of the JSON text; null when that is empty or broken.

    A field of another type than expected is null by itself.
    """
    fields = [_read(name, kind).alias(name) for name, kind in _fields(ANALYSIS_SCHEMA)]
    return documents(leads).withColumn("analysis", F.when(F.col("document").isNotNull(), F.struct(*fields))).drop("document")


def recent(leads: DataFrame, limit: int = DEFAULT_ROWS) -> DataFrame:
    """The newest leads without their page text; the limit is held to 1..500."""
    return leads.drop("body_text").orderBy(F.desc("lead_id")).limit(max(1, min(limit, MAX_ROWS)))


def stats(leads: DataFrame) -> DataFrame:
    """Counts and mean score in one pass; the mean has one decimal, half to even."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return leads.agg(
        F.count(F.lit(1)).alias("total"), status("PENDING"), status("PROCESSING"), status("COMPLETED"),
        status("FAILED"), F.count_if(F.col("opportunity_score") >= vocab.BAND_HIGH).alias("high_opportunity"),
        F.bround(F.avg("opportunity_score"), 1).alias("average_score"))


def _first_text(*cols) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def shown_band() -> Column:
    return F.coalesce(F.nullif(_read("opportunity_score_band", "string"), F.lit("")),
                      fallback_band(F.coalesce("opportunity_score", F.lit(0))))


def rows(leads: DataFrame) -> DataFrame:
    """What the lead list shows per lead; needs ``documents``."""
    return leads.select(
        "lead_id",
        F.coalesce(_first_text("company_name", _read("business_name", "string")), F.lit("Unknown")).alias("name"),
        _first_text("website", "source_url").alias("address"), "status", "opportunity_score",
        F.when(F.col("opportunity_score").isNotNull(), shown_band()).alias("band"),
        F.array_compact(F.array(_first_text("emails"), _first_text("phones"))).alias("contacts"),
        F.slice(F.coalesce(_read("opportunities", f"array<{OPPORTUNITY}>"), F.expr(f"cast(array() as array<{OPPORTUNITY}>)")), 1, 4
                ).alias("top_opportunities"))


def detail(leads: DataFrame) -> DataFrame:
    """The detail view: one row per opportunity of a lead, one row if it has none; needs ``documents``."""
    return leads.select(
        "lead_id",
        F.coalesce(_first_text("company_name", _read("business_name", "string")), F.lit("Unknown")).alias("name"),
        F.coalesce(_first_text("website", "source_url"), F.lit("")).alias("address"), "status",
        "opportunity_score", shown_band().alias("band"),
        F.coalesce(_first_text("emails"), F.lit("Not found")).alias("email"),
        F.coalesce(_first_text("phones"), F.lit("Not found")).alias("phone"),
        _read("opportunity_score_breakdown.top_opportunity", "int").alias("top_opportunity"),
        _read("opportunity_score_breakdown.secondary_opportunity", "int").alias("secondary_opportunity"),
        F.posexplode_outer(_read("opportunities", f"array<{OPPORTUNITY}>")).alias("pos", "o"),
    ).select("*", *[F.col(f"o.{n}").alias(n) for n in (
        "type", "title", "priority", "score", "impact", "confidence", "evidence", "recommendation")]).drop("o")
