"""Report rows: nine text-friendly columns per lead, appended or updated by id."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import vocab
from leadloom.session import stored


def _or(c, default) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def _joined(c) -> Column:
    return F.array_join(F.filter(F.coalesce(c, F.expr("cast(array() as array<string>)")),
                                 lambda x: x.isNotNull() & (x != "")), ", ")


def preview(text: Column) -> Column:
    """First 500 characters, with dots only if there is more."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > vocab.PREVIEW_CHARS, F.concat(F.substring(t, 1, vocab.PREVIEW_CHARS), F.lit("..."))
                  ).otherwise(t)


def report_rows(leads: DataFrame, with_text: bool = True) -> DataFrame:
    """Rows for the report; an update leaves the text cell empty."""
    return leads.select(
        "lead_id", _or("company_name", "Unknown").alias("company"), _or("source_url", "").alias("source"),
        _or("website", "").alias("website"), _joined("emails").alias("emails"), _joined("phones").alias("phones"),
        _or("status", "").alias("status"),
        (preview(F.col("text")) if with_text else F.lit("")).alias("text"),
        F.coalesce(F.col("opportunity_score").cast("string"), F.lit("")).alias("score"))


def updated_report(report: DataFrame, changes: DataFrame) -> DataFrame:
    """``report`` with the rows of changed leads replaced, new ones appended.

    ``changes`` hold one row per lead.
    """
    return report.join(changes.select("lead_id"), "lead_id", "left_anti").unionByName(
        report_rows(changes, with_text=False))


#: Lead ids per partition of a report table.
SPAN = 10_000


def _spanned(rows: DataFrame, span: int) -> DataFrame:
    return rows.withColumn("span", F.floor(F.col("lead_id") / span).cast("long"))


def write_report_table(rows: DataFrame, path: str, span: int = SPAN) -> None:
    """A report that can be updated in place: Parquet, partitioned by ranges of lead ids."""
    _spanned(rows, span).repartition("span").sortWithinPartitions("span", "lead_id").write.partitionBy("span").mode("errorifexists").parquet(path)


def read_report_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("span")


def update_report_table(path: str, changes: DataFrame, span: int = SPAN) -> None:
    """``updated_report`` in place: only the id ranges of changed leads are read and written again.

    ``changes`` hold one row per lead.  The new ranges are complete before they replace the old ones.
    """
    spark = changes.sparkSession
    changed = stored(_spanned(changes, span), "report-changes")
    report = spark.read.parquet(path)
    touched = report.join(changed.select("span").distinct(), "span", "left_semi")  # prunes the folders
    merged = stored(_spanned(updated_report(touched.drop("span"), changed.drop("span")), span), "report-spans")
    (merged.repartition("span").sortWithinPartitions("span", "lead_id").write.partitionBy("span")
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


def write_report(rows: DataFrame, path: str, format: str = "csv") -> None:
    writer = rows.write.format(format).mode("errorifexists")
    (writer.option("header", "true").option("quoteAll", "true") if format == "csv" else writer).save(path)
