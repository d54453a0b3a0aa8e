"""Reading the raw tables, the crawl log and the lead snapshot."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import delete


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Raw pages: page_id, url, html."""
    return table(spark, folder, "pages").select("page_id", "url", "html")


def admission(crawl: DataFrame) -> DataFrame:
    """Adds ``verdict`` to a crawl log (url, status_code, content_type, html).

    The checks run in this order: empty_url, bad_scheme, http_error, not_html, ok.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    url = F.coalesce("url", F.lit(""))
    return crawl.withColumn("verdict", (
        F.when(url == "", "empty_url")
        .when(~(url.startswith("http://") | url.startswith("https://")), "bad_scheme")
        .when(F.col("status_code") >= 400, "http_error")
        .when(~(kind.contains("text/html") | kind.contains("application/xhtml+xml")), "not_html")
        .otherwise("ok")))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a snapshot, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    names = [f.getPath().getName() for f in system.listStatus(place)]
    done = [n for n in names if n.startswith("v=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The newest complete version; a column that its older files lack is null there.

    Before the first version it is empty, with ``schema``.
    """
    versions = _versions(spark, path)
    if not versions and schema is not None:
        return spark.createDataFrame([], schema)
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/v={versions[-1]}" if versions else path)


def write_snapshot(leads: DataFrame, path: str, keep: int = 2) -> None:
    """Write the next version to a folder of its own, then drop all but the newest ``keep``.

    A plan that still reads the version before is never disturbed, and a write that fails leaves no version.
    """
    spark = leads.sparkSession
    versions = _versions(spark, path)
    leads.write.mode("overwrite").parquet(f"{path}/v={versions[-1] + 1 if versions else 0}")
    for old in _versions(spark, path)[:-keep]:
        delete(spark, f"{path}/v={old}")


#: Parts of lead tables, by a hash of the lead's id.
PARTS = 16


def part(lead_id: Column) -> Column:
    return F.pmod(F.xxhash64(lead_id), F.lit(PARTS)).cast("int")


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders below ``path`` that start so."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
    return sorted(n for n in names if n.startswith(prefix))


def read_parts(spark: SparkSession, path: str, schema: str, parts: list[int] | None = None) -> DataFrame:
    """The newest version of every part (or of ``parts``), each read from the version that wrote it last."""
    found = {}
    for version in reversed(_versions(spark, path)):
        for name in _folders(spark, f"{path}/v={version}", "part="):
            if parts is None or int(name[5:]) in parts:
                found.setdefault(name, f"{path}/v={version}/{name}")
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*found.values()).drop("v")


def write_parts(rows: DataFrame, path: str, keep: int = 2, bloom: tuple = ()) -> None:
    """Write the parts that ``rows`` touch as the next version; other parts stay in the versions that hold them.

    A part goes once it has been written again by ``keep`` - 1 later versions at least, so a reader is not disturbed.
    """
    spark = rows.sparkSession
    versions = _versions(spark, path)
    number = versions[-1] + 1 if versions else 0
    writer = rows.repartition("part").sortWithinPartitions("part", "lead_id").write
    for name in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.partitionBy("part").mode("overwrite").parquet(f"{path}/v={number}")
    held = set()  # parts that versions old enough for every reader hold
    for version in reversed([v for v in _versions(spark, path) if v <= number - keep + 1]):
        names = set(_folders(spark, f"{path}/v={version}", "part="))
        if names <= held:
            delete(spark, f"{path}/v={version}")
        for name in names & held:
            delete(spark, f"{path}/v={version}/{name}")
        held |= names


def merged_snapshot(old: DataFrame, changed: DataFrame, key: str = "lead_id", order: str = "last_seq") -> DataFrame:
    """Old and changed rows folded to the last one per key; either side may lack columns."""
    both = with_added_columns(old, changed)
    fields = [n for n in both.columns if n != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("row")).select(key, "row.*")


def with_added_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new lead rows; a column only one of them has is null in the other."""
    return old.unionByName(new, allowMissingColumns=True)
