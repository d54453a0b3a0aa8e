"""Parsed pages in bucketed tables that the lead job reads without moving them.

``captures`` are kept twice: a light table that decides which captures count, and their payload.  Both are bucketed by
``slot``, a hash of the site's domain and a second level: pages of a domain with many pages are dealt out over ``splits``
slots by a hash of their address, so no domain is one file or one task.  Each bucket is a folder as well, so a small
batch of leads reads the buckets of its sites alone.  ``links`` holds source pages with their official link.

Every load is a folder of its own and replaces itself when it is written again, by a batch job or by a stream; several
writers don't disturb one another.  A load's payload is complete before its light rows, and these before its arrivals.
"""

import hashlib
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import urls
from leadloom.operators import sites
from leadloom.session import delete, stored

#: What the layout fixes for good: buckets of the tables, slots of a large domain, and the pages that make it large.
BUCKETS, SPLITS, LARGE_DOMAIN = 64, 16, 100_000
PLACE = ("bucket", "slot")
ARRIVALS = "url string, arrived timestamp, load string"


@contextmanager
def _configured(spark: SparkSession, **settings: str):
    """SQL settings for the jobs run inside."""
    names = {n: f"spark.sql.{n.replace('__', '.')}" for n in settings}
    before = {n: spark.conf.get(key, None) for n, key in names.items()}
    for n, value in settings.items():
        spark.conf.set(names[n], value)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(names[n], value) if value is not None else spark.conf.unset(names[n])


class PageStore:
    """The tables of one folder.  The layout of a folder that has one already counts, not the arguments."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, splits: int = SPLITS, large_domain: int = LARGE_DOMAIN):
        self.spark, self.path = spark, path.rstrip("/")
        self.tag = "pages_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        if not self._there("layout"):
            spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(splits).alias("splits"), F.lit(large_domain).cast("long").alias("large_domain")
                                  ).write.mode("overwrite").parquet(f"{self.path}/layout")
        self.buckets, self.splits, self.large_domain = spark.read.parquet(f"{self.path}/layout").first()

    def _there(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    # --- tables ---------------------------------------------------------------

    def _table(self, name: str, columns: str | None = None) -> str | None:
        """The catalogue's name of a bucketed table; it is entered where this session doesn't know it yet."""
        table = f"{self.tag}_{name}"
        if not self.spark.catalog.tableExists(table):
            if columns is None:
                if not self._there(f"{name}_columns"):
                    return None
                columns = self.spark.read.parquet(f"{self.path}/{name}_columns").first()[0]
            elif not self._there(f"{name}_columns"):
                self.spark.range(1).select(F.lit(columns)).write.mode("overwrite").parquet(f"{self.path}/{name}_columns")
            self.spark.sql(f"CREATE TABLE {table} ({columns}, load string, bucket int) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
                           f"PARTITIONED BY (load, bucket) CLUSTERED BY (slot) SORTED BY (slot, url) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return table

    def _write(self, name: str, rows: DataFrame, load: str) -> None:
        kept = rows.select(*[n for n in rows.columns if n != "bucket"], F.lit(load).alias("load"), "bucket")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name not in ("load", "bucket"))
        table = self._table(name, columns)
        kept.repartition(self.buckets, "slot").write.mode("overwrite").insertInto(table)  # the load's folders alone, see _table

    def _read(self, name: str) -> DataFrame | None:
        table = self._table(name)
        if table is None:
            return None
        self.spark.catalog.refreshTable(table)  # other writers
        return self.spark.table(table)

    # --- writing --------------------------------------------------------------

    def append(self, load: str, captures: DataFrame | None = None, sources: DataFrame | None = None, arrived: Column | None = None) -> None:
        """Add newly parsed pages: rows of ``enrichment.parsed_captures`` and ``enrichment.parsed_sources``.

        ``load`` names what is added; written again it replaces itself.  ``arrived`` is when, by default now.
        """
        addresses = []
        if captures is not None:
            parsed = stored(captures.drop(*PLACE).withColumn("domain", F.coalesce(urls.site_domain(F.col("url")), F.lit(""))), "arriving")
            self._put("counts", parsed.groupBy("domain").agg(F.count("*").alias("pages")), load)
            placed = self._placed(parsed).drop("domain")
            self._write("payload", placed.select("slot", *sites.CAPTURE, "page", "bucket"), load)
            self._write("light", sites.light(placed, "slot", "bucket"), load)
            # Only pages that can finish a lead are told of.
            addresses.append(parsed.where("(channel = 'browser' and not blank) or usable").select("url"))
        if sources is not None:
            read = stored(sources.select("url", "page_id", "official"), "arriving-sources")
            self._put("links", read, load)
            addresses.append(read.select("url"))
        if addresses:
            told = addresses[0] if len(addresses) == 1 else addresses[0].union(addresses[1])
            told = told.where("url is not null").distinct().withColumn("arrived", F.current_timestamp() if arrived is None else arrived)
            self._put("arrivals", told.withColumn("load", F.lit(load)), load)

    def tick(self, name: str, at: Column) -> None:
        """Tell the arrivals' readers how late it is while no page comes: an arrival at no address.

        The address is empty, not null, for a join drops null keys before its watermark sees them.
        """
        self._put("arrivals", self.spark.range(1).select(F.lit("").alias("url"), at.alias("arrived"), F.lit(name).alias("load")), name)

    def _put(self, name: str, rows: DataFrame, load: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/of={load}")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Adds slot and bucket; needs url and domain."""
        split = F.when(F.col("large"), F.pmod(F.xxhash64("url"), F.lit(self.splits)).cast("int") + 1).otherwise(0)
        return self._slots(rows.join(F.broadcast(self.large_domains()), "domain", "left").withColumn("split", split)).drop("large", "split")

    def _slots(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", F.xxhash64("domain", "split")).withColumn("bucket", F.pmod(F.hash("slot"), F.lit(self.buckets)))

    def compact(self, into: str) -> None:
        """Unite all bucketed loads so far in the load ``into``; readers meanwhile see rows twice, which changes no result."""
        for name in ("payload", "light"):
            rows = self._read(name)
            if rows is None:
                continue
            loads = [r.load for r in rows.select("load").distinct().collect()]  # folder names
            self._write(name, rows.where(F.col("load") != into).unionByName(rows.where(F.col("load") == into)).drop("load"), into)
            for load in loads:
                if load != into:
                    delete(self.spark, f"{self.path}/{name}/load={load}")

    # --- reading --------------------------------------------------------------

    def _folder(self, name: str, schema: str) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def large_domains(self) -> DataFrame:
        """(domain, large) of the domains whose later pages are dealt out; there are at most pages / large_domain of them."""
        return (self._folder("counts", "domain string, pages long").groupBy("domain").agg(F.sum("pages").alias("n"))
                .where(F.col("n") >= self.large_domain).select("domain", F.lit(True).alias("large")))

    def links(self) -> DataFrame:
        """The source pages read so far: url, page_id, official."""
        return self._folder("links", "url string, page_id long, official string").select("url", "page_id", "official")

    def _in_buckets(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """``rows`` of the buckets of ``keys``, read from these folders alone; at most as many numbers as buckets."""
        found = [r.bucket for r in keys.select("bucket").distinct().collect()]
        return rows if len(found) == self.buckets else rows.where(F.col("bucket").isin(found))

    def assemble(self, websites: DataFrame, use_browser: bool = True) -> DataFrame:
        """Merged site rows as ``sites.assemble`` gives them.

        Payload is joined and gathered in its buckets, without an exchange; only sites whose pages lie in several slots (of
        a domain that has grown large) are put together by one.
        """
        captures, payload = self._read("light"), self._read("payload")
        if captures is None or payload is None:
            empty = self.spark.createDataFrame([], "page_id long, url string, html string, channel string")
            return sites.assemble(websites, sites.parsed_captures(empty), use_browser)
        domains = websites.select(F.coalesce(urls.site_domain(F.col("website")), F.lit("")).alias("domain")).distinct()
        every = F.sequence(F.lit(0), F.lit(self.splits))
        slots = stored(self._slots(domains.join(F.broadcast(self.large_domains()), "domain", "left").withColumn(
            "split", F.explode(F.when(F.col("large"), every).otherwise(F.array(F.lit(0)))))).select(*PLACE), "slots")
        near = self._in_buckets(captures, slots).join(slots, list(PLACE), "left_semi").drop("load")
        picks = stored(sites.picked(*sites.site_tables(websites, near, use_browser), use_browser, PLACE), "picks")
        keys = stored(sites.wanted_captures(picks), "wanted")
        with self.in_place():
            part = stored(self.gathered_in_place(payload, keys), "gathered")
        whole = F.size(F.array_compact(F.array(*[f"page{r}" for r in sites.RANKS]))) == F.col("n_picks")
        spread = part.where(~whole).groupBy("website").agg(*[F.any_value(n, True).alias(n) for n in part.columns if n not in ("slot", "website")])
        found = part.where(whole).drop("slot").unionByName(spread)
        return sites.merged_sites(found.unionByName(sites.unread(picks, found)))

    def in_place(self):
        """Settings under which Spark joins by all keys but partitions by ``slot`` alone, as the tables are."""
        return _configured(self.spark, requireAllClusterKeysForCoPartition="false", join__preferSortMergeJoin="false")

    def gathered_in_place(self, payload: DataFrame, keys: DataFrame) -> DataFrame:
        """The picked pages of each website and slot."""
        fetched = self._in_buckets(payload, keys).drop("load").join(keys, [*PLACE, *sites.CAPTURE])
        return sites.gathered(fetched, "slot")
