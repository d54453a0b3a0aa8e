"""URL filters: longest allow or block rule for the host and path of each URL, by hashed expressions.

A URL is expanded into host suffixes times path directories ("com", "com/", "example.com/en/", ...), no deeper than
the deepest rule.  A rule is filed under its host and the directory part of its path.  Both sides join on the first
eight hex digits of the expression's SHA-256; the whole digest and the whole path of the rule are confirmed
after that, so a short-hash collision never decides.  Only DataFrame functions are used.

Null urls and urls without :// have empty host and path; no rule fits an empty host.  The longest rule string wins, then the
longer host, then block.  Repeated rows each get a row.  An empty rule table leaves every URL to the default.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 8
#: Up to so many rules are sent to every executor; larger lists join by a shuffle, salted on the URL side.
BROADCAST_RULES = 100_000
SALTS = 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return pages.select(F.col(id_col).alias("page_id"), rest.alias("rest")).select(
        "page_id", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), _UPPER, _UPPER.lower()).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))


def _directory(path):
    """The path up to its last slash."""
    return F.regexp_extract(path, "(?s)^.*/", 0)


def url_filters(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row; rules are (host, path, verdict)."""
    rules = rules.select("host", "path", "verdict").where("host <> ''").distinct().select(
        F.concat("host", "path").alias("rule"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"),
        "verdict", F.sha2(F.concat("host", _directory("path")), 256).alias("digest"))
    size = rules.agg(F.count("*").alias("rules"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
                     F.max(F.size(F.split("rule_path", "/"))).alias("parts")).first()
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    most_labels = F.least(F.size(labels), F.lit(size.labels or 1))
    most_parts = F.least(F.size(parts), F.lit(size.parts or 1)) - 1
    suffixes = F.transform(F.sequence(F.lit(1), most_labels),
                           lambda k: F.array_join(F.slice("labels", -k, k), "."))
    folders = F.transform(F.sequence(F.lit(0), most_parts),
                          lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice("parts", 1, k), "/"), F.lit("/"))))
    # Repeated rows are counted first; the aggregate at the end has the same keys and so needs no second shuffle.
    urls = split_url(pages, id_col, url_col).groupBy("page_id", "host", "path").agg(F.count("*").alias("rows"))
    key = ["page_id", "host", "path", "rows"]
    expanded = (urls.withColumn("labels", labels).withColumn("parts", parts)
                .select(*key, suffixes.alias("suffixes"), folders.alias("folders"))
                .select(*key, "folders", F.explode("suffixes").alias("suffix"))
                .select(*key, "suffix", F.explode("folders").alias("folder"))
                .select(*key, F.sha2(F.concat("suffix", "folder"), 256).alias("digest"))
                .withColumn("short", F.substring("digest", 1, DIGITS)))
    rules = rules.withColumn("short", F.substring("digest", 1, DIGITS)).withColumnRenamed("digest", "rule_digest")
    if size.rules <= BROADCAST_RULES:
        met = expanded.join(F.broadcast(rules), "short", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expanded.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(
            salted, ["short", "salt"], "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path")
    rank = F.struct(F.length("rule").alias("length"), F.length("rule_host").alias("host_length"),
                    (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = met.groupBy("page_id", "host", "path", "rows").agg(F.max(F.when(fits, rank)).alias("best"))
    best = best.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
