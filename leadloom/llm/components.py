"""Connected components of a distributed edge list, labelled by the smallest id reachable."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tables import stored


def lowest(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(hub, ``name``): the smallest ``value`` of each long ``key``.

    hub is worked out anew, so the join that follows shuffles both sides for itself and a hub's rows can be split.
    """
    return rows.groupBy(key).agg(F.min(value).alias(name)).select(F.expr(f"{key} ^ 0L").alias("hub"), name)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is the smallest node it is linked to.

    Star contraction: in each round a node's larger neighbours are hung on its smallest neighbour, then its
    smaller neighbours and itself are; the rounds end when the edges are stars.  Each round is two aggregates that
    combine before the shuffle and two joins whose edge side adaptive execution can split, so a hub with a third of
    all edges is no group in one task.  Each round is a written table, so lost executors cost one round.
    An empty edge list gives no rows.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        large = (both.join(lowest(both, "a", "b", "low"), F.col("a") == F.col("hub")).where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a <> b").distinct())
        low = lowest(large, "a", "b", "low")
        small = (large.join(low, F.col("a") == F.col("hub")).where("b <> low")
                 .select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(low.select(F.col("hub").alias("a"), F.col("low").alias("b"))).distinct())
        now = stored(small, "edges")
        # A checksum that doesn't depend on order tells whether the stars have changed.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.join(now.select(F.col("a").alias("node")), "node", "left_anti")).select("node", "component")
