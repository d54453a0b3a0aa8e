"""Numbering that stays balanced whatever the ids look like."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import stored


def numbered_spans(df: DataFrame, order: str, size: Column, after: Column, name: str = "first_id") -> DataFrame:
    """Adds ``name``: each row takes ``size`` consecutive ids after ``after``, in the order of a unique column.

    Rows are dealt out by ranges of the order column and stored with their partition's number, for a range
    partition is drawn from a sample.  They are summed inside partitions; only one total per partition meets in a
    single task, whatever the ids look like.
    """
    dealt = stored(df.withColumn("_size", size).repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(F.sum("_size").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
            .join(F.broadcast(offsets), "_part")  # a row per partition
            .withColumn(name, (after + F.col("_before") + F.col("_inside") + 1).cast("long"))
            .drop("_part", "_inside", "_before", "_size"))


def numbered(df: DataFrame, order: str, name: str, after: Column) -> DataFrame:
    """Consecutive numbers following ``after`` in the order of a unique column."""
    return numbered_spans(df, order, F.lit(1), after, name)
