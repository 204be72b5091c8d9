"""Positions inside large groups without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def each_of(df: DataFrame, keep: list[Column | str], array: Column, names: tuple[str, ...]) -> DataFrame:
    """The kept columns and one row for each element of an array: (place, element), or the element alone.

    By the outer form, whose empty rows are dropped after it: the inner one has the optimizer add a filter on the size
    of the array below it, so what makes the array (regular expressions, products) would be worked out twice.
    """
    made = F.posexplode_outer(array).alias(*names) if len(names) == 2 else F.explode_outer(array).alias(*names)
    return df.select(*keep, made).where(F.col(names[0]).isNotNull())


def running_offset(df: DataFrame, key: str, order: str, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """Add the sum of `value` over the rows of the same key that come before (unique integer `order`).

    Rows are cut in ranges of `order`; range totals are summed first, then rows inside their range, so a key that
    holds a third of the table still spreads over its ranges.
    """
    # one exchange serves the totals and the places
    cut = df.withColumn("__range", F.floor(F.col(order) / bucket)).withColumn("__value", value).repartition(F.col(key), F.col("__range"))
    totals = cut.groupBy(key, "__range").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(key, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(key, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.join(bases, [key, "__range"]).withColumn(name, F.col("__base") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return placed.drop("__range", "__value", "__base")
