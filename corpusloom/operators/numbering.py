"""Numbers within groups where one group may hold most of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """rows with their place from 1 within their group, by order; rows of a null group form a group.

    Rows are cut into ranges of (group, order) of about equal size, so a large group spreads over many ranges. A range's
    rows are counted for each group, and a row's number is that of the rows in the ranges before plus its place in its own:
    no task sorts more than a range, and only counts pass from range to range. The ranges are written once, as both the
    counts and the places have to see the same ones. Rows equal in group and order take numbers in any order.
    """
    spark, ranges = rows.sparkSession, work_folder(rows.sparkSession, "ranges")
    cut = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    cut.write.parquet(ranges)
    cut = spark.read.schema(cut.schema).parquet(ranges)
    sizes = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")
    before = sizes.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col("_range").alias("_r"), earlier.alias("_before"))
    placed = cut.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(group)], F.col("_range") == F.col("_r"))
    return placed.join(before, same).withColumn(name, F.col("_before") + F.col("_place")).select(*rows.columns, name)
