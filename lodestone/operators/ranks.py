"""Exact ranks of very large or very skewed groups without ordering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import write_table

RANGES = 256


def running_counts(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Distinct values per group with their count ``n`` and the number of rows ``before`` them.

    Equal values collapse to one row first.  Distinct values are cut into ranges at sampled quantiles, counted
    inside a range, and shifted by the sizes of the ranges before it.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    # Written once: ranges and offsets read the same cuts even where a task is computed again.
    cuts = write_table(counted.groupBy(*groups).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 4096).alias("_cuts")), "cuts")
    ranged = counted.join(cuts, groups).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = ranged.groupBy(*groups, "_range").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, [*groups, "_range"]).withColumn(
        "before", F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("_range", "_offset")


def percent_ranks(rows: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """(groups, value, name): rows before the value over rows less one; a group of one row ranks 1."""
    counts = running_counts(rows, groups, value)
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("_total"))
    rank = F.when(F.col("_total") <= 1, 1.0).otherwise(F.col("before") / (F.col("_total") - 1))
    return counts.join(totals, groups).select(*groups, value, rank.alias(name))
