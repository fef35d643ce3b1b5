"""Places in an order, over the whole table or within groups of any size, without one task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.hierarchy import kept


def places(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``place`` (from 1, within the groups; without groups over all rows) and ``group_rows``.

    Rows are dealt out by ranges of group and order, a hash breaking ties so that equal rows can be split, and
    kept. Each range counts its rows by group (one row a range and group travels), the counts are summed up
    range by range, and a row's place is the sum before its range plus its place there. Rows that are equal
    in groups and order get different places in no particular order.
    """
    keys = [F.col(g).asc_nulls_first() for g in groups]
    whole = [F.col(g) for g in groups]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    ranges = salted.repartitionByRange(*keys, *order, F.col("_salt")) if groups or order else salted
    dealt = kept(ranges.withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range", *groups).agg(F.count("*").alias("_n"))
    each = Window.partitionBy(*(whole or [F.lit(1)]))
    before = each.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("group_rows", F.sum("_n").over(each)).drop("_n")
    renamed = counts.select(F.col("_range").alias("_r"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "_before", "group_rows")
    inside = F.row_number().over(Window.partitionBy("_range", *whole).orderBy(*order, "_salt"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = dealt.withColumn("_in", inside).join(renamed, same)
    return out.withColumn("place", (F.col("_before") + F.col("_in")).cast("long")).drop("_salt", "_range", "_in", "_r", "_before", *(f"_g{i}" for i in range(len(groups))))
