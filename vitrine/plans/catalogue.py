"""Result pages of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapsed(page: DataFrame, key: str, parent: str) -> DataFrame:
    """A page without the children whose parent is on it; parents get ``n_children``. A row that is its own
    parent counts itself and stays."""
    on_page = page.select(F.col(key).alias("_k"))
    counts = page.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_k")).agg(F.count("*").alias("n_children"))
    children = page.join(on_page, F.col(parent) == F.col("_k"), "left_semi").where(F.col(parent) != F.col(key)).select(F.col(key).alias("_c"))
    kept = page.join(children, F.col(key) == F.col("_c"), "left_anti")
    return kept.join(counts, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def preview(rows: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """(key, total, preview): how many distinct items a key has, and the first few in order. Tasks keep the first
    few of each key before they are shuffled, so no long list is built or sorted."""
    from pyspark.sql import Window

    own = rows.select(key, item).distinct()
    first = own.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(item))).where(F.col("_i") <= most)
    shown = first.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("preview"))
    return own.groupBy(key).agg(F.count("*").alias("total")).join(shown, key)
