"""Statistics: dimensions with coverage and percentages, facets, percentiles, scores, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators import ranking


def dimension(rows: DataFrame, label: Column, entity: str, total: Column | int | None = None) -> DataFrame:
    """(label, n, pct): distinct entities by label, most first in reading order; null labels are no bucket.
    Percentages are of ``total``, or of all entities that have a row."""
    pool = rows.select(F.count_distinct(entity).alias("_total")) if total is None else None
    out = rows.where(label.isNotNull()).groupBy(label.alias("label")).agg(F.count_distinct(entity).alias("n"))
    if pool is not None:
        return out.crossJoin(F.broadcast(pool)).select("label", "n", F.round(100 * F.col("n") / F.col("_total"), 1).alias("pct"))
    return out.select("label", "n", F.round(100 * F.col("n") / F.lit(total), 1).alias("pct"))


def coverage(entities: DataFrame, rows: DataFrame, label: Column, key: str, row_key: str) -> DataFrame:
    """One row: entities with and without a bucket, and the number of buckets."""
    found = rows.where(label.isNotNull()).select(F.col(row_key).alias("_k"), label.alias("_label"))
    have = found.join(entities.select(F.col(key).alias("_k")), "_k", "left_semi")
    counts = have.agg(F.count_distinct("_k").alias("with_bucket"), F.count_distinct("_label").alias("total_buckets"))
    return counts.crossJoin(F.broadcast(entities.agg(F.count_distinct(key).alias("_n")))).select("with_bucket", (F.col("_n") - F.col("with_bucket")).alias("without_bucket"), "total_buckets")


def facets(rows: DataFrame, dims: dict[str, Column], top: int) -> DataFrame:
    """(dim, label, n, pct): the most frequent labels of several dimensions in one pass over the rows.
    Percentages are within the dimension; ties go to the smaller label."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), c.cast("string").alias("label")) for d, c in dims.items()))
    counted = rows.select(F.explode(pairs).alias("p")).where("p.label is not null").groupBy("p.dim", "p.label").count()
    order = Window.partitionBy("dim").orderBy(F.desc("count"), "label")
    share = F.col("count") / F.sum("count").over(Window.partitionBy("dim"))
    ranked = counted.withColumn("rank", F.row_number().over(order)).withColumn("pct", F.round(100 * share, 1))
    return ranked.where(F.col("rank") <= top).select("dim", "label", F.col("count").alias("n"), "pct")


def top_per_group(counts: DataFrame, group: str, label: str, n: str, top: int) -> DataFrame:
    """The ``top`` rows of each group by count, ties to the smaller label; adds ``rank``."""
    order = Window.partitionBy(group).orderBy(F.desc(n), label)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def nearest_rank(rows: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """(group, n, min_v, max_v, p50, ...): the value at place int(n * p / 100), from 0, of each sorted group.
    Places come from a distributed ranking, so a group of any size is spread over tasks."""
    ranked = ranking.places(rows.where(F.col(value).isNotNull()).select(group, value), [group], [F.col(value)])
    at = lambda p: F.max(F.when(F.col("place") - 1 == F.least(F.floor(F.col("group_rows") * p / 100), F.col("group_rows") - 1), F.col(value)))
    return ranked.groupBy(group).agg(F.max("group_rows").alias("n"), F.min(value).alias("min_v"), F.max(value).alias("max_v"), *(at(p).alias(f"p{p}") for p in percents))


def histogram_percentile(rows: DataFrame, group: str, value: str, edges: list[float], percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(group, p50, ...): upper edge of the bucket in which the running count crosses a percentage. Values
    above the last edge count into it."""
    bucket = F.lit(len(edges) - 1)
    for i in range(len(edges) - 1, -1, -1):
        bucket = F.when(F.col(value) <= edges[i], F.lit(i)).otherwise(bucket)
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, bucket.alias("bucket")).count()
    w = Window.partitionBy(group)
    running = counts.withColumn("upto", F.sum("count").over(w.orderBy("bucket"))).withColumn("total", F.sum("count").over(w))
    upper = F.element_at(F.array(*(F.lit(float(e)) for e in edges)), F.col("bucket") + 1)
    return running.groupBy(group).agg(*(F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, upper)).alias(f"p{p}") for p in percents))


def importance(entities: DataFrame, key: str, flags: dict[str, int], counts: list[tuple[DataFrame, str, str, int]]) -> DataFrame:
    """(key, score): weighted flags plus capped counts of (rows, key, name, cap) elsewhere."""
    out = entities.select(key, *flags)
    score = sum((F.when(F.col(c), w).otherwise(0) for c, w in flags.items()), F.lit(0))
    for rows, row_key, name, cap in counts:
        n = rows.groupBy(F.col(row_key).alias(key)).agg(F.count("*").alias(name))
        out = out.join(n, key, "left")
        score = score + F.least(F.coalesce(F.col(name), F.lit(0)), F.lit(cap))
    return out.select(key, score.cast("long").alias("score"))


def audit(rows: DataFrame, checks: list[tuple[str, Column, int | None, int | None]]) -> DataFrame:
    """(check, n, verdict): rows for which each condition holds, against [low, high]: PASS, else WARN if some
    are found, else FAIL; no bounds: SKIP. One pass over the rows."""
    counts = rows.agg(*(F.count_if(c).alias(f"c{i}") for i, (_, c, _, _) in enumerate(checks)))
    entries = []
    for i, (name, _, low, high) in enumerate(checks):
        n = F.col(f"c{i}")
        if low is None and high is None:
            verdict = F.lit("SKIP")
        else:
            good = (n >= (low or 0)) & ((n <= high) if high is not None else F.lit(True))
            verdict = F.when(good, "PASS").when(n > 0, "WARN").otherwise("FAIL")
        entries.append(F.struct(F.lit(name).alias("check"), n.alias("n"), verdict.alias("verdict")))
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def document_frequency(rows: DataFrame, term: str, doc: str) -> DataFrame:
    """(term, df, n_docs, idf): in how many documents a term occurs, and ln(N / df)."""
    total = rows.agg(F.count_distinct(doc).alias("n_docs"))
    return rows.groupBy(F.col(term).alias("term")).agg(F.count_distinct(doc).alias("df")).crossJoin(F.broadcast(total)).withColumn("idf", F.log(F.col("n_docs") / F.col("df")))


def pattern_inventory(rows: DataFrame, text: str, patterns: dict[str, str], examples: int = 3) -> DataFrame:
    """(pattern, n, samples): how many rows match each pattern, and the first few texts in order that do."""
    hits = F.filter(F.array(*(F.when(F.col(text).rlike(p), F.lit(name)) for name, p in patterns.items())), lambda x: x.isNotNull())
    found = rows.select(F.col(text).alias("t"), F.explode(hits).alias("pattern"))
    counts = found.groupBy("pattern").agg(F.count("*").alias("n"))
    first = found.distinct().withColumn("i", F.row_number().over(Window.partitionBy("pattern").orderBy("t"))).where(F.col("i") <= examples)  # tasks keep their first few before the shuffle
    return counts.join(first.groupBy("pattern").agg(F.array_sort(F.collect_list("t")).alias("samples")), "pattern")


def shared_prefixes(rows: DataFrame, text: str, mark: str = "(", least: int = 3) -> DataFrame:
    """(prefix, n): what at least ``least`` texts have in common before a mark, as parts of one whole do."""
    prefix = F.trim(F.substring_index(F.col(text), mark, 1))
    return rows.where(F.col(text).contains(mark)).groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def covered(rows: DataFrame, group: str, entity: str, condition: Column) -> DataFrame:
    """(group, n, n_covered, share): entities of each group, and those with a row on which the condition holds."""
    out = rows.groupBy(group).agg(F.count_distinct(entity).alias("n"), F.count_distinct(F.when(condition, F.col(entity))).alias("n_covered"))
    return out.withColumn("share", F.round(F.col("n_covered") / F.col("n"), 4))
