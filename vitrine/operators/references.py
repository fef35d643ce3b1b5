"""Histories that say only where the history stands: at another work. Words before a work's number tell it, and
the works that are meant are followed to the one that has a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.hierarchy import kept

#: Words that may stand between a word that points and the number it points to.
BETWEEN = ["the", "provenance", "of", "for", "to", "inv", "cat", "no", "nr", "also", "de", "herkomst", "van", "voor", "ook"]
POINTS = ["see", "zie"]
BELOW = ["under", "onder"]
LIKE, SAME = ["as", "als"], ["same", "dezelfde"]
PAIR, BOTH = ["pendant", "companion", "counterpart"], ["both", "together"]
NUMBER = r"[A-Za-z]{1,3}-(?:[A-Za-z]{1,2}-)?\d+(?:[.-]\d+)*[A-Za-z]?"


def words(text: Column) -> Column:
    """The words and work numbers of a text, in order; a number's parts are joined by hyphens, which those
    in small letters need to have."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", " ")
    joined = F.regexp_replace(plain, r"\b([A-Z]{1,3})[ -]+(?=(?:[A-Z]{1,2}[ -]+)?\d)", "$1-")
    joined = F.regexp_replace(joined, r"-([A-Z]{1,2}) +(?=\d)", "-$1-")
    return F.regexp_extract_all(joined, F.lit(rf"{NUMBER}|\p{{L}}+"), 0)


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, not again at every place that reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def target(text: Column) -> Column:
    """The number of the work that a text refers to for its history, or null. Three forms: a word that points (see,
    zie, see under) before it, a history that is the same as that of it, and both works of a pair whose other one it is."""

    def tests(back: Column, at: Column) -> Column:
        one, two = F.get(back, at), F.get(back, at + 1)
        after = lambda n: F.slice(back, at + 2, F.lit(n))
        some = lambda n, wanted: F.arrays_overlap(after(n), F.array(*(F.lit(w) for w in wanted)))
        return F.coalesce(one.isin(POINTS) | (one.isin(BELOW) & two.isin(POINTS)) | (one.isin(LIKE) & some(3, SAME)) | (one.isin(PAIR) & some(1 << 20, BOTH)), F.lit(False))

    def pointed(back: Column) -> Column:
        skipped = F.size(back) - F.size(F.array_except(back, F.array(*(F.lit(w) for w in BETWEEN))))  # bound on what can be skipped
        starts = F.filter(F.sequence(F.lit(0), skipped), lambda k: ~F.coalesce(F.get(back, k).isin(BETWEEN), F.lit(False)))
        return let(F.get(starts, F.lit(0)), lambda at: tests(back, at))

    def meant(found: Column) -> Column:
        back = lambda i: F.transform(F.reverse(F.slice(found, 1, i - 1)), F.lower)
        spots = F.filter(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))), lambda i: F.coalesce(F.get(found, i - 1).rlike(rf"^{NUMBER}$") & let(back(i), pointed), F.lit(False)))
        return F.get(found, F.get(spots, F.lit(0)) - 1)

    return let(words(text), meant)


def same(number: Column) -> Column:
    """A work's number without what is written in different ways: case, spaces and hyphens."""
    return F.nullif(F.upper(F.regexp_replace(number.cast("string"), r"[\s-]+", "")), F.lit(""))


def resolved(works: DataFrame, number: str, text: str) -> DataFrame:
    """(number, target, source, hops, status) of every work: the work that its text refers to, the number at which the
    references end, and how many there were. Status: ``own`` (its text refers to none), ``resolved``, ``missing`` (no work
    has the number at which they end), ``cycle`` (they come back; no source).

    References are followed by doubling, so a line of n takes log n rounds. Numbers are compared without case, spaces
    and hyphens; of works that share one, one with a history of its own is preferred. Works without a number are ``own`` or go
    where they refer to; null texts are histories of their own. Repeated rows stay.
    """
    rows = kept(works.select(F.col(number), target(F.col(text)).alias("target")).withColumns({"_id": same(F.col(number)), "_up": same(F.col("target"))}))
    up = F.when(F.count("_up") == F.count("*"), F.min("_up"))
    nodes = rows.where("_id is not null").groupBy(F.col("_id").alias("id")).agg(up.alias("up"))
    ends = followed(nodes).toDF("_t", "_end", "_n", "_round")
    there = nodes.select(F.col("id").alias("_known"))
    out = rows.join(ends, F.col("_up") == F.col("_t"), "left")
    end = F.when(F.col("_up").isNull(), F.col("_id")).otherwise(F.coalesce("_end", "_up"))
    out = out.withColumn("_end", end).join(there, F.col("_end") == F.col("_known"), "left")
    turns = F.coalesce("_round", F.lit(False))
    status = F.when(F.col("_up").isNull(), "own").when(turns, "cycle").when(F.col("_known").isNull(), "missing").otherwise("resolved")
    hops = F.when(F.col("_up").isNull(), 0).when(~turns, F.coalesce(F.col("_n"), F.lit(0)) + 1)
    return out.select(number, "target", F.when(~turns, F.col("_end")).alias("source"), hops.cast("int").alias("hops"), status.alias("status"))


def followed(nodes: DataFrame) -> DataFrame:
    """(id, end, n, round) for each of (id, up) that has an up: where its ups lead, which need not be an id, and after how many steps.
    ``round``: they come to a cycle; end and n are then of no use.

    Steps are doubled, without paths, which don't end in cycles. A round that finds no new end is the last one, as an end further
    away would mean that this round found one half as far.
    """
    ups = nodes.where("up is not null")
    on = ups.select(F.col("id").alias("_id"), F.lit(True).alias("_on"))
    walk = kept(ups.join(on, F.col("up") == F.col("_id"), "left").select("id", F.col("up").alias("end"), F.lit(1).cast("long").alias("n"), F.col("_on").isNotNull().alias("round")))
    before, left = None, walk.where("round").count()
    while left and left != before:
        to = walk.toDF("_id", "_end", "_n", "_round")
        further = walk.where("round").join(to, F.col("end") == F.col("_id")).select("id", F.col("_end").alias("end"), (F.col("n") + F.col("_n")).alias("n"), F.col("_round").alias("round"))
        walk = kept(further.unionByName(walk.where("not round")))
        before, left = left, walk.where("round").count()
    return walk


def lent(events: DataFrame, key: str, found: DataFrame, number: str) -> DataFrame:
    """Events (with ``key``, the work's number) of works that have a history, and for works that refer to one (``found``,
    from ``resolved``) the events of its source, with ``source``."""
    named = events.withColumn("_s", same(F.col(key))).drop(key)
    takers = found.where("status in ('own', 'resolved') and source is not null").select(F.col(number).alias(key), "source").distinct()
    return takers.join(named, F.col("source") == F.col("_s")).drop("_s").select(*events.columns, "source")
