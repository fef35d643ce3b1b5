"""What the operators of this package share: the shared folder, cutting lineage, components, files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where neither that setting nor the context may name one, a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="vitrine-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; whoever writes there makes it."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from reliable storage: later stages don't depend on the executors that made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str, per_file: int = 0) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: like ``cut``, for larger tables. ``per_file``: most rows
    of a file, for rows of megabytes."""
    path = fresh_dir(df.sparkSession, what)
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def open_store(path: str):
    """(file system, path in it) for a path or URI that tasks can write to."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def attached(rows: DataFrame, small: DataFrame, key: str, value: str, total: int, salt: str) -> DataFrame:
    """``rows`` with ``value`` of ``small`` (key, value, n: how many of ``total`` rows have the key), null where there is none.

    Keys with more than a thousandth of the rows, a thousand at most, come by a broadcast and don't gather their rows
    in one task: those are dealt by ``salt``, any other column. The rest is shuffled. Where no key can have as many, it is one
    plain join.
    """
    if total <= 1000:
        return rows.join(small.select(F.col(key).alias("_ck"), F.col(value)), F.col(key) == F.col("_ck"), "left").drop("_ck")
    hot = small.where(F.col("n") > max(1000, total // 1000)).select(F.col(key).alias("_hk"), F.col(value).alias("_hv"))
    some = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    some = some.withColumn("_salt", F.when(F.col("_hk").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(salt), F.lit(1 << 30))).cast("long"))
    cold = small.select(F.col(key).alias("_ck"), F.col(value).alias("_cv"), F.lit(0).cast("long").alias("_cs"))
    out = some.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_salt") == F.col("_cs")), "left")
    return out.withColumn(value, F.coalesce("_hv", "_cv")).drop("_hk", "_hv", "_ck", "_cv", "_cs", "_salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (columns a, b of one orderable type).

    Alternating large-star and small-star rounds: every round is two joins and two aggregations whose
    rows are bounded by the edges, and hubs are only ever reduced to a minimum, never gathered (``attached``).
    Each half of a round is stored: the second reads the first at four places, and the driver would hold its plan as often.
    The rounds end when the edges are stars. Returns (node, root): each node of an edge with the smallest
    node that it reaches, roots included. No edges: no rows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, n = None, edges.count()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = cut(attached(both.where("b > a"), low, "a", "m", 2 * n, "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = attached(large, down, "a", "m", 2 * n, "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen, n = now, now["n"]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
