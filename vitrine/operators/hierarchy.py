"""Trees of (id, parent): descendants, ancestors, inheritance. Loops of joins that stop when nothing is new;
each step keeps only its frontier, so cycles end and work follows the tree's size, not its paths."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session may name none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="vitrine-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from the shared folder, so that lineage doesn't grow with the rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def descendants(tree: DataFrame, roots: DataFrame, key: str, parent: str, depth: int = 10) -> DataFrame:
    """(id, depth): the roots (one column of ids) at depth 0 and what stands below them, to a depth."""
    edges = tree.select(F.col(key).alias("_id"), F.col(parent).alias("_p")).where("_p is not null and _id <> _p")
    level = roots.toDF("id").distinct().withColumn("depth", F.lit(0))
    found = kept(level)
    level = found
    for d in range(1, depth + 1):
        below = edges.join(level, edges["_p"] == level["id"]).select(F.col("_id").alias("id")).distinct()
        level = kept(below.join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def first_ancestor(tree: DataFrame, key: str, parent: str, wanted: Column, depth: int = 6) -> DataFrame:
    """(id, ancestor, depth): the nearest node on the way up (itself at depth 0) for which ``wanted`` holds;
    nodes without one are left out."""
    nodes = tree.select(F.col(key).alias("_n"), F.col(parent).alias("_up"), F.coalesce(wanted, F.lit(False)).alias("_ok"))
    open_ = nodes.select(F.col("_n").alias("id"), F.col("_n").alias("at"))
    found = None
    for d in range(depth + 1):
        here = open_.join(nodes, open_["at"] == nodes["_n"])
        hit = here.where("_ok").select("id", F.col("at").alias("ancestor"), F.lit(d).alias("depth"))
        found = hit if found is None else found.unionByName(hit)
        open_ = kept(here.where("not _ok and _up is not null and _up <> at").select("id", F.col("_up").alias("at")))
        if open_.isEmpty():
            break
    return found


def inherited(tree: DataFrame, key: str, parent: str, lat: str, lon: str, blocked: Column | None = None, depth: int = 10) -> DataFrame:
    """(id, lat, lon, method): coordinates, where missing taken from the parent, round after round; parents for
    which ``blocked`` holds (too large to stand for a place) give none."""
    bar = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
    have = tree.select(F.col(key).alias("id"), F.col(parent).alias("_p"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), bar.alias("_bar"))
    have = kept(have.withColumn("method", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), "own")))
    for d in range(1, depth + 1):
        givers = have.where("method is not null and not _bar").select(F.col("id").alias("_g"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        gain = have.where("method is null").join(givers, F.col("_p") == F.col("_g")).select("id", "_p", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "_bar", F.lit(f"inherited:{d}").alias("method"))
        gain = kept(gain)
        if gain.isEmpty():
            break
        have = kept(have.join(gain.select("id"), "id", "left_anti").unionByName(gain))
    return have.select("id", "lat", "lon", "method")


BOUND = 500  # roots whose intervals are written into the plan; more are joined


def labelled(tree: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """Labels that make descendants a range, to be stored: (id, path, level, lo, hi), and the edges (id, parent) that are
    not part of the labelled forest.

    Each node hangs below its smallest parent; further parents of a node, and of each cycle the edge above its smallest
    node, are the other edges. ``path`` leads from the root to the node, ``lo`` numbers the nodes in the order of their
    paths from 1, and what stands at or below a node is numbered ``lo`` to ``hi``. Parents that are no node, null
    keys and a node as its own parent count for nothing; repeated rows count once.

    Paths are found by doubling, in rounds of the logarithm of the depth, and hold as many ids as the node is deep. Cycles are
    cut before, without paths; only nodes with others below them take part, the rest get theirs by one join.
    """
    ids = tree.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    edges = tree.select(F.col(key).alias("id"), F.col(parent).alias("parent")).where("id is not null and parent is not null and id <> parent").distinct()
    edges = kept(edges.join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent"))
    nodes = ids.join(edges.groupBy("id").agg(F.min("parent").alias("up")), "id", "left")
    loops = cuts(nodes)
    if loops is not None:
        nodes = nodes.join(loops.withColumn("_loop", F.lit(True)), "id", "left").select("id", F.when(F.col("_loop").isNull(), F.col("up")).alias("up"))
    nodes = kept(nodes)
    parents = nodes.where("up is not null").select(F.col("up").alias("id")).distinct()
    inner = climbed(nodes.join(parents, "id", "left_semi"))
    leaves = nodes.join(parents, "id", "left_anti")
    least = leaves.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("_n"))
    each = inner.join(least, "id", "left").select(F.explode("path").alias("id"), (1 + F.coalesce("_n", F.lit(0))).alias("_n"))
    sizes = each.groupBy("id").agg(F.sum("_n").alias("size"))
    ends = leaves.join(inner.select(F.col("id").alias("up"), "path"), "up", "left").select("id", F.concat(F.coalesce("path", F.slice(F.array("id"), 1, 0)), F.array("id")).alias("path"), F.lit(1).cast("long").alias("size"))
    from vitrine.operators.ranking import places

    at = places(inner.join(sizes, "id").select("id", "path", "size").unionByName(ends), [], [F.col("path")])
    labels = kept(at.select("id", "path", (F.size("path") - 1).alias("level"), F.col("place").alias("lo"), (F.col("place") + F.col("size") - 1).alias("hi")))
    return labels, edges.join(nodes.select("id", F.col("up").alias("parent")).where("parent is not null"), ["id", "parent"], "left_anti")


def cuts(nodes: DataFrame) -> DataFrame | None:
    """(id): the smallest node of each cycle of (id, up), if there are any. Steps are doubled, and of the nodes only those
    stay that others lead to, so that after rounds of the logarithm of the depth the cycles alone are left."""
    step = kept(nodes.where("up is not null").select("id", F.col("up").alias("at")))
    n = step.count()
    while n:
        inner = step.join(step.select(F.col("at").alias("id")).distinct(), "id", "left_semi")
        step = kept(inner.join(inner.select(F.col("id").alias("_id"), F.col("at").alias("_at")), F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at")))
        before, n = n, step.count()
        if n == before:
            break
    if not n:
        return None
    walk = kept(nodes.join(step, "id", "left_semi").select("id", F.col("up").alias("at"), F.least("id", "up").alias("low")))
    while True:
        to = walk.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("low").alias("_low"))
        walk = kept(walk.join(to, F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("less")))
        if walk.where("less").isEmpty():
            return walk.where("id = low").select("id")


def climbed(nodes: DataFrame) -> DataFrame:
    """(id, path from the root to it) for (id, up) without cycles, in which each up is an id."""
    start = F.when(F.col("up").isNotNull(), F.array("up")).otherwise(F.slice(F.array("id"), 1, 0))
    walk = kept(nodes.select("id", F.col("up").alias("at"), start.alias("above")))
    while not (open_ := walk.where("at is not null")).isEmpty():
        step = walk.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("above").alias("_above"))
        further = open_.join(step, F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at"), F.concat("above", "_above").alias("above"))
        walk = kept(further.unionByName(walk.where("at is null")))
    return walk.select("id", F.concat(F.reverse("above"), F.array("id")).alias("path"))


def either(tests: list[Column]) -> Column:
    """Whether one of ``tests`` holds; halves of halves, as a chain of hundreds overflows the stack of the planner."""
    half = len(tests) // 2
    return either(tests[:half]) | either(tests[half:]) if half else tests[0]


def below(labels: DataFrame, others: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth): the roots (one column of ids) at depth 0 and what stands below them, to a depth, by stored
    labels (see ``labelled``); the rows are those of ``descendants``. Roots that are no node are left out.

    Up to ``BOUND`` roots are looked up and their ranges stand in the plan, so that a table stored in the order of
    ``lo`` is read there alone; the nearest root on a node's path tells the depth. Other edges whose parent is found
    lead on to further ranges, round after round, until no node comes closer.
    """
    seeds = roots.toDF("id").where("id is not null").distinct().withColumn("depth", F.lit(0))
    found, plain = None, others.isEmpty()
    while True:
        start = labels.join(seeds, "id").select("id", "lo", "hi", F.col("depth").alias("_d"), F.col("level").alias("_l"))
        few = start.limit(BOUND + 1).collect()
        if not few:
            break
        rows = labels
        if len(few) <= BOUND:
            spans, spots = [], sorted((r["lo"], r["hi"]) for r in few)
            for lo, hi in spots:  # a range within the one before it adds nothing
                if not spans or lo > spans[-1][1]:
                    spans.append((lo, hi))
            rows = labels.where(either([F.col("lo").between(lo, hi) for lo, hi in spans]))
        tops = start.select(F.col("id").alias("_root"), (F.col("_d") - F.col("_l")).alias("_less"))
        near = F.col("path") if depth is None else F.slice("path", F.greatest(F.col("level") + 1 - depth, F.lit(1)), depth + 1)
        each = rows.select("id", "level", F.explode(near).alias("_root")).join(F.broadcast(tops) if len(few) <= BOUND else tops, "_root")
        new = each.groupBy("id").agg(F.min(F.col("level") + F.col("_less")).cast("int").alias("depth"))
        new = new if depth is None else new.where(F.col("depth") <= depth)
        if plain:
            return new
        found = new if found is None else found.unionByName(new).groupBy("id").agg(F.min("depth").alias("depth"))
        found = kept(found)
        next_ = others.join(found.withColumnRenamed("id", "parent"), "parent").groupBy("id").agg((F.min("depth") + 1).cast("int").alias("depth"))
        next_ = next_ if depth is None else next_.where(F.col("depth") <= depth)
        before = found.select("id", F.col("depth").alias("_known"))
        seeds = kept(next_.join(before, "id", "left").where("_known is null or depth < _known").select("id", "depth"))
    return found if found is not None else seeds.limit(0)
