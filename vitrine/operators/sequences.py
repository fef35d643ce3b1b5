"""Ordered rows: sessions, periods, renumbering, differences, patches, sampling, request and response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str, ts: str, gap_s: int = 1800) -> DataFrame:
    """``events`` with ``session_no`` (from 1 a user): a pause longer than the gap starts a session."""
    w = Window.partitionBy(user).orderBy(ts)
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    new = F.when(pause.isNull() | (pause > gap_s * 1_000_000), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def periods(events: DataFrame, chain: str, order: list[str], begin: str) -> DataFrame:
    """``events`` with ``period_end``: the begin of the chain's next event; the last one's is open (null)."""
    w = Window.partitionBy(chain).orderBy(*order)
    return events.withColumn("period_end", F.lead(begin).over(w))


def renumbered(rows: DataFrame, group: str, order: list[str], name: str = "sequence") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def duplicate_ordinals(rows: DataFrame, content: Column, group: str, order: str) -> DataFrame:
    """``rows`` with a content hash, the ordinal of equal contents within a group, and their number."""
    hashed = rows.withColumn("content_hash", F.sha2(content.cast("string"), 256))
    w = Window.partitionBy(group, "content_hash")
    return hashed.withColumn("dup_ordinal", F.row_number().over(w.orderBy(order))).withColumn("dup_count", F.count("*").over(w))


def difference(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, status): unchanged, modified, new or removed, by a null-safe comparison of content hashes."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    a = old.select(F.col(key).alias("_a"), digest.alias("_x"))
    b = new.select(F.col(key).alias("_b"), digest.alias("_y"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_x").eqNullSafe(F.col("_y")), "unchanged").otherwise("modified")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def field_drift(live: DataFrame, kept: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, live, kept): fields whose trimmed values differ, nulls compared as values."""
    long = lambda df, name: df.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias(name)) for f in fields))).alias("e")).select(key, "e.*")
    both = long(live, "live").join(long(kept, "kept"), [key, "field"])
    return both.where(~F.col("live").eqNullSafe(F.col("kept")))


def patched(rows: DataFrame, patches: DataFrame, content: Column, field: str, least: float = 0.7) -> DataFrame:
    """``rows`` with values of one field replaced by patches (content_hash, field, value, confidence) of enough
    confidence, the surest first; adds ``patched``."""
    best = Window.partitionBy("content_hash").orderBy(F.desc("confidence"), "value")
    own = patches.where((F.col("field") == field) & (F.col("confidence") >= least))
    own = own.withColumn("_i", F.row_number().over(best)).where("_i = 1").select(F.col("content_hash").alias("_h"), F.col("value").alias("_v"))
    out = rows.withColumn("_h", F.sha2(content.cast("string"), 256)).join(own, "_h", "left")
    kind = rows.schema[field].dataType
    return out.withColumn("patched", F.col("_v").isNotNull()).withColumn(field, F.coalesce(F.col("_v").cast(kind), F.col(field))).drop("_h", "_v")


def gap_filled(rows: DataFrame, sources: list[DataFrame], key: str, field: str) -> DataFrame:
    """``rows`` with a field filled from (key, value) sources in order of priority, where it is null; adds
    ``filled_from`` (0: its own)."""
    out, value, origin = rows, F.col(field), F.when(F.col(field).isNotNull(), 0)
    for i, s in enumerate(sources, 1):
        out = out.join(s.toDF(key, f"_v{i}"), key, "left")
        origin = F.coalesce(origin, F.when(F.col(f"_v{i}").isNotNull(), i))
        value = F.coalesce(value, F.col(f"_v{i}"))
    return out.withColumn("filled_from", origin).withColumn(field, value).drop(*(f"_v{i}" for i in range(1, len(sources) + 1)))


def answered(turns: DataFrame, chat: str, turn: str, role: str, asks: str = "user", answers: str = "assistant") -> DataFrame:
    """(chat, ask_turn, answer_turn): every request with the first answer before the next request. A running
    count of requests pairs them, without a join."""
    w = Window.partitionBy(chat).orderBy(turn)
    epoch = turns.withColumn("_epoch", F.count_if(F.col(role) == asks).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    pairs = epoch.where("_epoch > 0").groupBy(chat, "_epoch").agg(F.min(F.when(F.col(role) == asks, F.col(turn))).alias("ask_turn"), F.min(F.when(F.col(role) == answers, F.col(turn))).alias("answer_turn"))
    return pairs.drop("_epoch")


def stratified(rows: DataFrame, stratum: str, order: Column, caps: dict[str, int] | int) -> DataFrame:
    """The first rows of each stratum in a given order, up to its cap."""
    cap = F.lit(caps) if isinstance(caps, int) else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in caps.items() for x in p)), F.col(stratum)), F.lit(0))
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("_i") <= cap).drop("_i")


def quota_sample(rows: DataFrame, cell: str, weight: Column, order: Column, n: int) -> DataFrame:
    """A sample of about n rows in which each cell has round(n * w * size / sum), at least one, at most all."""
    sizes = rows.groupBy(cell).agg(F.count("*").alias("_size"), F.max(weight).alias("_w"))
    share = n * F.col("_w") * F.col("_size") / F.sum(F.col("_w") * F.col("_size")).over(Window.partitionBy(F.lit(1)))
    quotas = sizes.select(cell, F.least(F.greatest(F.round(share), F.lit(1)), F.col("_size")).cast("long").alias("_quota"))
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(cell).orderBy(order))).where(F.col("_i") <= n)  # no quota is larger, so tasks keep their first n only
    return ranked.join(quotas, cell).where("_i <= _quota").drop("_i", "_quota")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; the maximum of a struct, so rows are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in {key, *order}]
    top = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return top.select(key, *(F.col(f"_m.{c}").alias(c) for c in [*order, *rest]))
