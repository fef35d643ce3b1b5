"""Curated changes played onto freshly parsed ownership histories: each finds its event by the content it was made
for, not by its place, which may have moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.hierarchy import kept
from vitrine.operators.provenance import CATEGORY, lookup
from vitrine.operators.sequences import duplicate_ordinals

#: Columns of an event that operations may set.
FIELDS = ["transfer_type", "location", "date_expression", "date_year", "date_qualifier", "price_amount", "price_currency", "unsold", "uncertain"]
#: The type of a text that says nothing about ownership.
NO_EVENT = "non_provenance"


def located(chain: DataFrame, operations: DataFrame, key: str) -> DataFrame:
    """Operations with ``at``, the sequence of the event that they were made for, and ``status``: applied, text_changed
    (no event of the chain has that text), copies_changed (other than ``dup_count`` events have it) or no_such_copy."""
    ids = duplicate_ordinals(chain.select(key, "sequence", "raw_text").where("raw_text is not null"), F.col("raw_text"), key, "sequence")
    ids = ids.select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"), F.col("dup_ordinal").alias("_o"), F.col("dup_count").alias("_n"), F.col("sequence").alias("at"))
    texts = ids.where("_o = 1").select(F.col("_k").alias("_kt"), F.col("_h").alias("_ht"), F.col("_n").alias("_copies"))
    out = operations.join(texts, (F.col(key) == F.col("_kt")) & (F.col("content_hash") == F.col("_ht")), "left")
    out = out.join(ids.drop("_n"), (F.col(key) == F.col("_k")) & (F.col("content_hash") == F.col("_h")) & (F.col("dup_ordinal") == F.col("_o")), "left")
    status = F.when(F.col("_copies").isNull(), "text_changed").when(~F.col("_copies").eqNullSafe(F.col("dup_count")), "copies_changed").when(F.col("at").isNull(), "no_such_copy").otherwise("applied")
    return out.withColumn("status", status).drop("_kt", "_ht", "_copies", "_k", "_h", "_o")


def last(op: str | list[str], value: Column, when: Column | None = None) -> Column:
    """What the last operation of a kind says, as an aggregate."""
    mine = F.col("op").isin(op)
    return F.max(F.when(mine if when is None else mine & when, F.struct(F.col("op_id"), value.alias("v"))))


def written(chain: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``chain`` with fields set by ``changes``: (key, at, one struct column ``to_<field>`` each)."""
    out = chain.join(changes.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("sequence") == F.col("at")), "left")
    new = {f: F.when(F.col(f"to_{f}").isNotNull(), F.col(f"to_{f}")["v"].try_cast(chain.schema[f].dataType)).otherwise(F.col(f)) for f in FIELDS}
    return out.withColumns(new).drop("_k", "at", *(f"to_{f}" for f in FIELDS))


def fields_of(operations: DataFrame, key: str, op: str) -> DataFrame:
    return operations.groupBy(key, "at").agg(*(last(op, F.col("value"), F.col("field") == f).alias(f"to_{f}") for f in FIELDS))


def replayed(chain: DataFrame, operations: DataFrame, key: str, least: float = 0.7, reverted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, report): ``chain`` (as ``provenance.events`` gives it) after a log of operations, and (op, status, n).

    Operations: key, op_id (their order), content_hash (SHA-256 of the event's raw_text), dup_ordinal and dup_count (which of how many
    events of the chain with that text), op, field, value, expected, parties, target, parts, confidence. Stages follow each other,
    whatever the order of the log; within one the last operation counts:

    1. ``set``: ``field`` becomes ``value``, cast to its type.
    2. ``parties``: ``parties`` take the place of the event's.
    3. ``correct``: as ``set``, if the field's value, as text, then equals ``expected`` (nulls do); ``receiver``: ``parties`` are
       added behind the others, in the order of the log.
    4. ``mark``: the event is none of ownership; ``merge``: the event goes, and the event with sequence ``target`` takes ``value`` as
       location, if there is one; ``alternative``: the event goes and ``target`` becomes uncertain.
    5. ``split``: the event is replaced by ``parts`` (texts) that have its other columns; this looks for the event among those left.

    Then chains are numbered anew from 1. Operations of less confidence than ``least``, or of none, count as ``unsure``, those in
    ``reverted`` (op_id) as ``reverted``, a correction that finds another value as ``value_changed``; other kinds are ``unknown``.
    A split into no part changes nothing. Chains with a null key take no operations; repeated operations each count in the report.
    """
    kinds = ["set", "parties", "correct", "receiver", "mark", "merge", "alternative", "split"]
    ops = operations.withColumn("_early", F.when(~F.coalesce(F.col("op").isin(kinds), F.lit(False)), "unknown").when(F.coalesce(F.col("confidence") < least, F.lit(True)), "unsure"))
    if reverted is not None:
        back = reverted.toDF("_r").where("_r is not null").distinct()
        ops = ops.join(back, F.col("op_id") == F.col("_r"), "left").withColumn("_early", F.coalesce(F.when(F.col("_r").isNotNull(), "reverted"), "_early")).drop("_r")
    chain = kept(chain)
    early = ops.where("_early is not null").select("op", F.col("_early").alias("status"))
    ops = ops.where("_early is null").drop("_early")
    first = kept(located(chain, ops.where("op <> 'split'"), key))
    done = first.where("status = 'applied'")

    out = written(chain, fields_of(done.where("op = 'set'"), key, "set"), key)
    spots = done.where("op = 'correct'")
    values = F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.col(f).cast("string"))))
    there = out.select(F.col(key).alias("_k"), F.col("sequence").alias("_s"), values.alias("_values"))
    spots = kept(spots.join(there, (F.col(key) == F.col("_k")) & (F.col("at") == F.col("_s")), "left").withColumn("_fits", F.try_element_at("_values", F.col("field")).eqNullSafe(F.col("expected"))))
    out = written(out, fields_of(spots.where("_fits"), key, "correct"), key)

    people = done.groupBy(key, "at").agg(
        last("parties", F.col("parties")).alias("_people"), F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.col("op") == "receiver") & F.col("parties").isNotNull(), F.struct("op_id", F.col("parties").alias("v"))))), lambda x: x["v"])).alias("_more"),
        F.bool_or(F.col("op") == "mark").alias("_mark"), F.bool_or(F.col("op").isin("merge", "alternative")).alias("_gone"),
    ).withColumnRenamed(key, "_k")
    out = out.join(people, (F.col(key) == F.col("_k")) & (F.col("sequence") == F.col("at")), "left")
    own = F.coalesce(F.col("_people")["v"], F.col("parties"), F.col("_more"))
    everyone = F.when(F.col("_people")["v"].isNotNull() | F.col("parties").isNotNull(), F.concat(own, F.coalesce("_more", F.slice("_more", 1, 0), F.array().cast(chain.schema["parties"].dataType)))).otherwise(own)
    kind = F.when(F.coalesce("_mark", F.lit(False)), NO_EVENT).otherwise(F.col("transfer_type"))
    out = out.withColumns({"parties": everyone, "transfer_type": kind}).where(~F.coalesce("_gone", F.lit(False))).drop("_k", "at", "_people", "_more", "_mark", "_gone")

    aims = done.where("op in ('merge', 'alternative')").groupBy(F.col(key).alias("_k"), F.col("target").alias("_t")).agg(last("merge", F.col("value"), F.col("value").isNotNull()).alias("_where"), F.bool_or(F.col("op") == "alternative").alias("_or"))
    out = out.join(aims, (F.col(key) == F.col("_k")) & (F.col("sequence") == F.col("_t")), "left")
    out = out.withColumns({"location": F.coalesce(F.col("_where")["v"], "location"), "uncertain": F.coalesce(F.col("uncertain"), F.lit(False)) | F.coalesce("_or", F.lit(False))}).drop("_k", "_t", "_where", "_or")
    out = kept(out.withColumn("transfer_category", F.when(F.col("transfer_type") == NO_EVENT, F.lit(None).cast("string")).otherwise(F.coalesce(lookup(CATEGORY, F.col("transfer_type")), "transfer_category"))))

    cut = kept(located(out, ops.where("op = 'split'"), key))
    parts = cut.where("status = 'applied' and size(parts) > 0").groupBy(F.col(key).alias("_k"), "at").agg(last("split", F.col("parts")).alias("_parts"))
    out = out.join(parts, (F.col(key) == F.col("_k")) & (F.col("sequence") == F.col("at")), "left")
    out = out.select(*chain.columns, F.posexplode(F.coalesce(F.col("_parts")["v"], F.array("raw_text"))).alias("_i", "_text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("sequence", "_i"))
    events = out.withColumns({"_n": number, "raw_text": F.col("_text")}).withColumn("sequence", F.col("_n").cast(chain.schema["sequence"].dataType)).drop("_i", "_text", "_n")

    told = first.where("op <> 'correct' or status <> 'applied'").select("op", "status")
    told = told.unionByName(spots.select("op", F.when(F.col("_fits"), "applied").otherwise("value_changed").alias("status")))
    told = told.unionByName(cut.select("op", "status")).unionByName(early)
    return events, told.groupBy("op", "status").agg(F.count("*").alias("n"))
