"""Streams over the events table, run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.plans.registry import query
from vitrine.sources import event_tree
from vitrine.streaming import events as E

#: What the watermark has passed at the end: ten minutes before the last event.
PASSED = "(select max(ts) - interval 10 minute from events)"


def stream(t):
    """The events, their times in the session's zone, as watermarks need."""
    return E.table_stream(t.spark, f"{t.folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df):
    """Times without a zone again, as in the table."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


@query(f"""select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type, count(*) as n, round(sum(value), 4) as total
  from events group by 1, 2, 3 having time_bucket(interval 1 hour, ts) + interval 1 hour <= {PASSED}""")
def stream_tumbling(t):
    """Hourly counts by type, windows that the watermark has closed."""
    found = E.windowed(stream(t), "ts", ["event_type"], {"n": F.count("*"), "total": F.sum("value")}, "1 hour")
    return plain(E.finished(found, "tumbling")).withColumn("total", F.round("total", 4))


@query(f"""with w as (select time_bucket(interval 15 minute, ts) - s * interval 15 minute as window_start, value from events, range(4) as r(s))
  select window_start, window_start + interval 1 hour as window_end, count(*) as n, max(value) as top from w group by 1, 2 having window_start + interval 1 hour <= {PASSED}""")
def stream_sliding(t):
    """Counts over an hour, every quarter of an hour."""
    found = E.windowed(stream(t), "ts", [], {"n": F.count("*"), "top": F.max("value")}, "1 hour", "15 minutes")
    return plain(E.finished(found, "sliding"))


@query(f"""with g as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 1800000000 then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
  s as (select *, sum(new) over (partition by user_id order by ts range between unbounded preceding and current row) as i from g)
  select user_id, min(ts) as started, max(ts) + interval 30 minute as closed, count(*) as n from s group by user_id, i having max(ts) + interval 30 minute <= {PASSED}""")
def stream_session(t):
    """Sessions of users, closed ones."""
    return plain(E.finished(E.sessions(stream(t), "ts", "user_id", {"n": F.count("*")}), "sessions"))


@query("select event_id, ts, user_id, event_type from events qualify row_number() over (partition by event_id order by ts) = 1")
def stream_dedup(t):
    """Events that a feed delivers twice, once."""
    once = stream(t).select("event_id", "ts", "user_id", "event_type")
    return plain(E.finished(E.without_repeats(once.unionByName(once), "ts", ["event_id"], "40 days"), "dedup"))


@query("select user_id, event_id, event_type, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1 and event_type <> 'error'")
def stream_dedup_latest(t):
    """A change feed into a table: the last event of each user, unless it is a deletion."""
    log, progress = E.folders(t.spark, "feed")
    E.applied(stream(t).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], log, progress)
    rows = E.current(t.spark, log, "user_id", ["ts", "event_id"])
    return plain(rows.where("event_type <> 'error'").select("user_id", "event_id", "event_type", "ts"))


EDGES = [10.0, 50.0, 100.0, 500.0]


@query(f"""select time_bucket(interval 1 day, ts) as window_start, time_bucket(interval 1 day, ts) + interval 1 day as window_end, event_type, case when value <= 10 then 10.0 when value <= 50 then 50.0 when value <= 100 then 100.0 else 500.0 end::double as bucket, count(*) as n
  from events where value is not null group by 1, 2, 3, 4 having time_bucket(interval 1 day, ts) + interval 1 day <= {PASSED}""")
def stream_latencies(t):
    """Daily histograms of values by type."""
    return plain(E.finished(E.latencies(stream(t), "ts", "event_type", "value", EDGES), "latencies"))


def planted(rows, folder: str) -> None:
    """Events as a tree of changes: users are the objects, errors delete them. One page a line, days split by ranges."""
    member = F.struct(F.when(F.col("event_type") == "error", "Delete").when(F.col("event_type") == "signup", "Create").otherwise("Update").alias("@type"),
                      F.struct(F.concat(F.lit("https://example.org/"), "user_id", F.lit("?_profile=framed")).alias("@id")).alias("object"), F.struct("event_id").alias("@graph"))
    pages = rows.select(*(F.date_part(F.lit(p), "ts").cast("int").alias(p) for p in ("year", "month", "day")), "ts", "event_id", F.to_json(F.struct(F.array(member).alias("member"))).alias("value"))
    order = ["year", "month", "day", "ts", "event_id"]
    pages.repartitionByRange(*order).sortWithinPartitions(*order).select("value", "year", "month", "day").write.mode("append").partitionBy("year", "month", "day").text(folder)


HALF = "(select min(ts)::date + ((max(ts)::date - min(ts)::date) // 2)::int from events)"


@query(f"""select ts::date as day, case event_type when 'error' then 'Delete' when 'signup' then 'Create' else 'Update' end as kind, count(*) as n, count(distinct user_id) as objects, min(event_id) as first_id
  from events where user_id is not null and ts >= {HALF} and ts < {HALF} + 5 group by 1, 2""")
def src_event_tree(t):
    """Changes of five days from a tree of days: other years, months and days aren't listed."""
    folder, _ = E.folders(t.spark, "tree")
    planted(t.events.where("user_id is not null and ts is not null"), folder)
    half = t.events.select(F.date_add(F.min("ts").cast("date"), F.floor(F.date_diff(F.max("ts").cast("date"), F.min("ts").cast("date")) / 2).cast("int")).alias("d")).select("d", F.date_add("d", 5).alias("e")).first()
    rows = event_tree.changes(t.spark, folder, str(half["d"]), str(half["e"]))
    return rows.groupBy("day", "kind").agg(F.count("*").alias("n"), F.countDistinct("object").alias("objects"), F.min(F.get_json_object("payload", "$.event_id").cast("long")).alias("first_id"))


@query("select 'https://example.org/' || user_id as object, event_id from events where user_id is not null and ts is not null qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1 and event_type <> 'error'")
def stream_event_tree(t):
    """Objects after a tree of changes is followed in two runs: the second goes on behind the file where the first ended."""
    folder, _ = E.folders(t.spark, "tree")
    log, progress = E.folders(t.spark, "objects")
    rows = t.events.where("user_id is not null and ts is not null")
    day = rows.select(F.percentile_approx(F.unix_date(F.col("ts").cast("date")), 0.5).alias("d"))
    early = F.unix_date(F.col("ts").cast("date")) <= F.lit(day.first()["d"])
    for part in (early, ~early):
        planted(rows.where(part), folder)
        found = event_tree.followed(t.spark, folder, log, progress, "framed")
    return found.select("object", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))
