from vitrine.streaming import events as E

SCHEMA = "k string, ts timestamp, v int, deleted boolean"


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def added(spark, folder, rows):
    import datetime as d

    made = [(k, d.datetime(2024, 1, 1, 0, 0) + d.timedelta(minutes=m), v, gone) for k, m, v, gone in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_a_change_feed_goes_on_where_it_ended(spark, tmp_path):
    folder, log, progress = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "progress")
    added(spark, folder, [("a", 0, 1, False), ("b", 0, 2, False)])
    E.applied(stream(spark, folder), "k", ["ts"], log, progress)
    added(spark, folder, [("a", 5, 9, False), ("b", 6, None, True), ("a", 4, 8, False)])
    E.applied(stream(spark, folder), "k", ["ts"], log, progress)
    E.applied(stream(spark, folder), "k", ["ts"], log, progress)
    rows = E.current(spark, log, "k", ["ts"], "deleted").collect()
    assert [(r["k"], r["v"]) for r in rows] == [("a", 9)]


def test_late_rows_are_left_out_and_windows_come_once(spark, tmp_path):
    from pyspark.sql import functions as F

    folder, rows, progress = (str(tmp_path / n) for n in ("in", "rows", "progress"))
    run = lambda: E.finished(E.windowed(stream(spark, folder), "ts", [], {"n": F.count("*")}, "10 minutes", delay="5 minutes"), to=rows, progress=progress)
    added(spark, folder, [("a", 1, 1, False), ("a", 9, 1, False), ("a", 30, 1, False)])
    assert [r["n"] for r in run().collect()] == [2]
    added(spark, folder, [("late", 2, 1, False), ("a", 35, 1, False), ("a", 60, 1, False)])
    assert sorted(r["n"] for r in run().collect()) == [2, 2]


def test_repeats_and_sessions(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "in")
    added(spark, folder, [("a", 0, 1, False), ("a", 1, 1, False), ("b", 0, 1, False), ("a", 20, 1, False), ("z", 300, 1, False)])
    assert sorted(r["k"] for r in E.finished(E.without_repeats(stream(spark, folder), "ts", ["k"], "1 hour")).collect()) == ["a", "b", "z"]
    closed = E.finished(E.sessions(stream(spark, folder), "ts", "k", {"n": F.count("*")}, "15 minutes")).collect()
    assert sorted((r["k"], r["n"]) for r in closed) == [("a", 1), ("a", 2), ("b", 1)]
