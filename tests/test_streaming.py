"""Streams over small files."""

import datetime as dt

from pyspark.sql import functions as F

from plazaflow.streaming import windows


def events(spark, rows):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, 1, h, m), u, t, 1.0, "{}") for k, h, m, u, t in rows], windows.EVENTS)


def test_available_now_goes_on(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events(spark, [(1, 0, 5, 1, "a"), (2, 0, 20, 1, "a"), (3, 1, 5, 1, "b"), (4, 5, 0, 2, "a")]).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: windows.tumbling(windows.read_events(spark, source), "1 hour", late="10 minutes")
    windows.run_available(stream(), out, state)
    events(spark, [(5, 0, 30, 1, "a"), (6, 9, 0, 1, "a")]).coalesce(1).write.mode("append").parquet(source)
    windows.run_available(stream(), out, state)
    got = {(r.h, r.event_type): r.n for r in spark.read.parquet(out).withColumn("h", F.hour("start")).collect()}
    assert got == {(0, "a"): 2, (1, "b"): 1, (5, "a"): 1}  # the late event of hour 0 doesn't count, hour 9 is open


def test_sessions_and_duplicates(spark, tmp_path):
    rows = events(spark, [(1, 0, 0, 1, "a"), (2, 0, 20, 1, "a"), (3, 2, 0, 1, "a"), (4, 0, 0, 2, "a")])
    got = sorted((r.user_id, r.n) for r in windows.user_sessions(rows, "30 minutes").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.unionByName(rows).write.parquet(source)
    windows.run_available(windows.once_each(windows.read_events(spark, source, 100), "1 hour"), out, state)
    assert spark.read.parquet(out).count() == 4
