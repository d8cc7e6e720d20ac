"""Streams: sessions over several batches with late rows and a restart, the cache's state, and progress."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.plans import services
from tessera.streaming.cache import LOOKUPS, cached_lookups, look_up
from tessera.streaming.progress import Batch, report
from tessera.streaming.sessions import append_sessions, closed_sessions, event_stream, sessions

BEGAN = dt.datetime(2024, 3, 1)
EVENTS = "event_id long, ts timestamp, user_id long"


def at(minutes):
    return BEGAN + dt.timedelta(minutes=minutes)


def add_file(spark, folder, rows, number):
    """One file of events, newer than those before."""
    path = f"{folder}/f{number}.parquet"
    spark.createDataFrame(rows, EVENTS).toPandas().assign(ts=lambda x: x.ts.astype("datetime64[us]")).to_parquet(path)
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def test_sessions_over_batches_with_late_rows_and_a_restart(spark, tmp_path):
    source, out = tmp_path / "in.d", str(tmp_path / "out")
    source.mkdir()
    add_file(spark, source, [(1, at(0), 1), (2, at(10), 1), (3, at(0), 2)], 1)
    add_file(spark, source, [(4, at(200), 1), (5, at(5), 2)], 2)  # 5 is within the delay of the first file's watermark
    found = closed_sessions(spark, str(source), out)
    assert {(r.user_id, r.session_start, r.n_events) for r in found.collect()} == {(1, at(0), 2), (2, at(0), 2)}
    # the watermark is at 140 minutes: 6 opens nothing, 7 joins the open session of user 1
    add_file(spark, source, [(6, at(20), 3), (7, at(210), 1)], 3)
    assert closed_sessions(spark, str(source), out).count() == 2
    add_file(spark, source, [(8, at(900), 4)], 4)
    done = {(r.user_id, r.session_start, r.session_end, r.n_events) for r in closed_sessions(spark, str(source), out).collect()}
    assert done == {(1, at(0), at(40), 2), (2, at(0), at(35), 2), (1, at(200), at(240), 2)}
    # nothing new: a start reads no file and writes no row
    query = append_sessions(event_stream(spark, str(source)), f"{out}/sessions", f"{out}/state")
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 0


def test_sessions_in_small_batches_equal_the_batch(spark, tmp_path):
    source = tmp_path / "in.d"
    source.mkdir()
    rows = [(k, at(k * 17 % 4000), k % 5) for k in range(400)]
    rows.sort(key=lambda r: r[1])
    for k in range(8):
        add_file(spark, source, rows[k * 50 : k * 50 + 50], k)
    query = append_sessions(event_stream(spark, str(source), 1), str(tmp_path / "o"), str(tmp_path / "s"), "20 minutes", "10 minutes")
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 8
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    batch = sessions(spark.createDataFrame(rows, EVENTS), "20 minutes").where(F.col("session_end") <= F.lit(rows[-1][1] - dt.timedelta(minutes=10)))
    assert got == {tuple(r) for r in batch.collect()} and len(got) > 50


def test_look_up():
    entries, out = look_up([], [("a", 0, 1), ("a", 4, 2), ("b", 5, 3), ("c", 6, 4), ("a", 7, 5), ("b", 16, 6)], 10, 2)
    # a is stored, hit, put out by c though it was hit; b is put out by a; b comes back and puts out c
    assert out == [(1, False, None), (2, True, None), (3, False, None), (4, False, "a"), (5, False, "b"), (6, False, "c")]
    assert entries == [("a", 7), ("b", 16)]
    assert look_up([("a", 0)], [("a", 10, 1)], 10, 1) == ([("a", 10)], [(1, False, None)])  # expired, not put out


def test_cache_state_ends_with_a_timer(spark, tmp_path):
    source = tmp_path / "in.d"
    source.mkdir()
    add_file(spark, source, [(1, at(0), 1), (2, at(1), 1), (3, at(0), 2)], 1)
    add_file(spark, source, [(4, at(4), 1), (5, at(7), 1), (6, at(500), 3)], 2)
    add_file(spark, source, [(7, at(501), 3)], 3)

    def run():
        lookups = event_stream(spark, str(source), 1).select(F.col("user_id").alias("owner"), F.lit("k").alias("key"), "ts", F.col("event_id").alias("id"))
        writer = cached_lookups(lookups).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "s"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    states = run()
    got = {(r.owner, r.id, r.hit) for r in spark.read.schema(LOOKUPS).parquet(str(tmp_path / "o")).collect()}
    assert got == {(1, 1, False), (1, 2, True), (2, 3, False), (1, 4, True), (1, 5, False), (3, 6, False), (3, 7, True)}
    assert max(states) == 3 and states[-1] == 1  # only owner 3 is left
    assert {tuple(r) for r in cached_lookups(spark.read.parquet(str(source)).select(F.col("user_id").alias("owner"), F.lit("k").alias("key"), "ts", F.col("event_id").alias("id"))).select("owner", "id", "hit").collect()} == got


def test_progress_of_a_quality_batch(spark):
    batch = services._quality_batch(spark, "/root/testdata/sf0.001")
    steps = list(batch.start().steps())
    assert steps[0].type == "start" and steps[0].total == len(services.SECTIONS)
    assert [(s.section, s.status) for s in steps[1:-1]] == [(n, x) for n in services.SECTIONS for x in ("running", "success")]
    assert (steps[-1].type, steps[-1].completed) == ("done", len(services.SECTIONS))
    assert batch.result("clin_global").count() == steps[10].n_rows > 0


def test_progress_goes_on_after_an_error(spark):
    def broken():
        raise ValueError("no such table")

    rows = report(Batch(spark, {"one": lambda: spark.range(3), "two": broken, "three": lambda: spark.range(5)})).collect()
    assert [(r.section, r.status, r.completed, r.n_rows) for r in rows] == [("one", "success", 1, 3), ("two", "error", 2, None), ("three", "success", 3, 5)]
    assert rows[1].error == "ValueError: no such table"


def test_progress_cancelled(spark):
    slow = spark.range(4).repartition(4).select(F.udf(lambda x: time.sleep(30) or x, "long")("id").alias("id"))
    batch = Batch(spark, {"one": lambda: spark.range(3), "two": lambda: slow, "three": lambda: spark.range(5)}).start()
    seen, began = [], time.time()
    for step in batch.steps():
        seen.append((step.type, step.section, step.status))
        if step.section == "two":
            time.sleep(2)
            batch.cancel()
    assert seen[-2:] == [("progress", "two", "running"), ("cancelled", None, None)] and time.time() - began < 25


@pytest.mark.parametrize("name", ["sessions_stream", "cache_lookups"])
def test_stream_queries_are_run_as_streams(spark, name):
    seen = []
    from pyspark.sql.streaming import StreamingQueryListener

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event):
            seen.append(event.id)

        def onQueryProgress(self, event):
            pass

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    watch = Watch()
    spark.streams.addListener(watch)
    try:
        services._QUERIES[name](spark, "/root/testdata/sf0.001").count()
    finally:
        spark.streams.removeListener(watch)
    assert len(seen) == 1
