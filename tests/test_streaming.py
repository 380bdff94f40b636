import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.streaming import monitors as mon

BASE = dt.datetime(2024, 1, 1)


def event(i, hours, user=1, kind="view", value=1.0):
    return (i, BASE + dt.timedelta(hours=hours), user, kind, value, "{}")


def write(spark, folder, rows):
    spark.createDataFrame(rows, mon.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def three_files(spark, tmp_path):
    """Three arrivals; the last one brings a row far behind the watermark."""
    folder = str(tmp_path / "events")
    write(spark, folder, [event(1, 0.5), event(2, 1.5, kind="error"), event(3, 5)])
    write(spark, folder, [event(4, 6), event(5, 9, user=2, kind="error"), event(5, 9, user=2, kind="error")])
    write(spark, folder, [event(6, 0.6), event(7, 20)])
    return folder


def stream(spark, folder):
    return mon.event_stream(spark, folder, files_per_batch=1)


def test_closed_windows_and_late_rows(spark, three_files):
    out = mon.run_to_table(mon.windowed_kpis(stream(spark, three_files), "1 hour"), "w")
    got = {r.window_start.hour: (r.n, r.n_errors) for r in out.collect()}
    assert got == {0: (1, 0), 1: (1, 1), 5: (1, 0), 6: (1, 0), 9: (2, 2)}


def test_stream_equals_batch_without_late_rows(spark, tmp_path):
    folder = str(tmp_path / "e")
    rows = [event(i, i / 4, kind="error" if i % 5 == 0 else "view", value=float(i)) for i in range(100)]
    for part in (rows[:40], rows[40:70], rows[70:]):
        write(spark, folder, part)
    streamed = mon.run_to_table(mon.windowed_kpis(stream(spark, folder), "1 hour"), "s")
    closed = streamed.agg(F.max("window_end")).first()[0]
    batch = mon.windowed_kpis(spark.read.schema(mon.EVENT_SCHEMA).parquet(folder), "1 hour").where(
        F.col("window_end") <= closed
    )
    assert sorted(streamed.collect()) == sorted(batch.collect()) and closed > BASE


def test_duplicates_across_files(spark, three_files):
    runs = mon.without_duplicates(stream(spark, three_files), ["event_id"], delay="10 days")
    assert mon.run_to_table(runs, "d").groupBy("event_id").count().where("count > 1").isEmpty()


def test_last_state_over_batches(spark, three_files):
    def write_batch(batch, number, target):
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    live = mon.last_state(stream(spark, three_files), "user_id", "ts", F.col("event_type"))
    target = mon.run_per_batch(live, "l", write_batch)
    rows = spark.read.schema(live.schema).parquet(target)
    newest = {r.user_id: (r.m.n, r.m.state, r.m.last_seen) for r in rows.groupBy("user_id").agg(
        F.max(F.struct("n", "state", "last_seen")).alias("m")).collect()}
    assert newest == {
        1: (6, "view", BASE + dt.timedelta(hours=20)), 2: (2, "error", BASE + dt.timedelta(hours=9))
    }


def test_incremental_export_continues(spark, tmp_path):
    folder = str(tmp_path / "e")
    target, checkpoint = mon.new_target(spark, "x")
    write(spark, folder, [event(1, 0)])
    mon.to_table(stream(spark, folder), target, checkpoint).awaitTermination()
    write(spark, folder, [event(2, 1)])
    mon.to_table(stream(spark, folder), target, checkpoint).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(target).collect()) == [1, 2]


def test_sessions(spark, tmp_path):
    folder = str(tmp_path / "e")
    write(spark, folder, [event(1, 0), event(2, 0.2), event(3, 2, kind="error"), event(4, 30, user=9)])
    out = mon.run_to_table(mon.user_sessions(stream(spark, folder)), "u").orderBy("session_start").collect()
    assert [(r.n, r.n_errors, r.n_retries, r.abandoned) for r in out] == [(2, 0, 0, 0), (1, 1, 0, 1)]


def test_an_error_before_further_events_is_a_retry(spark, tmp_path):
    folder = str(tmp_path / "e")
    write(spark, folder, [event(1, 0, kind="error"), event(2, 0.1, kind="error"), event(3, 0.2), event(4, 30, user=9)])
    out = mon.run_to_table(mon.user_sessions(stream(spark, folder)), "u").collect()
    assert [(r.n_errors, r.n_retries, r.abandoned) for r in out] == [(2, 2, 0)]


def test_late_rows_are_counted_once(spark, three_files):
    target, checkpoint = mon.new_target(spark, "late")
    for _ in range(2):
        got = mon.late_row_counts(stream(spark, three_files), "ts", 3600, target, checkpoint)
        assert sorted((r.batch, r.n_rows, r.n_late) for r in got.collect()) == [(0, 3, 0), (1, 3, 0), (2, 2, 1)]


def test_feedback_within_the_bound(spark, tmp_path):
    folder = str(tmp_path / "e")
    write(spark, folder, [event(1, 0), event(2, 1, kind="error"), event(3, 4, user=2), event(9, 60, user=3),
                          event(10, 60, user=3, kind="error")])
    predictions = stream(spark, folder).where("event_type = 'view'").select("event_id", "user_id", "ts")
    feedback = stream(spark, folder).where("event_type = 'error'").select(
        F.col("user_id").alias("feedback_key"), F.col("event_id").alias("f"), F.col("ts").alias("feedback_ts"))
    joined = mon.with_feedback(predictions, feedback, "user_id", "ts", "feedback_ts", bound_seconds=7200)
    got = {r.event_id: r.f for r in mon.run_to_table(joined.select("event_id", "f"), "f").collect()}
    assert got == {1: 2, 3: None, 9: 10}


def test_dropped_rows_of_the_window_query(spark, three_files):
    """The watermark after two files is 8:00; the third brings a row of a window that closed at 1:00."""
    write(spark, three_files, [event(8, 0.7), event(9, 0.8), event(10, 19.5), event(11, 30)])
    target, checkpoint = mon.new_target(spark, "drops")
    mon.windows_with_drops(stream(spark, three_files), "1 hour", "1 hour", target, checkpoint)
    got = sorted(tuple(r) for r in mon.dropped_row_counts(spark, target).collect())
    assert got == [(0, 3, 3, 0, 0), (1, 3, 3, 0, 0), (2, 2, 1, 1, 1), (3, 4, 2, 2, 1)]
    # A rerun with nothing new changes nothing; new data goes on after the last batch.
    mon.windows_with_drops(stream(spark, three_files), "1 hour", "1 hour", target, checkpoint)
    assert sorted(tuple(r) for r in mon.dropped_row_counts(spark, target).collect()) == got
    write(spark, three_files, [event(12, 1), event(13, 40)])
    mon.windows_with_drops(stream(spark, three_files), "1 hour", "1 hour", target, checkpoint)
    rows = sorted(tuple(r)[1:] for r in mon.dropped_row_counts(spark, target).collect())
    assert rows.count((2, 1, 1, 1)) == 2 and len(rows) == 5


def test_busy_user_is_merged_before_the_shuffle(spark, tmp_path, capsys):
    """One user has half of the events; a task sends a row per session of theirs, not per event."""
    folder = str(tmp_path / "busy")
    rows = [event(i, i / 100, user=1 if i % 2 else i, kind="error" if i % 7 == 0 else "view") for i in range(2000)]
    write(spark, folder, rows)
    plans = {}
    for early in ("true", "false"):
        key = next(iter(mon.SESSIONS_MERGED_EARLY))
        with mon.settings(spark, {key: early}):
            target, checkpoint = mon.new_target(spark, "busy")
            run = mon.to_table(mon.user_sessions(stream(spark, folder)), target, checkpoint)
        run.awaitTermination()
        run.explain()
        text = capsys.readouterr().out
        plans[early] = text[text.index("Exchange hashpartitioning"):].count("MergingSessions")
        got = spark.read.parquet(target).where("user_id = 1").agg(F.sum("n"), F.count("*")).first()
        assert plans.setdefault("rows", got) == got
    assert plans["true"] > plans["false"]
    assert spark.conf.get(key) == "false"
