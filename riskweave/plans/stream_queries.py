"""Streaming jobs drained over the event table; checks hold for closed windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.plans.registry import query
from riskweave.sources import tables as src
from riskweave.streaming import monitors as mon


def _events(spark, sf):
    """The event file as a stream, read through the folder that holds it."""
    return (
        spark.readStream.schema(mon.EVENT_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 100)
        .parquet(sf)
    )


def _shown(c: str, pattern: str = "yyyy-MM-dd HH:mm:ss"):
    return F.date_format(c, pattern).alias(c)


@query(
    "t01_event_ingestion",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM events GROUP BY 1""",
)
def event_ingestion(spark, sf):
    landed = mon.run_to_table(_events(spark, sf), "ingest")
    return landed.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"),
    )


_CLOSED_SQL = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "t02_daily_windows",
    f"""WITH w AS (SELECT date_trunc('day', ts) AS s, count(*) AS n,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v, quantile_disc(value, 0.95) AS p FROM events GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, n, CAST(e AS BIGINT) AS n_errors, v AS value, p AS p95
FROM w WHERE s + INTERVAL 1 DAY <= {_CLOSED_SQL}""",
)
def daily_windows(spark, sf):
    out = mon.run_to_table(mon.windowed_kpis(_events(spark, sf), "1 day"), "daily")
    return out.select(_shown("window_start"), "n", "n_errors", "value", "p95")


@query(
    "t02_hourly_windows",
    f"""WITH w AS (SELECT date_trunc('hour', ts) AS s, count(*) AS n,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e FROM events GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, n, CAST(e AS BIGINT) AS n_errors
FROM w WHERE s + INTERVAL 1 HOUR <= {_CLOSED_SQL}""",
)
def hourly_windows(spark, sf):
    out = mon.run_to_table(mon.windowed_kpis(_events(spark, sf), "1 hour"), "hourly")
    return out.select(_shown("window_start"), "n", "n_errors")


_ARRIVALS = 4


@query(
    "t02_late_rows",
    f"""WITH e AS (SELECT epoch_us(ts) AS us, event_id FROM events),
b AS (SELECT min(us) AS lo, (max(us) - min(us)) // {_ARRIVALS} + 1 AS span FROM e),
a AS (SELECT us, CAST((us - lo) // span + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS INT) AS batch FROM e, b),
w AS (SELECT batch, max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  - 3600000000 AS mark FROM a GROUP BY batch)
SELECT batch, count(*) AS n_rows, count(*) FILTER (WHERE us < mark) AS n_late FROM a JOIN w USING (batch) GROUP BY batch""",
)
def late_rows(spark, sf):
    """All events arrive in stretches of time, every tenth of them one stretch too late."""
    target, checkpoint = mon.new_target(spark, "late")
    for stream in _arrivals(spark, sf):
        counts = mon.late_row_counts(stream, "ts", 3600, target, checkpoint)
    return counts.select("batch", "n_rows", "n_late")


def _arrivals(spark, sf):
    """The stream after each arrival: stretches of time, every tenth event one stretch too late."""
    events = src.table(spark, sf, "events").select(
        *[F.col(f.name).cast(f.dataType) for f in mon.EVENT_SCHEMA.fields]
    )
    seen = F.unix_micros("ts")
    ends = events.agg(F.min(seen).alias("first"), F.max(seen).alias("last")).first()
    span = ((ends["last"] or 0) - (ends["first"] or 0)) // _ARRIVALS + 1
    number = F.floor((seen - (ends["first"] or 0)) / span) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    folder, _ = mon.new_target(spark, "arrivals")
    for n in range(_ARRIVALS + 1):
        events.where(number == n).write.mode("append").parquet(folder)
        yield spark.readStream.schema(mon.EVENT_SCHEMA).parquet(folder)


@query(
    "t02_dropped_rows",
    f"""WITH e AS (SELECT epoch_us(ts) AS us, epoch_us(date_trunc('hour', ts)) + 3600000000 AS closes, event_id FROM events),
b AS (SELECT min(us) AS lo, (max(us) - min(us)) // {_ARRIVALS} + 1 AS span FROM e),
a AS (SELECT us, closes, CAST((us - lo) // span + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS arrival FROM e, b),
w AS (SELECT arrival, max(max(us)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  - 3600000000 AS mark FROM a GROUP BY arrival)
SELECT arrival, count(*) AS n_rows, count(*) FILTER (WHERE mark IS NULL OR closes > mark) AS n_kept,
  count(*) FILTER (WHERE closes <= mark) AS n_dropped, count(DISTINCT closes) FILTER (WHERE closes <= mark) AS n_groups_dropped
FROM a JOIN w USING (arrival) GROUP BY arrival""",
)
def dropped_rows(spark, sf):
    """Rows that the hourly windows really dropped, from the progress and the windows of the query."""
    target, checkpoint = mon.new_target(spark, "dropped")
    for stream in _arrivals(spark, sf):
        mon.windows_with_drops(stream, "1 hour", "1 hour", target, checkpoint)
    counts = mon.dropped_row_counts(spark, target)
    arrival = F.row_number().over(Window.orderBy("batch")) - 1  # a row per batch, batches without rows left out
    return counts.select(arrival.cast("long").alias("arrival"), "n_rows", "n_kept", "n_dropped", "n_groups_dropped")


@query(
    "t03_sliding_week",
    f"""WITH d AS (SELECT unnest(generate_series(date_trunc('day', (SELECT min(ts) FROM events)) - INTERVAL 6 DAY,
  date_trunc('day', (SELECT max(ts) FROM events)), INTERVAL 1 DAY)) AS s),
w AS (SELECT s, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e
  FROM d JOIN events ON ts >= s AND ts < s + INTERVAL 7 DAY GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, n, CAST(e AS BIGINT) AS n_errors
FROM w WHERE s + INTERVAL 7 DAY <= {_CLOSED_SQL}""",
)
def sliding_week(spark, sf):
    out = mon.run_to_table(mon.windowed_kpis(_events(spark, sf), "7 days", "1 day"), "week")
    return out.select(_shown("window_start"), "n", "n_errors")


@query(
    "t04_row_alerts",
    """SELECT event_id, user_id, value, 'large_error' AS alert FROM events
WHERE event_type = 'error' AND value > 150""",
)
def row_alerts(spark, sf):
    def write(batch, number, target):
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = mon.row_alerts(_events(spark, sf), 150.0)
    target = mon.run_per_batch(stream, "alerts", write, mode="append")
    return spark.read.schema(stream.schema).parquet(target).select(
        "event_id", "user_id", "value", "alert"
    )


@query(
    "t04_spike_alerts",
    f"""WITH w AS (SELECT date_trunc('hour', ts) AS s, count(*) AS n,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e FROM events GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, n, CAST(e AS BIGINT) AS n_errors,
  round(e / n, 6) AS error_rate, 'error_spike' AS alert
FROM w WHERE s + INTERVAL 1 HOUR <= {_CLOSED_SQL} AND e / n > 0.4""",
)
def spike_alerts(spark, sf):
    out = mon.run_to_table(mon.spike_alerts(_events(spark, sf), "1 hour", 0.4), "spikes")
    return out.select(
        _shown("window_start"), "n", "n_errors", F.round("error_rate", 6).alias("error_rate"), "alert"
    )


# The join only sees these two event types, so the older of their last rows sets the watermark.
_SEEN_SQL = """(SELECT min(t) - INTERVAL 1 HOUR FROM (
  SELECT max(ts) AS t FROM events WHERE event_type IN ('view', 'error') GROUP BY event_type))"""


@query(
    "t05_delayed_feedback",
    f"""SELECT p.event_id, f.event_id AS feedback_id FROM events p LEFT JOIN events f
  ON f.user_id = p.user_id AND f.event_type = 'error' AND f.ts >= p.ts AND f.ts <= p.ts + INTERVAL 2 HOUR
WHERE p.event_type = 'view' AND (f.event_id IS NOT NULL OR p.ts + INTERVAL 2 HOUR < {_SEEN_SQL})""",
)
def delayed_feedback(spark, sf):
    """Predictions with the feedback of the two hours after them, or without once it is too late."""
    events = _events(spark, sf)
    predictions = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    feedback = _events(spark, sf).where("event_type = 'error'").select(
        F.col("user_id").alias("feedback_key"),
        F.col("event_id").alias("feedback_id"),
        F.col("ts").alias("feedback_ts"),
    )
    joined = mon.with_feedback(
        predictions, feedback, "user_id", "ts", "feedback_ts", bound_seconds=7200
    )
    return mon.run_to_table(joined.select("event_id", "feedback_id"), "feedback")


@query("t06_without_duplicates", "SELECT event_id, user_id FROM events")
def without_duplicates(spark, sf):
    """Every event arrives twice; one of the two stays."""
    doubled = _events(spark, sf).unionByName(_events(spark, sf))
    out = mon.run_to_table(mon.without_duplicates(doubled, ["event_id"]), "unique")
    return out.select("event_id", "user_id")


_LAST_SQL = """SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_type}) AS state,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n FROM events GROUP BY 1"""


@query("t07_last_state", _LAST_SQL)
def last_state(spark, sf):
    out = mon.last_state(src.table(spark, sf, "events"), "user_id", "ts", F.col("event_type"))
    return out.select("user_id", "state", _shown("last_seen"), "n")


@query("t07_last_state_stream", _LAST_SQL)
def last_state_stream(spark, sf):
    def write(batch, number, target):
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = mon.last_state(_events(spark, sf), "user_id", "ts", F.col("event_type"))
    target = mon.run_per_batch(stream, "state", write)
    rows = spark.read.schema(stream.schema).parquet(target)
    newest = rows.groupBy("user_id").agg(F.max(F.struct("n", "state", "last_seen")).alias("m"))
    return newest.select("user_id", "m.state", "m.last_seen", "m.n").select(
        "user_id", "state", _shown("last_seen"), "n"
    )


@query(
    "t08_incremental_export",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
)
def incremental_export(spark, sf):
    """Two runs over the same checkpoint; the second finds nothing new."""
    stream = _events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    target, checkpoint = mon.new_target(spark, "export")
    for _ in range(2):
        mon.to_table(stream, target, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target).groupBy("day").agg(
        F.count("*").alias("n")
    )


@query(
    "t09_user_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER u >= ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
  FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
r AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id, k ORDER BY ts, event_type) AS later FROM s),
a AS (SELECT user_id, min(ts) AS b, max(ts) AS e, count(*) AS n,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, count(*) FILTER (WHERE event_type = 'error' AND later IS NOT NULL) AS n_retries,
  arg_max(event_type, {{'t': ts, 'e': event_type}}) AS last FROM r GROUP BY user_id, k)
SELECT user_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_start, n, CAST(errors AS BIGINT) AS n_errors, n_retries,
  CASE WHEN last = 'error' THEN 1 ELSE 0 END AS abandoned FROM a
WHERE e + INTERVAL 6 HOUR <= {_CLOSED_SQL}""",
)
def user_sessions(spark, sf):
    out = mon.run_to_table(mon.user_sessions(_events(spark, sf), "6 hours"), "sessions", mon.SESSIONS_MERGED_EARLY)
    return out.select("user_id", _shown("session_start"), "n", "n_errors", "n_retries", "abandoned")
