"""Extensions over the event table, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.resolve import pick_first
from ..registry import query
from ..streaming import windows


@query("win_tumble", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(get):
    return windows.windowed(get("events"), "1 hour", late=None)


@query("win_slide", """SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES (0), (1)) AS s(k) GROUP BY 1, 2""")
def _(get):
    return windows.windowed(get("events"), "1 hour", "30 minutes", late=None)


@query("win_session", """SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""")
def _(get):
    return windows.sessions(get("events"), "2 hours", late=None)


@query("dedup_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(get):
    return pick_first(get("events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("last_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(get):
    return windows.latest(get("events"), "user_id", "event_id", "event_type")


@query("progress_states", "SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS done, count(*) FILTER (event_id % 3 <> 0) AS open FROM events GROUP BY event_type")
def _(get):
    return get("events").groupBy("event_type").agg(F.count_if(F.col("event_id") % 3 == 0).alias("done"), F.count_if(F.col("event_id") % 3 != 0).alias("open"))
