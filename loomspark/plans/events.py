"""Queries of the event family: the streaming operators over the table of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.session import read_table
from loomspark.streaming import events as E

WEEK = lambda df: df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def _e(f):
    return lambda spark, sf_dir: f(read_table(spark, sf_dir, "events"))


QUERIES = {
    "events_tumbling": _e(lambda e: WEEK(E.tumbling(e, "1 hour"))),
    "events_sliding": _e(lambda e: WEEK(E.sliding(e, "2 hours", "1 hour"))),
    "events_sessions": _e(lambda e: WEEK(E.sessions(e, "30 minutes"))),
    "events_distinct": _e(lambda e: E.distinct_events(e.unionAll(e))),
}
_START = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS start"
ORACLE_SQL = {
    "events_tumbling": f"SELECT {_START.format('''date_trunc('hour', ts)''')}, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": f"""SELECT {_START.format('s')}, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL""",
    "events_sessions": f"""WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM b), t AS (SELECT user_id, k, min(ts) AS s, count(*) AS n, sum(value) AS v FROM s GROUP BY 1, 2)
        SELECT user_id, {_START.format('s')}, n, round(v, 4) AS total FROM t""",
    "events_distinct": "SELECT event_id, event_type, value FROM events",
}
