"""Queue and stream queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.base import query
from lectern.sources.views import table
from lectern.streaming import queues


ORDERED = "e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(
    "s_04_rate_limit",
    f"""WITH RECURSIVE {ORDERED}, run AS (SELECT user_id, event_id, k, us + 3600000000 AS until, 1 AS used FROM e WHERE k = 1
       UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.us >= r.until THEN e.us + 3600000000 ELSE r.until END, CASE WHEN e.us >= r.until THEN 1 ELSE r.used + 1 END FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
       SELECT user_id, event_id, used <= 3 AS allowed FROM run""",
)
def s_04(spark, sf):
    """Three hits an hour and user."""
    return queues.rate_limited(table(spark, sf, "events"), "user_id", "ts", "event_id", 3, 3600)


@query(
    "s_05_idempotency",
    """SELECT event_id, CASE WHEN event_id = first_id THEN 'run' WHEN event_type = first_type THEN 'same' ELSE 'conflict' END AS outcome FROM
       (SELECT event_id, event_type, first_value(event_id) OVER w AS first_id, first_value(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id))""",
)
def s_05(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.concat_ws("/", "user_id", F.date_trunc("day", "ts").cast("string")).alias("key"))
    return queues.idempotent(e, "key", "event_type", "event_id")


@query("s_08_retry", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 1.0 WHEN event_id % 7 >= 5 THEN NULL ELSE least(60.0, pow(2, event_id % 7)) END AS delay FROM events")
def s_08(spark, sf):
    e = table(spark, sf, "events")
    d = queues.retry_delay(F.col("event_id") % 7, F.col("event_type") == "error", F.col("event_type") == "signup")
    return e.select("event_id", d.alias("delay"))


def named(spark, sf, names):
    """Events as operations: an operation for each type of event."""
    op = F.col("event_type")
    for k, v in names.items():
        op = F.when(F.col("event_type") == k, v).otherwise(op)
    return table(spark, sf, "events").select("event_id", "user_id", "ts", op.alias("op"))


@query(
    "s_02_visibility",
    f"""WITH RECURSIVE {ORDERED}, run AS (SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, 'none' AS status, CAST(0 AS BIGINT) AS deadline, 0 AS attempt, '' AS outcome FROM e WHERE k = 1
      UNION ALL SELECT user_id, event_id, k,
        CASE WHEN op = 'signup' AND s NOT IN ('ready', 'reserved') THEN 'ready' WHEN op = 'view' AND s = 'ready' THEN 'reserved' WHEN op = 'purchase' AND s = 'reserved' THEN 'done' WHEN op = 'error' AND s = 'reserved' THEN CASE WHEN a >= 4 THEN 'dead' ELSE 'ready' END ELSE s END,
        CASE WHEN (op = 'view' AND s = 'ready') OR (op = 'click' AND s = 'reserved') THEN us + 86400000000 WHEN s = 'reserved' AND op IN ('view', 'signup') THEN deadline ELSE 0 END,
        CASE WHEN op = 'signup' AND s NOT IN ('ready', 'reserved') THEN 0 WHEN op = 'purchase' AND s = 'reserved' THEN 0 WHEN op = 'error' AND s = 'reserved' THEN a + 1 ELSE a END,
        CASE op WHEN 'signup' THEN CASE WHEN s IN ('ready', 'reserved') THEN 'duplicate' ELSE 'queued' END WHEN 'view' THEN CASE s WHEN 'ready' THEN 'reserved' WHEN 'reserved' THEN 'busy' ELSE 'empty' END
          ELSE CASE WHEN s <> 'reserved' THEN 'refused' WHEN op = 'click' THEN 'renewed' WHEN op = 'purchase' THEN 'acked' WHEN a >= 4 THEN 'dead' ELSE 'retried' END END
      FROM (SELECT e.*, r.deadline, CASE WHEN r.status = 'reserved' AND e.us >= r.deadline THEN CASE WHEN r.attempt >= 4 THEN 'dead' ELSE 'ready' END ELSE r.status END AS s,
        CASE WHEN r.status = 'reserved' AND e.us >= r.deadline THEN r.attempt + 1 ELSE r.attempt END AS a FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
      SELECT user_id, event_id, outcome FROM run WHERE k > 0""",
)
def s_02(spark, sf):
    """A queue with a visibility timeout of a day, replayed: users stand for deliveries, events for operations on them."""
    names = {"signup": "enqueue", "view": "reserve", "click": "renew", "purchase": "ack", "error": "retry"}
    return queues.deliveries(named(spark, sf, names), "user_id", "ts", "event_id", "op", 86_400)


@query(
    "s_03_leases",
    f"""WITH RECURSIVE {ORDERED}, run AS (SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, 'pending' AS status, CAST(0 AS BIGINT) AS expires, '' AS outcome FROM e WHERE k = 1
      UNION ALL SELECT user_id, event_id, k,
        CASE WHEN op IN ('view', 'signup') AND status <> 'succeeded' AND status <> 'cancelled' AND NOT active THEN 'running' WHEN op = 'error' AND status <> 'succeeded' THEN 'cancelled' WHEN op = 'purchase' AND active THEN 'succeeded' ELSE status END,
        CASE WHEN (op IN ('view', 'signup') AND status <> 'succeeded' AND status <> 'cancelled' AND NOT active) OR (op = 'click' AND active) THEN us + 86400000000 WHEN op IN ('error', 'purchase') AND status <> 'succeeded' AND (op = 'error' OR active) THEN 0 ELSE expires END,
        CASE WHEN op IN ('view', 'signup') THEN CASE WHEN status = 'succeeded' THEN 'completed' WHEN status = 'cancelled' OR active THEN 'conflict' WHEN status = 'pending' THEN 'claimed' ELSE 'resumed' END
          WHEN op = 'error' THEN CASE WHEN status = 'succeeded' THEN 'completed' ELSE 'cancelled' END WHEN NOT active THEN 'lost' WHEN op = 'click' THEN 'extended' ELSE 'succeeded' END
      FROM (SELECT e.*, r.status, r.expires, r.status = 'running' AND e.us < r.expires AS active FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
      SELECT user_id, event_id, outcome FROM run WHERE k > 0""",
)
def s_03(spark, sf):
    """Runs with a lease of a day, replayed: users stand for runs, events for what workers do."""
    names = {"signup": "claim", "view": "claim", "click": "heartbeat", "purchase": "finish", "error": "cancel"}
    return queues.leases(named(spark, sf, names), "user_id", "ts", "event_id", "op", 86_400)


@query("ext_tumbling_batch", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_batch(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("ext_tumbling_stream", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1")
def tumbling_stream(spark, sf):
    """Hourly counts of a stream; a window is written once the watermark (10 minutes behind the latest event) has passed its end."""
    s = queues.source_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return queues.run_stream(spark, s.select(F.col("w.start").alias("hour"), "n"))


@query("ext_watermark_dedup", "SELECT DISTINCT event_id FROM events")
def watermark_dedup(spark, sf):
    s = queues.source_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_id")
    return queues.run_stream(spark, s)


@query(
    "ext_asof",
    "SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
)
def asof(spark, sf):
    """The latest view of the same user before each purchase: one window over the union, no range join."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").where("event_type in ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "event_type", seen.alias("last_view")).where("event_type = 'purchase'").select("event_id", "last_view")
