"""Queue behaviour as streams and as replays of history: rate limits, idempotency, retries, windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.stores import checkpoint_dir


def replayed(events: DataFrame, key: str, at: str, order: str, op: str, start: Callable, step: Callable) -> DataFrame:
    """(key, order, outcome): each key's operations in order of time, through a state machine.

    ``start()`` gives a key's first state, ``step(state, us, op)`` the next one and the outcome. What an operation does depends on
    all before it, so a key is replayed in one task; its rows arrive sorted and stream through with one state, and no key's
    history is ever held whole. Rows without a key are one key.
    """

    def replay(batches):
        owner, state = object(), None
        for batch in batches:
            out = []
            for k, us, o in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if k != owner:
                    owner, state = k, start()
                state, outcome = step(state, us, o)
                out.append(outcome)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[key, order, "outcome"])

    narrow = events.select(key, order, F.unix_micros(F.col(at).cast("timestamp")).alias("_us"), F.col(op).alias("_op"))
    schema = narrow.select(key, order).schema.add("outcome", "string")
    return narrow.repartition(key).sortWithinPartitions(key, "_us", order).mapInArrow(replay, schema)


def rate_limited(events: DataFrame, key: str, at: str, order: str, limit: int, window_s: int) -> DataFrame:
    """(key, order, allowed): a fixed window starts at a key's first hit after the last one ended; ``limit`` hits pass in it."""
    micros = window_s * 1_000_000

    def hit(state, us, _):
        end, used = state
        if us >= end:
            end, used = us + micros, 0
        return (end, used + 1), "yes" if used < limit else "no"

    out = replayed(events.withColumn("_hit", F.lit("hit")), key, at, order, "_hit", lambda: (-(2**63), 0), hit)
    return out.select(key, order, (F.col("outcome") == "yes").alias("allowed"))


#: Fixed value: attempts after which a delivery is dead.
ATTEMPTS = 5


def deliveries(events: DataFrame, key: str, at: str, order: str, op: str, timeout_s: int = 60) -> DataFrame:
    """(key, order, outcome) of a queue's operations on each delivery: enqueue, reserve, renew, ack, retry.

    A reservation lasts ``timeout_s``; one that has run out is taken back before the next operation, as a failed attempt.
    After ATTEMPTS failed ones the delivery is dead. Outcomes: queued, duplicate, reserved, busy, empty, renewed, acked, retried, dead, refused.
    """
    micros = timeout_s * 1_000_000

    def failed(attempt):
        return ("dead" if attempt + 1 >= ATTEMPTS else "ready", 0, attempt + 1)

    def step(state, us, what):
        status, deadline, attempt = state
        if status == "reserved" and us >= deadline:
            status, deadline, attempt = failed(attempt)
        if what == "enqueue":
            return ((status, deadline, attempt), "duplicate") if status in ("ready", "reserved") else (("ready", 0, 0), "queued")
        if what == "reserve":
            if status == "ready":
                return ("reserved", us + micros, attempt), "reserved"
            return (status, deadline, attempt), "busy" if status == "reserved" else "empty"
        if status != "reserved":
            return (status, deadline, attempt), "refused"
        if what == "renew":
            return (status, us + micros, attempt), "renewed"
        if what == "ack":
            return ("done", 0, 0), "acked"
        new = failed(attempt)
        return new, "dead" if new[0] == "dead" else "retried"

    return replayed(events, key, at, order, op, lambda: ("none", 0, 0), step)


def leases(events: DataFrame, key: str, at: str, order: str, op: str, lease_s: int = 300) -> DataFrame:
    """(key, order, outcome) of workers' operations on each run: claim, heartbeat, finish, cancel.

    A claim holds a lease of ``lease_s``, which a heartbeat extends; another claim is refused while it lasts and resumes the
    run afterwards. Without a lease nothing can be extended or finished. Outcomes: claimed, resumed, conflict, completed, extended, succeeded, lost, cancelled.
    """
    micros = lease_s * 1_000_000

    def step(state, us, what):
        status, expires = state
        active = status == "running" and us < expires
        if what == "claim":
            if status == "succeeded":
                return state, "completed"
            if status == "cancelled" or active:
                return state, "conflict"
            return ("running", us + micros), "claimed" if status == "pending" else "resumed"
        if what == "cancel":
            return (state, "completed") if status == "succeeded" else (("cancelled", 0), "cancelled")
        if not active:
            return state, "lost"
        return (("running", us + micros), "extended") if what == "heartbeat" else (("succeeded", 0), "succeeded")

    return replayed(events, key, at, order, op, lambda: ("pending", 0), step)


def idempotent(commands: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """(order, outcome) of each command: 'run' for a key's first, 'same' for a repeat of its body, 'conflict' for another body."""
    first = commands.groupBy(key).agg(F.min_by(F.struct(order, body), order).alias("_f"))
    j = commands.join(first, key)
    outcome = F.when(F.col(order) == F.col(f"_f.{order}"), "run").when(F.col(body).eqNullSafe(F.col(f"_f.{body}")), "same").otherwise("conflict")
    return j.select(order, outcome.alias("outcome"))


def retry_delay(attempt: F.Column | int, permanent=None, lease=None):
    """Seconds until the next attempt: min(60, 2 ** attempt); 1 for lease failures; null (dead letter) when permanent or after 5 attempts."""
    a = F.col(attempt) if isinstance(attempt, str) else attempt
    delay = F.least(F.lit(60.0), F.pow(F.lit(2.0), a))
    out = F.when(a >= 5, F.lit(None)).otherwise(delay)
    if lease is not None:
        out = F.when(lease, F.lit(1.0)).otherwise(out)
    if permanent is not None:
        out = F.when(permanent, F.lit(None)).otherwise(out)
    return out


def run_stream(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a table of the shared folder; gives the table."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def source_stream(spark, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format("parquet").load(f"{path}*")
