"""Job queues, liveness and event protocols as queries over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a job, and the order of a stream's event types.
ACTIVE = ["preparing", "docking", "converting"]
TERMINAL = ["complete", "failed", "expired"]
PROTOCOL = ["start", "status", "references", "retrieval_stats", "answer_start", "answer", "done"]


def latest(log: DataFrame, key: str, ts: str, *values: str, tie: str | None = None) -> DataFrame:
    """The last values of each key: a map-side combined maximum, so a busy key does not gather its log."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return log.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values], F.max(ts).alias("updated_at"))


def expired(jobs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Jobs past their time that are not being worked on become expired."""
    late = (F.col("updated_at") + F.expr(f"INTERVAL {int(hours)} HOURS") < as_of) & ~F.col("status").isin(ACTIVE)
    return jobs.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))


def recovered(jobs: DataFrame) -> DataFrame:
    """After a crash, what was being worked on has failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin(ACTIVE), "failed").otherwise(F.col("status")))


def next_queued(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The oldest queued jobs. Claiming one is a database's compare-and-set, not a dataflow."""
    return jobs.where("status = 'queued'").orderBy("updated_at", jobs.columns[0]).limit(n)


def alive(beats: DataFrame, key: str, ts: str, as_of: Column, seconds: int = 15) -> DataFrame:
    """Whether each worker's last beat is recent."""
    return beats.groupBy(key).agg(F.max(ts).alias("last_beat")).withColumn("online", F.col("last_beat") >= as_of - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def protocol_breaks(events: DataFrame, session: str, order: str, kind: str) -> DataFrame:
    """Events of a session that come earlier in the protocol than the one before them, or follow its end; errors may come at any time."""
    place = F.array_position(F.array(*[F.lit(p) for p in PROTOCOL]), F.col(kind))
    w = Window.partitionBy(session).orderBy(order)
    rows = events.withColumns({"place": place, "before": F.lag(place).over(w), "last": F.lag(kind).over(w)})
    ended = F.col("last").isin("done", "error")
    return rows.where(ended | ((F.col(kind) != "error") & ((F.col("place") == 0) | (F.col("place") < F.col("before"))))).select(session, order, kind)


def sse_events(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """``key, no, event, data`` of server-sent event bodies: blank-line parted blocks of 'event:' and 'data:' lines."""
    blocks = F.filter(F.split(F.col(body), "\n\n"), lambda b: F.trim(b) != "")
    rows = bodies.select(key, F.posexplode(blocks).alias("no", "block"))
    data = F.array_join(F.regexp_extract_all("block", F.lit(r"(?m)^data:\s?(.*)$"), F.lit(1)), "\n")
    return rows.select(key, "no", F.coalesce(F.nullif(F.regexp_extract("block", r"(?m)^event:\s*(.*)$", 1), F.lit("")), F.lit("message")).alias("event"), data.alias("data"))


def windowed(events: DataFrame, ts: str, width: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts by tumbling or sliding window and keys; works on a stream as on a table."""
    w = F.window(F.col(ts).cast("timestamp"), width, slide) if slide else F.window(F.col(ts).cast("timestamp"), width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
