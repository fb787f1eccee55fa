"""The job queue's stream, stopped and started again, against plain Python over all requests."""

import datetime
import random

from quern.streaming import job_queue
from quern.streaming.jobs import ACTIVE, TERMINAL

START = datetime.datetime(2024, 1, 1)


def by_hand(events, hours=24):
    """Accepted moves of each job: (status, time)."""
    order = {s: i for i, s in enumerate(["queued", *ACTIVE, *TERMINAL])}
    out, life = {}, datetime.timedelta(hours=hours)
    for job, when, asked in sorted(events, key=lambda e: (e[1], order.get(e[2], 99))):
        moves = out.setdefault(job, [])
        now = moves[-1][0] if moves else None
        if now == "queued" and moves[-1][1] + life < when:
            moves.append(("expired", moves[-1][1] + life))
            now = "expired"
        if asked in job_queue.MOVES.get(now, []):
            moves.append((asked, when))
    last = max(e[1] for e in events)
    for moves in out.values():
        if moves and moves[-1][0] == "queued" and moves[-1][1] + life < last - datetime.timedelta(hours=1):
            moves.append(("expired", moves[-1][1] + life))
    return {j: m for j, m in out.items() if m}


def test_stream_with_a_restart_equals_all_requests(spark, tmp_path):
    rng = random.Random(6)
    events, hour = [], datetime.timedelta(hours=1)
    for j in range(40):
        when = START + hour * rng.uniform(0, 40)
        for s in rng.choice([["queued", *ACTIVE, "complete"], ["queued"], ["queued", "preparing", "failed", "complete"], ["docking", "queued"], ["queued", "complete", "preparing"], ["queued", "queued", "nothing"]]):
            events.append((f"j{j}", when, s))
            when += hour * rng.choice([0.1, 1, 2, 30])
    events.append(("end", START + hour * 400, "queued"))
    events.sort(key=lambda e: e[1])
    source, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    schema = "job string, ts timestamp, status string"
    for part in (events[:60], events[60:120], events[120:]):  # each started from the checkpoint of the one before
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        moves = job_queue.moved(stream, "job", "ts", "status")
        moves.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = {}
    for r in spark.read.parquet(out).where("accepted").orderBy("job", "no").collect():
        found.setdefault(r["job"], []).append((r["status"], r["updated_at"]))
    want = by_hand(events)
    assert found == want
    assert {r["job"]: (r["status"], r["updated_at"]) for r in job_queue.current(spark.read.parquet(out)).collect()} == {j: m[-1] for j, m in want.items()}


def test_moves():
    assert job_queue.next_state(None, "queued") == "queued" and job_queue.next_state(None, "docking") is None
    assert all(job_queue.next_state(s, a) is None for s in TERMINAL for a in ["queued", *ACTIVE, *TERMINAL])
