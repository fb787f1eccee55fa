"""A job queue as a stream: each job's state with its legal moves, and a timer that ends jobs nobody works on."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.streaming.jobs import ACTIVE, TERMINAL

#: What may follow each state; a job begins as queued.
MOVES = {None: ["queued"], "queued": ["preparing", "failed", "expired"], "preparing": ["docking", "failed"], "docking": ["converting", "failed"], "converting": ["complete", "failed"]}

_OUT = "job string, status string, updated_at timestamp, no bigint, accepted boolean"
_STATE = "status string, updated_at timestamp, no bigint"


def next_state(status: str | None, asked: str) -> str | None:
    """The state after a request for one, None where the move is not legal; a finished job moves no more."""
    return asked if asked in MOVES.get(status, []) else None


def moved(stream: DataFrame, job: str, ts: str, status: str, late: str = "1 hour", hours: int = 24) -> DataFrame:
    """``job, status, updated_at, no, accepted``: each request of a stream of ``(job, ts, status)`` in the order of time, with the state after it and the job's number of accepted moves so far.

    A job that stays for ``hours`` without a move and is not being worked on (or is not finished) becomes expired: by a timer of event time when the watermark (``late`` behind the newest event)
    passes, or at its next request. The state of a job is one row; a job's requests of one micro-batch meet in one task in the order of time, of equal times in that of :data:`MOVES`. Requests that are
    later than the watermark are dropped, as by any stream. After a stop the checkpoint restores states and timers.
    """
    life = datetime.timedelta(hours=hours)
    places = {s: i for i, s in enumerate(["queued", *ACTIVE, *TERMINAL])}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, at, no = state.get if state.exists else (None, None, 0)
        out = []

        def expire(upto: datetime.datetime) -> None:
            nonlocal now, at, no
            if at is not None and now == "queued" and at + life < upto:
                now, at, no = "expired", at + life, no + 1
                out.append((key[0], now, at, no, True))

        if state.hasTimedOut:
            expire(datetime.datetime.max)
        else:
            rows = pd.concat(list(parts))
            rows["place"] = rows["status"].map(places).fillna(len(places))
            for when, asked in rows.sort_values(["ts", "place"])[["ts", "status"]].itertuples(index=False):
                when = when.to_pydatetime()
                expire(when)
                after = next_state(now, asked)
                if after is not None:
                    now, at, no = after, when, no + 1
                out.append((key[0], now, when, no, after is not None))
        if no:
            state.update((now, at, no))
        if now == "queued":
            due = int((at.replace(tzinfo=datetime.timezone.utc) + life).timestamp() * 1000) + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job", "status", "updated_at", "no", "accepted"])

    rows = stream.select(F.col(job).cast("string").alias("job"), F.col(ts).cast("timestamp").alias("ts"), F.col(status).alias("status")).where("job is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("job").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def current(moves: DataFrame) -> DataFrame:
    """``job, status, updated_at`` after all accepted moves so far: a map-side combined maximum by the move's number."""
    return moves.where("accepted").groupBy("job").agg(F.max_by("status", "no").alias("status"), F.max_by("updated_at", "no").alias("updated_at"))
