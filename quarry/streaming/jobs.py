"""Queues of jobs for each key, as a stream with state: in order, one at a time, one retry after a delay.

Requests (job_id, key, kind, ts, seconds, fails): kind is process, reindex or cancel; seconds is how long a run takes and fails how many of
its runs fail, which a real worker would report. A key's jobs run one after another in the order of their request times. A job that
fails is tried once more, a minute after it failed, and its key waits for nothing else meanwhile than other jobs. A cancelled job that
hasn't ended ends as cancelled. What happens is a row: job_id, key, ts, status, attempt; statuses are queued or
reindex_queued, processing, retrying, completed, failed, cancelled.

State is a queue in event time; a timer at the next moment at which something may happen goes on with it. Rows only leave when the watermark
has passed them, so late requests within it find their place. Repeated requests of a job count once while its key has anything to
do; a key without is forgotten.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Runs of a job, and seconds before the second.
RUNS, DELAY = 2, 60
OUTPUT = "job_id long, key long, ts timestamp, status string, attempt int"


def run_until(requests: list[tuple], end: float) -> tuple[list[tuple], float | None]:
    """What happens before end to the requests (ts, job_id, kind, seconds, fails) of a key, in order; and when the next thing will.

    Rows: ts, job_id, status, attempt. Of repeated requests of a job the first counts; cancellations name the job they end.
    """
    first: dict[int, tuple] = {}
    cancelled: dict[int, float] = {}
    for ts, job, kind, seconds, fails in sorted(requests):
        if kind == "cancel":
            cancelled.setdefault(job, ts)
        elif job not in first:
            first[job] = (ts, job, kind, seconds, fails)
    rows: list[tuple] = []
    waiting = [(ts, job, 1) for job, (ts, *_) in first.items()]
    heapq.heapify(waiting)
    rows += [(ts, job, "reindex_queued" if kind == "reindex" else "queued", 0) for job, (ts, _, kind, _, _) in first.items()]
    free = float("-inf")
    while waiting:
        ts, job, attempt = heapq.heappop(waiting)
        start, (_, _, _, seconds, fails) = max(ts, free), first[job]
        stop = cancelled.get(job, float("inf"))
        if stop <= start:
            rows.append((max(stop, first[job][0]), job, "cancelled", attempt))
            continue
        rows.append((start, job, "processing", attempt))
        free = min(start + seconds, stop)
        if stop < start + seconds:
            rows.append((stop, job, "cancelled", attempt))
        elif attempt > fails:
            rows.append((free, job, "completed", attempt))
        elif attempt < RUNS:
            rows.append((free, job, "retrying", attempt))
            heapq.heappush(waiting, (free + DELAY, job, attempt + 1))
        else:
            rows.append((free, job, "failed", attempt))
    rows.sort(key=lambda r: (r[0], r[1], r[3]))
    later = [r[0] for r in rows if r[0] >= end]
    return [r for r in rows if r[0] < end], min(later, default=None)


def _rows(requests: pd.DataFrame) -> list[tuple]:
    return [(t.timestamp(), int(j), k, float(s), int(f)) for t, j, k, s, f in zip(requests["ts"], requests["job_id"], requests["kind"], requests["seconds"], requests["fails"], strict=True)]


def _frame(key: int, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"job_id": [r[1] for r in rows], "key": key, "ts": pd.to_datetime([r[0] for r in rows], unit="s"), "status": [r[2] for r in rows], "attempt": [r[3] for r in rows]}).astype({"job_id": "int64", "key": "int64", "ts": "datetime64[ns]", "attempt": "int32"})


def batch(requests: DataFrame) -> DataFrame:
    """All that happens to requests, as a batch: a key's requests are one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _frame(int(group["key"].iloc[0]), run_until(_rows(group), float("inf"))[0])

    return requests.select("job_id", "key", "kind", "ts", "seconds", "fails").groupBy("key").applyInPandas(run, OUTPUT)


class Queue(StatefulProcessor):
    """Requests of a key that may still matter, and until when rows have left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queue", "requests string, until double")

    def _go_on(self, key: int, new: list[tuple], now_ms: int) -> Iterator[pd.DataFrame]:
        held, until = self.state.get() if self.state.exists() else ("[]", 0.0)
        requests = [tuple(r) for r in json.loads(held)] + [r for r in new if r[0] >= until]  # later ones than the watermark allows are dropped
        now = max(now_ms / 1000, until)
        rows, following = run_until(requests, now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if following is None:
            # Nothing is left to happen: ended jobs can go, and so can the state.
            self.state.clear()
        else:
            self.state.update((json.dumps(requests), now))
            self.handle.registerTimer(int(following * 1000) + 1)
        out = [r for r in rows if r[0] >= until]
        if out:
            yield _frame(key, out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in _rows(part)]
        yield from self._go_on(int(key[0]), new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(int(key[0]), [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same as a stream: rows leave once the watermark has passed them. Needs the RocksDB state store."""
    requests = requests.select("job_id", "key", "kind", "ts", "seconds", "fails").withWatermark("ts", late)
    return requests.groupBy("key").transformWithStateInPandas(Queue(), OUTPUT, "Append", "EventTime")


def latest(happened: DataFrame) -> DataFrame:
    """The state of each job: its last row."""
    return happened.groupBy("key", "job_id").agg(F.max_by(F.struct("status", "attempt", "ts"), F.struct("ts", "attempt", F.col("status").isin("completed", "failed", "cancelled", "retrying"))).alias("x")).select("key", "job_id", "x.status", "x.attempt", "x.ts")
