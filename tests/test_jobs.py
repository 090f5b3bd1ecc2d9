"""Queues of jobs: a plain run, and the stream against the batch."""

import random
from datetime import datetime, timedelta, timezone

from quarry.streaming import jobs

SCHEMA = "job_id long, key long, kind string, ts timestamp, seconds double, fails int"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_order_retry_and_cancel():
    requests = [(0, 1, "process", 10, 0), (1, 2, "process", 5, 1), (2, 3, "reindex", 5, 2), (3, 4, "process", 5, 0), (4, 4, "cancel", 0, 0), (5, 5, "process", 100, 0), (60, 5, "cancel", 0, 0), (5, 1, "process", 7, 0)]
    rows, following = jobs.run_until(requests, float("inf"))
    of = lambda j: [(t, s, a) for t, i, s, a in rows if i == j]
    assert of(1) == [(0, "queued", 0), (0, "processing", 1), (10, "completed", 1)]
    assert of(2) == [(1, "queued", 0), (10, "processing", 1), (15, "retrying", 1), (75, "processing", 2), (80, "completed", 2)]
    assert of(3) == [(2, "reindex_queued", 0), (15, "processing", 1), (20, "retrying", 1), (80, "processing", 2), (85, "failed", 2)]
    assert of(4) == [(3, "queued", 0), (4, "cancelled", 1)] and of(5)[-2:] == [(20, "processing", 1), (60, "cancelled", 1)]
    assert following is None and jobs.run_until(requests, 15)[1] == 15


def requests(seed, n=60):
    rng, out = random.Random(seed), []
    for i in range(n):
        at = START + timedelta(seconds=rng.randrange(0, 3000))
        key = rng.choice([1, 1, 1, 2, 3])
        out.append((i, key, rng.choice(["process", "process", "reindex"]), at, float(rng.randrange(1, 90)), rng.choice([0, 0, 1, 2])))
        if rng.random() < 0.2:
            out.append((i, key, "cancel", at + timedelta(seconds=rng.randrange(0, 200)), 0.0, 0))
        if rng.random() < 0.2:
            out.append((i, key, "process", at + timedelta(seconds=30), 5.0, 0))
    return sorted(out, key=lambda r: r[3].timestamp() + rng.randrange(0, 500))  # late by less than the watermark


def test_the_stream_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests(3)
    end = [(10_000 + k, 99, "process", START + timedelta(days=1 + k), 1.0, 0) for k in range(2)]  # moves the watermark beyond all
    source, step = tmp_path / "in", 25
    for i, at in enumerate(range(0, len(rows), step)):
        spark.createDataFrame(rows[at : at + step], SCHEMA).coalesce(1).write.parquet(f"{source}/{i}")
    for k, row in enumerate(end):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(f"{source}/z{k}")
    import os
    import time

    now = time.time()
    for i, folder in enumerate(sorted(os.listdir(source))):
        for f in (source / folder).iterdir():
            os.utime(f, (now + i, now + i))  # files are read in this order
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    for _ in range(2):  # started again, it goes on and adds nothing
        query = jobs.stream(read).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    order = lambda r: (r.key, r.ts, r.job_id, r.attempt, r.status)
    got = sorted(spark.read.parquet(str(tmp_path / "out")).where("key <> 99").collect(), key=order)
    held = spark.createDataFrame(rows, SCHEMA)
    want = sorted(jobs.batch(held).collect(), key=order)
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and {r.status for r in want} >= {"queued", "reindex_queued", "processing", "retrying", "completed", "failed", "cancelled"}
    last = {r.job_id: r.status for r in jobs.latest(jobs.batch(held)).collect()}
    assert len(last) == 60 and set(last.values()) <= {"completed", "failed", "cancelled"}
