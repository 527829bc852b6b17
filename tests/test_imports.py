"""Files' states: what events do, and a stream that is stopped and restarted against the table's states."""

import datetime as dt
import random

import pytest

from corpusloom.streaming import imports, ingest

SCHEMA = "file_id string, task_id string, event string, seq long, error string, ts timestamp"
START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_what_events_do():
    go = lambda *events, attempts=3: [f := imports.File()] and [f := imports.advance(f, e, i, "x" if e == "failed" else None, i, attempts) for i, e in enumerate(events)][-1]
    assert go("uploaded", "converting", "embedding", "completed")[1] == "completed"
    assert go("uploaded", "converting", "uploaded")[1] == "converting" and go("completed", "failed")[1] == "completed"
    assert go("uploaded", "failed")[1:5] == ("uploaded", 1, 1, "x") and go("uploaded", "failed", "failed", "failed")[1:5] == ("failed", 3, 3, "x")
    assert go("uploaded", "failed", "failed", "failed", "converting")[1] == "failed" and go("uploaded", "failed", "failed", "failed", "retry")[1:5] == ("uploaded", 4, 0, None)
    assert go("uploaded", "duplicate")[1] == "duplicate" and go("uploaded", "embedding", "duplicate")[1] == "embedding" and go("odd")[1] == ""
    f = imports.advance(imports.File(), "uploaded", 5, None, 0)
    assert imports.advance(f, "completed", 5, None, 9) == f
    late, seen = imports.quiet(f, 100, 40, 3)
    assert late[1:6] == ("uploaded", 5, 2, "stayed silent", 80) and len(seen) == 2 and imports.quiet(f, 1000, 40, 3)[0].state == "failed"


def made(seed=3):
    """Events of files in four batches, by time, each file's in order."""
    r = random.Random(seed)
    rows = []
    for k in range(40):
        t, seq = r.randint(0, 50), 0
        kinds = ["uploaded", "duplicate"] if k % 9 == 0 else ["uploaded", *r.choices(["converting", "embedding", "failed", "failed", "completed"], k=r.randint(0, 7))]
        for e in kinds:
            rows.append((f"f{k}", f"t{k % 4}", e, seq, f"error {seq}" if e == "failed" else None, at(t)))
            if r.random() < 0.2:
                rows.append(rows[-1])  # comes twice
            seq += r.randint(1, 2)
            t += r.choice([1, 2, 5, 20, 45])
    rows.append(("end", "t9", "uploaded", 0, None, at(500)))
    rows.sort(key=lambda x: x[5])
    return [[x for x in rows if a <= (x[5] - START).total_seconds() / 60 < b] for a, b in ((0, 40), (40, 80), (80, 200), (200, 1000))], rows


@pytest.fixture
def store(spark):
    for k, v in imports.PROVIDER.items():
        spark.conf.set(k, v)
    yield
    for k in imports.PROVIDER:
        spark.conf.unset(k)


def test_a_stream_that_is_restarted(spark, store, tmp_path):
    batches, rows = made()
    source, target, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        states = imports.file_states(ingest.file_stream(spark, source, schema, 1))
        states.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{target}/n={n:04d}")).option("checkpointLocation", check).outputMode("update").trigger(availableNow=True).start().awaitTermination()

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k != 1:  # stopped and started again; the second start has two batches
            run()
    got = imports.latest(spark.read.parquet(target).drop("n"))
    want = imports.table_states(spark.createDataFrame(rows, SCHEMA))
    key = lambda df: sorted((r["file_id"], r["task_id"], r["state"], r["seq"], r["failures"], r["error"]) for r in df.collect())
    assert key(got) == key(want)
    states = {r["state"] for r in want.collect()}
    assert states >= {"completed", "failed", "duplicate", "uploaded"}
    dead = {r["file_id"]: r for r in imports.dead_letters(got).collect()}
    assert dead and all(r["failures"] >= 3 and r["error"] and r["history"] for r in dead.values()) and any(r["error"] == "stayed silent" for r in dead.values())
    by = {r["task_id"]: r for r in imports.tasks(got).collect()}
    assert by["t9"]["status"] == "running" and by["t0"]["total_files"] == 10 and by["t0"]["status"] == "completed" and by["t0"]["progress_percent"] == 100.0
