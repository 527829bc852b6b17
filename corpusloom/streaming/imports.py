"""The life of imported files as state of a stream: steps, retries, time limits and dead letters.

A file is uploaded, converting, embedding, completed; failed after so many failures, or duplicate. One function, advance,
says what an event does, for streams and tables alike. The state of a file is a value, its history a bounded list, and a
timer counts a file that stays silent as failed. State outlives the stream, so a restart goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The steps of a file in order, and the states in which it stays.
STEPS = {"uploaded": 0, "converting": 1, "embedding": 2, "completed": 3}
ENDS = ("completed", "duplicate", "failed")
#: Attempts of a file, events of its history that are kept, and milliseconds that it may stay silent.
ATTEMPTS, HISTORY, SILENCE = 3, 20, 30 * 60_000
#: What the state store must be for timers and lists.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

VALUE = "task_id string, state string, seq long, failures int, error string, at long"
OUT = "file_id string, task_id string, state string, seq long, failures int, error string, at long, history array<string>"


class File(NamedTuple):
    """What is known of a file: seq and at (milliseconds) are its last event's."""

    task_id: str | None = None
    state: str = ""
    seq: int = -1
    failures: int = 0
    error: str | None = None
    at: int = 0


def advance(file: File, event: str, seq: int, error: str | None, at: int, attempts: int = ATTEMPTS) -> File:
    """A file after an event.

    Events that aren't later than the last one, steps back, and events of a file at its end change nothing but its place in
    the sequence; only "retry" takes a failed file up again. A failure begins anew, or ends in failed.
    """
    if seq <= file.seq:
        return file
    file = file._replace(seq=seq, at=max(at, file.at))
    if event == "retry":
        return file._replace(state="uploaded", failures=0, error=None) if file.state == "failed" else file
    if file.state in ENDS:
        return file
    if event in ("failed", "silent"):
        failures = file.failures + 1
        return file._replace(state="failed" if failures >= attempts else "uploaded", failures=failures, error=error or "stayed silent")
    if event == "duplicate":
        return file._replace(state="duplicate") if file.state in ("", "uploaded") else file
    if event in STEPS and STEPS[event] > STEPS.get(file.state, -1):
        return file._replace(state=event, error=None if event == "completed" else file.error)
    return file


def quiet(file: File, now: int, silence: int, attempts: int) -> tuple[File, list[str]]:
    """A file after the time limits that have passed by now, each a failure of its own, and what they were."""
    seen = []
    while file.state and file.state not in ENDS and now - file.at >= silence:
        file, seq = advance(file, "silent", file.seq + 1, None, file.at + silence, attempts)._replace(seq=file.seq), file.seq
        seen.append(f"{seq}:silent")
    return file, seen


def _row(file_id: str, file: File, history: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"file_id": [file_id], **{k: [v] for k, v in file._asdict().items()}, "history": [history]})


def _told(rows: pd.DataFrame) -> Iterator[tuple]:
    return zip(rows["task_id"], rows["event"], rows["seq"], rows["error"].where(rows["error"].notna(), None), rows["at"], strict=True)


def _run(file: File, history: list[str], rows: pd.DataFrame, silence: int, attempts: int) -> tuple[File, list[str]]:
    for task, event, seq, error, at in _told(rows.sort_values("seq", kind="stable")):
        if seq > file.seq:
            file, seen = quiet(file, int(at), silence, attempts) if file.state else (file, [])
            file = advance(file._replace(task_id=file.task_id or task), event, int(seq), error, int(at), attempts)
            history = [*history, *seen, f"{seq}:{event}"][-HISTORY:]
    return file, history


class Importer(StatefulProcessor):
    """The state of one file each."""

    def __init__(self, attempts: int = ATTEMPTS, silence: int = SILENCE):
        self.attempts, self.silence = attempts, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("file", VALUE)
        self.history = handle.getListState("history", "entry string")

    def _load(self) -> tuple[File, list[str]]:
        file = File(*self.value.get()) if self.value.exists() else File()
        return file, [x[0] for x in self.history.get()] if self.history.exists() else []

    def _store(self, file: File, history: list[str]) -> None:
        self.value.update(tuple(file))
        self.history.put([(x,) for x in history])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if file.state and file.state not in ENDS:
            self.handle.registerTimer(file.at + self.silence)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        file, history = _run(*self._load(), pd.concat(list(rows)), self.silence, self.attempts)
        self._store(file, history)
        yield _row(key[0], file, history)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        file, history = self._load()
        file, seen = quiet(file, max(timerValues.getCurrentWatermarkInMs(), file.at + self.silence), self.silence, self.attempts)
        history = [*history, *seen][-HISTORY:]
        self._store(file, history)
        yield _row(key[0], file, history)

    def close(self) -> None:
        """Nothing is held beside the state."""


def _prepared(events: DataFrame) -> DataFrame:
    return events.select("file_id", "task_id", "event", F.col("seq").cast("long").alias("seq"), "error", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").cast("timestamp").alias("ts"))


def file_states(events: DataFrame, attempts: int = ATTEMPTS, silence: int = SILENCE, late: str = "0 seconds") -> DataFrame:
    """The state of each file that a batch of a stream touches, or that has stayed silent for too long by the watermark.

    events: file_id, task_id, event, seq, error, ts. A file's events must come in the order of seq, as late ones are
    dropped as repetitions. Needs the state store of PROVIDER.
    """
    rows = _prepared(events).withWatermark("ts", late)
    return rows.groupBy("file_id").transformWithStateInPandas(statefulProcessor=Importer(attempts, silence), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def table_states(events: DataFrame, now: int | None = None, attempts: int = ATTEMPTS, silence: int = SILENCE) -> DataFrame:
    """The states that a table of events leaves, by a time in milliseconds (without one the last event's)."""
    rows = _prepared(events)
    now = now if now is not None else rows.agg(F.max("at")).first()[0]

    def states(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        file, history = _run(File(), [], part, silence, attempts)
        file, seen = quiet(file, now, silence, attempts)
        return _row(key[0], file, [*history, *seen][-HISTORY:])

    return rows.groupBy("file_id").applyInPandas(states, OUT)  # a file has few events


def latest(updates: DataFrame) -> DataFrame:
    """Of a stream's updates the last of each file: of the greatest seq the one with most failures or a later time."""
    order = Window.partitionBy("file_id").orderBy(F.desc("seq"), F.desc("at"), F.desc("failures"))
    return updates.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def dead_letters(states: DataFrame) -> DataFrame:
    """Files that failed for good, with their last error and history."""
    return states.where("state = 'failed'").select("file_id", "task_id", "error", "failures", "history")


def tasks(states: DataFrame) -> DataFrame:
    """For each task its files, those processed and failed, the percent processed (one digit), and its state."""
    n = F.count("*").alias("total_files")
    rows = states.groupBy("task_id").agg(n, F.count_if(F.col("state").isin(*ENDS)).alias("processed_files"), F.count_if(F.col("state") == "failed").alias("failed_files"))
    return rows.select("*", F.bround(F.col("processed_files") * 100.0 / F.col("total_files"), 1).alias("progress_percent"), F.when(F.col("processed_files") == F.col("total_files"), "completed").otherwise("running").alias("status"))
