"""Streaming usage guard and attempts: keyed state in event time, kept in the state store, that goes when a key has been quiet.

Rows wait in the key's state until the watermark has passed them. Then they are taken in order of time, whatever order or batch they came in, so that a
replay gives what the batch operators give. Timers are in event time: state expires by what the rows say, not by when they are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_S, MINUTE_S = 86_400, 60
#: The store that holds state on the executors' disks and its changes under the checkpoint.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PLAIN = {"long": int, "boolean": bool, "string": str}
#: Groups of keys. A group's rows wait together, as most keys have few rows and each call to the state store has its price.
GROUPS = 1024

Step = Callable[[int, list[tuple], bytes], tuple[list[tuple], bytes]]


def _values(column: pd.Series, kind: str) -> list:
    """The column as plain values; a null makes numbers floats, also where it is another group's."""
    return [None if none else PLAIN[kind](x) for x, none in zip(column.tolist(), column.isna(), strict=True)]


class InOrder(StatefulProcessor):
    """Hands the rows of each key of a group to step(key, rows, memory) -> (out, memory) once the watermark has passed them, in order of `us` and run_id.

    schema: the rows' columns, the key first, then run_id and us (microseconds). out: the columns of what comes out. memory is what a key keeps; it is
    forgotten once the watermark is `quiet_s` seconds past the key's last row.
    """

    def __init__(self, schema: str, step: Step, out: str, quiet_s: int):
        self.schema, self.step, self.quiet_us = schema, step, quiet_s * 1_000_000
        self.columns = [tuple(c.split()) for c in schema.split(", ")]
        self.out = [c.split()[0] for c in out.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.memory = handle.getMapState("memory", "key long", "memory binary, last long")
        self.quiet = handle.getValueState("quiet", "at long")

    def _timer(self, us: int) -> None:
        """A timer once the watermark is past that time."""
        self.handle.registerTimer(us // 1000 + 1)

    def _forget(self, past: int) -> None:
        """Drops what quiet keys keep, and sets the time at which the next one may be quiet."""
        ends = {key: value[1] + self.quiet_us for key, value in self.memory.iterator()}
        for key, end in ends.items():
            if end < past:
                self.memory.removeKey(key)
        left = [end for end in ends.values() if end >= past]
        if left:
            self.quiet.update((min(left),))
            self._timer(min(left))
        else:
            self.quiet.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self.waiting.appendList(list(zip(*(_values(frame[name], kind) for name, kind in self.columns), strict=True)))
            first = min(x for x in (first, int(frame["us"].min())) if x is not None)
        if first is not None:
            self._timer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(r) for r in rows if r[2] < past), key=lambda r: (r[0], r[2], r[1]))
        told = []
        if due:
            later = [tuple(r) for r in rows if r[2] >= past]
            if later:
                self.waiting.put(later)
                self._timer(min(r[2] for r in later))
            else:
                self.waiting.clear()
            for own, mine in groupby(due, key=lambda r: r[0]):
                mine, known = list(mine), self.memory.getValue((own,))
                out, memory = self.step(own, mine, bytes(known[0]) if known else b"")
                told += out
                self.memory.updateValue((own,), (memory, mine[-1][2]))
        quiet = self.quiet.get() if self.quiet.exists() else None
        if due and quiet is None:
            at = min(r[2] for r in due) + self.quiet_us
            self.quiet.update((at,))
            self._timer(at)
        elif not due and quiet is not None and quiet[0] < past:
            self._forget(past)
        if told:
            yield pd.DataFrame(told, columns=self.out)

    def close(self) -> None:
        pass


def _rates(user: int, rows: list[tuple], memory: bytes) -> tuple[list[tuple], bytes]:
    """Of rows (user, run_id, us, tokens). Memory: times and tokens of the last day's rows."""
    old = np.frombuffer(memory, "int64").reshape(2, -1)
    us = np.array([r[2] for r in rows], "int64")
    times, tokens = np.concatenate([old[0], us]), np.concatenate([old[1], np.array([r[3] or 0 for r in rows], "int64")])
    spent = np.concatenate([[0], np.cumsum(tokens)])
    now, minute, day = (np.searchsorted(times, us - back * 1_000_000, "left") for back in (0, MINUTE_S, DAY_S))
    left = np.searchsorted(times, times[-1] - DAY_S * 1_000_000, "left")
    out = zip((r[1] for r in rows), [user] * len(rows), (now - minute).tolist(), (now - day).tolist(), (spent[now] - spent[day]).tolist(), strict=True)
    return list(out), np.stack([times[left:], tokens[left:]]).astype("int64").tobytes()


def _attempts(thread: int, rows: list[tuple], memory: bytes) -> tuple[list[tuple], bytes]:
    """Of rows (thread, run_id, us, pushed_back, feedback). Memory: the last attempt's number and the last thumbs."""
    count, thumbs = json.loads(memory) if memory else (0, "")
    out = []
    for _, run, _, again, feedback in rows:
        count = max(count, 1) + 1 if again or thumbs == "down" else 1
        out.append((run, thread, count))
        if feedback == "up":
            count = 1
        thumbs = feedback or thumbs
    return out, json.dumps([count, thumbs]).encode()


def _in_order(stream: DataFrame, key: str, rows: str, step: Step, out: str, late: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    processor = InOrder(f"{key} long, {rows}", step, out, DAY_S)
    grouped = stream.where(F.col(key).isNotNull()).withWatermark("ts", late).withColumn("__group", F.pmod(F.xxhash64(key), F.lit(GROUPS)))
    return grouped.groupBy("__group").transformWithStateInPandas(processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def usage_rates(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(run_id, user, per_minute, per_day, tokens_day) of a stream (run_id long, user long, ts timestamp, us long, tokens long).

    Rows that come later than the watermark allows are dropped. A user's state is the last day's rows and those that wait, and goes a day after the last one.
    Null tokens count as 0; rows without a user are left out.
    """
    return _in_order(events, "user", "run_id long, us long, tokens long", _rates, "run_id long, user long, per_minute long, per_day long, tokens_day long", late)


def attempts(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """(run_id, thread, attempt) of a stream (run_id long, thread long, ts timestamp, us long, pushed_back boolean, feedback string). A thread is forgotten after a day without rows; rows without one are left out."""
    return _in_order(requests, "thread", "run_id long, us long, pushed_back boolean, feedback string", _attempts, "run_id long, thread long, attempt long", late)


def state_rows(spark: SparkSession, checkpoint: str, name: str) -> int:
    """How many keys have the state variable of that name, by a stream's checkpoint; for tests and reports."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()
