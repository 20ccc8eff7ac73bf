"""The task fold and the sync as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from halyard.operators import catalog_index
from halyard.operators.tasks import FINISHED, debounced, fold_timed
from halyard.schema import TASK_STATES
from halyard.sources.catalog import VersionedTable

EVENT_CODES = {name: k for k, name in enumerate(TASK_STATES)}


class Waiting:
    """A key's rows (us, seq, what) that the watermark has not passed, in order of time and number, as one binary value: the rows of
    a list state go to the state store and back one by one, which takes longer than all else that is done with them."""

    ROW = np.dtype([("us", "<i8"), ("seq", "<i8"), ("what", "i1")])

    def __init__(self, handle: StatefulProcessorHandle):
        self.state = handle.getValueState("waiting", "rows binary")

    def get(self) -> np.ndarray:
        held = self.state.get()
        return np.frombuffer(bytes(held[0]), self.ROW) if held else np.empty(0, self.ROW)

    def put(self, rows: np.ndarray) -> None:
        self.state.update((rows.tobytes(),))

    def add(self, old: np.ndarray, batches: Iterator[pd.DataFrame], what) -> np.ndarray:
        """``old`` with the rows of ``batches``, ``what(batch)`` being their third column; kept in the state."""
        parts = [old]
        for batch in batches:
            part = np.empty(len(batch), self.ROW)
            part["us"], part["seq"], part["what"] = batch["ts"].astype("datetime64[us]").astype("int64"), batch["seq"], what(batch)
            parts.append(part)
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["what"], rows["seq"], rows["us"]))]
        self.put(rows)
        return rows


class TaskFold(StatefulProcessor):
    """A task's settled state, and its events that the watermark has not passed.

    Late events may still come before those, so they wait in order; a timer at the earliest one's time settles what the
    watermark has passed. What is told at each batch is the state after all events so far, and is told again if a late
    event changes it. With ``forget_ms``, a finished task that has been quiet for so long is a new one if it is heard
    of again (``fold_timed``): its state goes when the watermark tells so."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "status string, last_us long")
        self.waiting = Waiting(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.waiting.get()
        waiting = self.waiting.add(old, rows, lambda batch: [EVENT_CODES.get(s, -1) for s in batch["status"]])
        if not len(old) or waiting["us"][0] < old["us"][0]:
            self._arm(int(waiting["us"][0]), int(old["us"][0]) if len(old) else None)
        status, _ = self._folded(waiting)
        yield pd.DataFrame({"task_id": [key[0]], "status": [status]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self.waiting.get()
        passed, rest = waiting[waiting["us"] <= watermark], waiting[waiting["us"] > watermark]
        state = self._folded(passed)
        if len(passed):
            self.settled.update(state)
            self.waiting.put(rest) if len(rest) else self.waiting.state.clear()
        if len(rest):
            self._arm(int(rest["us"][0]))
        elif self.forget_ms is not None and state[0] in FINISHED:
            over = state[1] + self.forget_ms * 1000
            if over < watermark:
                self.settled.clear()
            else:
                self._arm(over + 1000)
        yield from ()

    def _folded(self, rows: np.ndarray) -> tuple[str | None, int | None]:
        """The settled state after ``rows``; what is no event of the fold changes nothing."""
        names = [TASK_STATES[k] if k >= 0 else None for k in rows["what"].tolist()]
        return fold_timed(self._state(), zip(rows["us"].tolist(), rows["seq"].tolist(), names, strict=True), self.forget_ms)

    def _state(self) -> tuple[str | None, int | None]:
        return self.settled.get() or (None, None)

    def _arm(self, us: int, before: int | None = None) -> None:
        """A timer at the first millisecond that is not before ``us``, in place of the one for ``before``."""
        if before is not None:
            self.handle.deleteTimer(-(-before // 1000))
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def task_states(events: DataFrame, late: str = "10 seconds", forget_ms: int | None = None) -> DataFrame:
    """(task_id, status) updates of a stream of (task_id, seq, ts, status). Events fold in (ts, seq) order, whatever batch they
    come in, if they are at most ``late`` behind the newest; later ones are dropped. A task keeps one string and a time
    besides its events of the last ``late``; with ``forget_ms`` not even that, once it is finished and quiet."""
    timely = events.withWatermark("ts", late).groupBy("task_id")
    return timely.transformWithStateInPandas(statefulProcessor=TaskFold(forget_ms), outputStructType="task_id long, status string", outputMode="Update", timeMode="EventTime")


class NewOutputs(StatefulProcessor):
    """A task's last event, and the outputs that were told: each is told once, at the first batch that ends with its task
    completed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long, seq long, status string")
        self.told = handle.getMapState("told", "output_id long", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, outputs = self.last.get(), {}
        for batch in rows:
            micros = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
            for us, seq, status, made in zip(micros, batch["seq"].tolist(), batch["status"].tolist(), batch["outputs"], strict=True):
                last = max(last or (us, seq, status), (us, seq, status), key=lambda e: e[:2])
                outputs |= dict.fromkeys(() if made is None else map(int, made))
        self.last.update(last)
        fresh = [o for o in outputs if not self.told.containsKey((o,))] if last[2] == "completed" else []
        for o in fresh:
            self.told.updateValue((o,), (last[0],))
        yield pd.DataFrame({"task_id": [key[0]] * len(fresh), "output_id": pd.Series(fresh, dtype="int64")})

    def close(self) -> None:
        pass


def new_outputs(events: DataFrame) -> DataFrame:
    """(task_id, output_id) of a stream of (task_id, seq, ts, status, outputs): what each task that completes has made, once."""
    return events.groupBy("task_id").transformWithStateInPandas(statefulProcessor=NewOutputs(), outputStructType="task_id long, output_id long", outputMode="Append", timeMode="None")


class NewestResults(StatefulProcessor):
    """A key's requests and results that the watermark has not passed, and the newest request that it has. A timer at the earliest
    of them takes what the watermark has passed in order of time: whatever was asked for up to a result's time is known then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "seq long")
        self.waiting = Waiting(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.waiting.get()
        waiting = self.waiting.add(old, rows, lambda batch: batch["result"])
        if not len(old) or waiting["us"][0] < old["us"][0]:
            if len(old):
                self.handle.deleteTimer(-(-int(old["us"][0]) // 1000))
            self.handle.registerTimer(-(-int(waiting["us"][0]) // 1000))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        known = self.newest.get()
        newest = known[0] if known else None
        waiting = self.waiting.get()
        passed, rest = waiting[waiting["us"] <= until], waiting[waiting["us"] > until]
        kept = []
        for _, seq, result in passed.tolist():  # in order of time, at one time by number, requests before results
            if not result:
                newest = seq if newest is None else max(newest, seq)
            elif newest is None or seq >= newest:
                kept.append(seq)
        if newest is not None:
            self.newest.update((newest,))
        if len(passed):
            self.waiting.put(rest) if len(rest) else self.waiting.state.clear()
        if len(rest):
            self.handle.registerTimer(-(-int(rest["us"][0]) // 1000))
        yield pd.DataFrame({"key": [key[0]] * len(kept), "seq": pd.Series(kept, dtype="int64")})

    def close(self) -> None:
        pass


def newest_results(requests: DataFrame, results: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(key, seq) of the results (key, seq, ts) that no newer request (key, seq, ts) had overtaken when they came: those of the time
    of a result or before it count. Both streams may be ``late``; results are told once the watermark has passed them."""
    both = requests.select("key", "seq", "ts", F.lit(False).alias("result")).unionByName(results.select("key", "seq", "ts", F.lit(True).alias("result")))
    return both.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(statefulProcessor=NewestResults(), outputStructType="key long, seq long", outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def change_bursts(changes: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of a stream of changes; the watermark bounds what is kept open."""
    return debounced(changes.withWatermark("ts", late), quiet)


def sync_on_bursts(bursts: DataFrame, table: VersionedTable, read_source, checkpoint: str):
    """Syncs the index once a micro-batch with bursts. Micro-batches run one at a time, so syncs never overlap; a
    repeated batch writes the same table again, and what other writers change meanwhile is synced, not overwritten."""

    def run(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            table.change(lambda now: catalog_index.sync(now, read_source()))

    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run)


def sizes_from(stream: DataFrame, table: VersionedTable, checkpoint: str):
    """A stream of (id, size_bytes) put into the index."""

    def run(batch: DataFrame, _: int) -> None:
        new = batch.filter(F.col("size_bytes") >= 0)
        table.change(lambda now: catalog_index.set_sizes(now, new))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
