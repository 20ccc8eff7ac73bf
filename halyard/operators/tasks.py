"""Task events folded into a state per task, and what screens ask of the states."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.numbers import elapsed_ms, progress_percent
from halyard.schema import TASK_STATES

FINISHED = ("completed", "cancelled", "failed")
FILTERS = {"all": TASK_STATES, "active": ("running", "pending"), "completed": ("completed",), "failed": ("failed", "cancelled")}
EVENT = "task_id long, seq long, ts timestamp, status string"


def fold(state: str | None, events: Iterable[str]) -> str | None:
    """The state after events in order. Tasks wait at first. A start lets a waiting task run; an error ends one that waits or
    runs; a task completes only while it runs. A cancel always holds; nothing else changes a finished task."""
    for event in events:
        state = state or "pending"
        if event == "cancelled":
            state = event
        elif state not in FINISHED and (event in ("running", "failed") or (event == "completed" and state == "running")):
            state = event
    return state


def fold_timed(state: tuple[str | None, int | None], events: Iterable[tuple[int, int, str]], forget_ms: int | None = None) -> tuple[str | None, int | None]:
    """(status, last time) after timed events (microseconds, seq, status) in order. With ``forget_ms``, a task that has been
    finished and quiet for more than that many milliseconds begins anew with its next event."""
    status, last = state
    for us, _, event in events:
        if forget_ms is not None and status in FINISHED and us - last > forget_ms * 1000:
            status = None
        status, last = fold(status, [event]), us
    return status, last


def latest(events: DataFrame) -> DataFrame:
    """(task_id, status) of each task's last event."""
    return events.groupBy("task_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def folded(events: DataFrame) -> DataFrame:
    """(task_id, status) by the fold's rules: a cancel holds; else the first end, a completion being one only after a start;
    else running once started. Both aggregates shuffle a row or two a task; only completions are looked at twice."""
    order = F.struct("ts", "seq")
    is_ = lambda s: F.col("status") == s
    seen = events.groupBy("task_id").agg(F.coalesce(F.max(is_("cancelled")), F.lit(False)).alias("cancelled"), F.min(F.when(is_("running"), order)).alias("started"), F.min(F.when(is_("failed"), order)).alias("failed"))
    starts = seen.filter("started is not null").select("task_id", "started")
    done = events.filter(is_("completed")).join(starts, "task_id").filter(order > F.col("started")).groupBy("task_id").agg(F.min(order).alias("completed"))
    first_end = F.when(F.col("failed").isNull() & F.col("completed").isNull(), F.lit(None)).when(F.col("completed").isNull() | (F.col("failed") < F.col("completed")), "failed").otherwise("completed")
    running = F.when(F.col("started").isNotNull(), "running").otherwise("pending")
    return seen.join(done, "task_id", "left").select("task_id", F.when(F.col("cancelled"), "cancelled").otherwise(F.coalesce(first_end, running)).alias("status"))


def folded_lives(events: DataFrame, forget_ms: int) -> DataFrame:
    """``fold_timed`` for tables: (task_id, status).

    A task's events are cut where it was quiet for more than ``forget_ms``; each stretch is folded once from a waiting and once
    from a running task, and the stretches of a task, a row each, are chained: one that meets a finished task begins anew."""
    w = Window.partitionBy("task_id").orderBy("ts", "seq")
    quiet = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > forget_ms * 1000
    cut = events.withColumn("life", F.sum(F.when(quiet, 1).otherwise(0)).over(w)).withColumn("task_id", F.struct("task_id", "life"))
    running = cut.groupBy("task_id").agg(F.min("ts").alias("ts")).select("task_id", F.lit(None).cast("long").alias("seq"), "ts", F.lit("running").alias("status"))
    before = running.withColumn("seq", F.lit(-(1 << 63)))  # a start before all else
    waiting, going = folded(cut.select("task_id", "seq", "ts", "status")), folded(cut.select("task_id", "seq", "ts", "status").unionByName(before))
    both = waiting.join(going.withColumnRenamed("status", "going"), "task_id").select("task_id.*", "status", "going")
    stretches = both.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("life", "status", "going"))).alias("s"))
    return stretches.select("task_id", F.aggregate("s", F.lit("pending"), lambda at, x: F.when(at == "running", x["going"]).otherwise(x["status"])).alias("status"))


def shown(states: DataFrame, which: str) -> DataFrame:
    return states.filter(F.col("status").isin(*FILTERS[which]))


def badge(states: DataFrame) -> DataFrame:
    """One row: running tasks, failed tasks, and whether all are done (none is not done)."""
    running, failed = F.count_if(F.col("status").isin("running", "pending")), F.count_if(F.col("status") == "failed")
    done = (F.count(F.lit(1)) > 0) & (F.count_if(F.col("status") != "completed") == 0)
    return states.agg(running.alias("running"), F.when(running == 0, failed).otherwise(0).cast("long").alias("failed"), done.alias("all_done"))


def any_finished(states: DataFrame) -> DataFrame:
    return states.agg(F.coalesce(F.bool_or(F.col("status").isin(*FINISHED)), F.lit(False)).alias("any_finished"))


def remove(states: DataFrame, task_id) -> DataFrame:
    """Without one task, unless it runs."""
    return states.filter((F.col("task_id") != task_id) | (F.col("status") == "running"))


def clear_finished(states: DataFrame) -> DataFrame:
    return states.filter(F.col("status").isin("running", "pending"))


def newly_completed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(task_id, output_id): outputs of tasks that are completed now and were not."""
    done = lambda df: df.filter(F.col("status") == "completed")
    return done(after).join(done(before), "task_id", "left_anti").select("task_id", F.explode("outputs").alias("output_id"))


def debounced(changes: DataFrame, quiet: str = "2 seconds") -> DataFrame:
    """One row for each run of a key's changes that are never more than ``quiet`` apart: changes exactly that far apart are one
    run. Works on streams with a watermark too."""
    return changes.groupBy("key", F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("changes")).select("key", F.col("w.start").alias("started"), F.col("w.end").alias("settled"), "changes")


def debounced_batch(changes: DataFrame, quiet_ms: int = 2000, span_ms: int = 7 * 86_400_000) -> DataFrame:
    """The same per key for tables: key, started, last, changes; changes exactly ``quiet_ms`` apart are one run, and those
    without a time are none. Keys may be null.

    A key's changes are cut into spans of time, so one hot key is many tasks' work, however dense or sparse its changes
    are. Inside a span, runs are found; those between its first and its last run are whole. The two at its ends are all that a
    span passes on: the spans of a key are chained by them, a row or two a span. Both kinds of run travel in one shuffle, the whole
    ones by key and span, the open ones by key alone."""
    span = F.floor(F.unix_millis("ts") / span_ms)
    inside = Window.partitionBy("key", "span").orderBy("ts")
    rows = changes.filter("ts is not null").select("key", "ts", span.alias("span"))
    gap = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(inside))
    rows = rows.withColumn("run", F.sum(F.when(gap > quiet_ms, 1).otherwise(0)).over(inside))
    runs = rows.groupBy("key", "span", "run").agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("changes"))
    ends = F.max("run").over(Window.partitionBy("key", "span"))
    runs = runs.withColumn("whole", F.when((F.col("run") > 0) & (F.col("run") < ends), F.struct("span", "run")))
    chain = Window.partitionBy("key", "whole").orderBy("started")
    gap = F.unix_millis("started") - F.unix_millis(F.lag("last").over(chain))
    runs = runs.select("key", "whole", "started", "last", "changes").withColumn("link", F.sum(F.when(gap <= quiet_ms, 0).otherwise(1)).over(chain))
    return runs.groupBy("key", "whole", "link").agg(F.min("started").alias("started"), F.max("last").alias("last"), F.sum("changes").alias("changes")).select("key", "started", "last", "changes")


def newest_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The results (key, seq, ...) of each key's newest request (key, seq); what was overtaken meanwhile is dropped."""
    return results.join(requests.groupBy("key").agg(F.max("seq").alias("seq")), ["key", "seq"], "left_semi")


def with_times(states: DataFrame) -> DataFrame:
    return states.withColumns({"elapsed_ms": elapsed_ms(F.col("started"), F.col("ended")), "percent": progress_percent(F.col("progress"))})


def batch_outcome(items: DataFrame) -> DataFrame:
    """One row for a batch of items with a status (saved, skipped, failed): counts, and failed if nothing was saved."""
    n = lambda s: F.count_if(F.col("status") == s)
    return items.agg(F.count(F.lit(1)).alias("done"), n("saved").alias("saved"), n("skipped").alias("skipped"), F.when(n("saved") > 0, "completed").otherwise("failed").alias("outcome"))


def processed(items: DataFrame, work, kind: str) -> DataFrame:
    """Each item (id, data) through ``work(data) -> bytes | None``, a batch at a time: (id, status, result). Missing data are
    skipped, errors are a failed item and do not stop the rest."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for id_, data in zip(batch["id"], batch["data"], strict=True):
                try:
                    out = None if data is None else work(bytes(data))
                    rows.append((id_, "skipped" if out is None else "saved", out))
                except Exception as e:  # one item's error is its result
                    rows.append((id_, "failed", repr(e).encode()))
            yield pd.DataFrame(rows, columns=["id", "status", "result"])

    return items.select("id", "data").mapInPandas(run, f"id {kind}, status string, result binary")


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TASK_STATES)), status)
