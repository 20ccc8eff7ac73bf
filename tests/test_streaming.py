from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from halyard.operators import catalog_index as C
from halyard.operators import tasks as T
from halyard.queries import drained, in_batches
from halyard.schema import ASSETS
from halyard.sources.catalog import VersionedTable
from halyard.streaming.tasks import change_bursts, new_outputs, newest_results, sync_on_bursts, task_states, use_rocksdb
from tests.test_catalog import assets, ids

BASE = dt.datetime(2024, 1, 1)


def at(seconds: int) -> dt.datetime:
    return BASE + dt.timedelta(seconds=seconds)


def two_batches(spark, path, first, second, kind):
    """A stream of two files, one a micro-batch."""
    for rows in (first, second):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_state_is_kept_from_batch_to_batch(spark, tmp_path):
    """A task of both batches has one row, its state after both."""
    use_rocksdb(spark)
    first = [(1, 1, at(1), "pending"), (1, 2, at(2), "running"), (2, 3, at(3), "pending"), (3, 4, at(4), "running"), (3, 5, at(5), "failed")]
    second = [(1, 6, at(6), "completed"), (2, 7, at(7), "completed"), (3, 8, at(8), "completed"), (4, 9, at(9), "cancelled")]
    out = drained(spark, task_states(two_batches(spark, tmp_path, first, second, T.EVENT)), "two-batches", "update", ["task_id"])
    assert sorted(map(tuple, out.select("task_id", "status").collect())) == [(1, "completed"), (2, "pending"), (3, "failed"), (4, "cancelled")]
    whole = T.folded(spark.createDataFrame(first + second, T.EVENT))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out.select("task_id", "status").collect()))


def batches(spark, path, *parts, kind=T.EVENT):
    """A stream of files, one a micro-batch."""
    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_shuffled_batches_fold_in_order(spark, tmp_path):
    """Events of forty tasks, each up to 20 seconds late: the rows are those of the fold over the whole table."""
    import random

    use_rocksdb(spark)
    r = random.Random(5)
    names = ["pending", "running", "running", "completed", "failed", "cancelled"]
    events = [(r.randrange(40), k, at(k), r.choice(names[: 6 if k % 7 == 0 else 4])) for k in range(600)]
    told = sorted(events, key=lambda e: e[1] + r.random() * 20)
    out = drained(spark, task_states(batches(spark, tmp_path, *(told[k : k + 150] for k in range(0, 600, 150))), "30 seconds"), "shuffled", "update", ["task_id"])
    whole = spark.createDataFrame(events, T.EVENT)
    want = sorted(map(tuple, T.folded(whole).collect()))
    assert sorted(map(tuple, out.select("task_id", "status").collect())) == want
    assert want == sorted((k, T.fold(None, [e[3] for e in events if e[0] == k])) for k in {e[0] for e in events})


def test_finished_tasks_are_forgotten(spark, tmp_path):
    """State rows fall once finished tasks were quiet for a minute; running ones stay; a forgotten task begins anew."""
    use_rocksdb(spark)
    first = [(k, k, at(k % 10), "running" if k % 4 == 0 else "cancelled") for k in range(100)]
    later = [[(1000, 200 + k, at(300 * (k + 1)), "running")] for k in range(3)]
    last = [(1, 900, at(3000), "running"), (4, 901, at(3000), "completed")]
    stream = task_states(batches(spark, tmp_path, first, *later, last), "10 seconds", 60_000)
    where = f"{tmp_path}/x"
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{where}/c").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{where}/out/batch={n}")).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: __import__("json").loads(p.json), query.recentProgress) if p["stateOperators"]]
    assert max(held) >= 100 and held[-1] <= 60
    rows = spark.read.parquet(f"{where}/out")
    final = {x.task_id: x.status for x in rows.groupBy("task_id").agg(F.max_by("status", "batch").alias("status")).collect()}
    assert final[1] == "running" and final[2] == "cancelled" and final[4] == "completed" and final[8] == "running"
    everything = spark.createDataFrame(first + sum(later, []) + last, T.EVENT)
    assert {r.task_id: r.status for r in T.folded_lives(everything, 60_000).collect()} == final


def test_lives_match_the_fold(spark):
    import random

    r = random.Random(8)
    events, us = [], {}
    for k in range(1500):
        task = r.randrange(60)
        us[task] = us.get(task, 0) + r.choice([1, 30, 60, 61, 200]) * 1_000_000
        events.append((task, k, us[task], r.choice(["pending", "running", "completed", "failed", "cancelled"])))
    want = {t: T.fold_timed((None, None), [e[1:] for e in ((x[0], x[2], x[1], x[3]) for x in events) if e[0] == t], 60_000)[0] for t in us}
    rows = spark.createDataFrame([(t, s, BASE + dt.timedelta(microseconds=u), e) for t, s, u, e in events], T.EVENT)
    assert {x.task_id: x.status for x in T.folded_lives(rows, 60_000).collect()} == want
    assert T.folded_lives(rows.limit(0), 60_000).count() == 0


def test_changes_as_far_apart_as_the_quiet_are_one_burst(spark, tmp_path):
    """Three changes two seconds apart: one burst in the table and in the stream, as their docstrings say."""
    rows = [("k", at(0)), ("k", at(2)), ("k", at(4)), ("k", BASE + dt.timedelta(seconds=6, milliseconds=1)), ("z", at(100)), (None, at(1)), (None, None)]
    table = spark.createDataFrame(rows, "key string, ts timestamp")
    assert sorted((x.key, x.changes) for x in T.debounced_batch(table, 2000).filter("key is not null").collect()) == [("k", 1), ("k", 3), ("z", 1)]
    assert T.debounced_batch(table, 2000).filter("key is null").count() == 1 and T.debounced_batch(table.limit(0)).count() == 0
    stream = change_bursts(batches(spark, tmp_path, rows, kind="key string, ts timestamp"))
    out = drained(spark, stream, "ties", "append").filter("key = 'k'")
    assert sorted(x.changes for x in out.collect()) == [1, 3]


def test_a_hot_key_of_sparse_changes_is_many_tasks_work(spark):
    """A key of two million changes 3 s apart, each its own burst, with one pair a thousand: no task sees more than its spans."""
    n = 2_000_000
    ms = F.col("id") * 3000 + F.when(F.col("id") % 1000 == 1, -1500).otherwise(0)
    rows = spark.range(n).select(F.lit("hot").alias("key"), F.timestamp_millis(ms).alias("ts"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = T.debounced_batch(rows, 2000, 86_400_000)
        got = out.groupBy("changes").count().orderBy("changes").collect()
        spread = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pairs = n // 1000
    assert [tuple(r) for r in got] == [(1, n - 2 * pairs), (2, pairs)]
    assert spread < n / 4


def test_outputs_are_told_once(spark, tmp_path):
    """A task that completes tells its outputs, once; one that is completed again tells what is new; others tell nothing."""
    use_rocksdb(spark)
    kind = T.EVENT + ", outputs array<long>"
    parts = [
        [(1, 1, at(1), "running", None), (1, 2, at(2), "completed", [10, 11]), (2, 3, at(3), "completed", [20]), (2, 4, at(4), "running", [21]), (3, 5, at(5), "completed", None)],
        [(1, 6, at(6), "completed", [11, 12]), (2, 7, at(7), "failed", [20])],
        [(2, 8, at(8), "completed", [20, 22]), (1, 0, at(0), "running", [13])],
    ]
    out = drained(spark, new_outputs(batches(spark, tmp_path, *parts, kind=kind)), "told", "append")
    # task 2 had ended each earlier batch in another state; an older event of task 1 does not change its state
    assert sorted(map(tuple, out.select("task_id", "output_id").collect())) == [(1, 10), (1, 11), (1, 12), (1, 13), (2, 20), (2, 22)]


def test_overtaken_results_are_dropped(spark, tmp_path):
    """Requests and results of three batches, out of order within the delay: the results of a key's newest request at their time."""
    use_rocksdb(spark)
    kind = "key long, seq long, ts timestamp, result boolean"
    parts = [
        [(1, 1, at(10), False), (2, 2, at(10), False), (1, 1, at(20), True)],
        [(1, 3, at(19), False), (2, 2, at(30), True), (2, 4, at(31), False), (3, 5, at(25), True)],  # request 3 came late, yet before result 1
        [(1, 3, at(40), True), (2, 2, at(41), True), (2, 4, at(45), True), (9, 9, at(400), False)],
    ]
    stream = batches(spark, tmp_path, *parts, kind=kind)
    out = drained(spark, newest_results(stream.filter("not result"), stream.filter("result"), "30 seconds"), "newest", "append")
    assert sorted(map(tuple, out.select("key", "seq").collect())) == [(1, 3), (2, 2), (2, 4), (3, 5)]


def test_bursts_sync_once_a_batch(spark, tmp_path):
    """Bursts of a micro-batch are one sync; a batch without a settled burst is none."""
    table = VersionedTable(spark, f"file://{tmp_path}/t", ASSETS)
    table.write(assets(spark, {"id": "a", "size_bytes": 7}, {"id": "gone"}))
    calls = []

    def source():
        calls.append(len(table.versions()))
        return spark.createDataFrame([("a", 1), ("new", 1)], "id string, type int")

    kind = "key string, ts timestamp"
    stream = change_bursts(two_batches(spark, tmp_path, [("k", at(1)), ("k", at(2)), ("k", at(30))], [("k", at(300)), ("k", at(900))], kind))
    sync_on_bursts(stream, table, source, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert calls and table.versions() == list(range(1, 2 + len(calls)))
    assert {r.id: r.size_bytes for r in table.read().collect()} == {"a": 7, "new": None}


def test_clear(spark):
    assert ids(C.clear(assets(spark, {"id": "a"}))) == [] and C.as_assets(spark.createDataFrame([("a", "3")], "id string, type string")).select("type", F.col("width")).first() == (3, 0)


def test_a_batch_is_many_tasks_work(spark, tmp_path):
    """Batches as even as ntile makes them, in order, each of as many files as a shuffle has partitions: none holds a batch."""
    rows = spark.range(10_001).select(F.col("id").alias("seq"), ((F.col("id") * 7919) % 10_001).alias("at"))
    seen = []
    keep = lambda batch, n: seen.append((batch.agg(F.min("at"), F.max("at"), F.count("at")).first(), batch.withColumn("f", F.input_file_name()).groupBy("f").count().agg(F.count("f"), F.max("count")).first()))
    in_batches(spark, rows, "at", 3).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    assert [tuple(r) for r, _ in seen] == [(0, 3333, 3334), (3334, 6667, 3334), (6668, 10_000, 3333)]
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(n == files and most <= 3334 // files + 1 for _, (n, most) in seen)
    assert [r.at for r in spark.createDataFrame([(1, 5)], "seq long, at long").transform(lambda d: numbered_batches(spark, d, tmp_path)).collect()] == [5]


def numbered_batches(spark, rows, path):
    """The rows of a stream of three batches of which two are empty."""
    stream = in_batches(spark, rows, "at", 3)
    return drained(spark, stream, "few", "append")


def test_waiting_events_are_one_value():
    """A key's waiting events go to the state store as one value, and come back in order of time, number and kind."""
    import pandas as pd

    from halyard.streaming.tasks import Waiting

    class Value:
        held, calls = None, 0

        def get(self):
            return self.held

        def update(self, value):
            self.held, self.calls = value, self.calls + 1

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    waiting = Waiting(Handle())
    batch = pd.DataFrame({"ts": [at(3), at(1), at(3), at(1)], "seq": [2, 9, 2, 7], "what": [1, 0, 0, -1]})
    waiting.add(waiting.get(), iter([batch.iloc[:1], batch.iloc[1:]]), lambda b: b["what"])
    us = [int((at(k) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for k in (1, 3)]
    assert waiting.get().tolist() == [(us[0], 7, -1), (us[0], 9, 0), (us[1], 2, 0), (us[1], 2, 1)] and waiting.state.calls == 1
