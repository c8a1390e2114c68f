import datetime

from pyspark.sql import functions as F

from staygrid import schemas
from staygrid.session import work_path
from staygrid.streaming import events as stream
from staygrid.streaming.pages import page_events

T0 = datetime.datetime(2026, 1, 1)


def _write(spark, path, rows, n):
    rows = [(i, T0 + datetime.timedelta(minutes=m), u, e, 1.0, p) for i, m, u, e, p in rows]
    spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.mode("append").option("compression", "none").parquet(f"{path}/part{n}")


def _source(spark, path):
    return spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def _drain(q):
    q.awaitTermination()
    assert q.exception() is None


def test_late_and_repeated_rows(spark):
    path, out, cp = (work_path(spark, x) for x in ("in", "out", "cp"))
    _write(spark, path, [(1, 0, 1, "a", ""), (2, 30, 1, "a", "")], 0)
    q = lambda: stream.append_rows(
        stream.first_seen(_source(spark, path).withColumn("at", F.col("ts").cast("timestamp")), ["user_id"], "at").select("event_id"), out, cp)
    _drain(q())
    _write(spark, path, [(3, 60, 1, "a", ""), (4, 3 * 24 * 60, 2, "a", "")], 1)
    _drain(q())
    _write(spark, path, [(5, 10, 3, "a", ""), (6, 3 * 24 * 60 + 1, 1, "a", "")], 2)  # 5 is too late, 1 has been forgotten
    _drain(q())
    ids = {r.event_id for r in spark.read.parquet(out).collect()}
    assert len(ids & {1, 2}) == 1 and ids - {1, 2} == {4, 6}


def test_replayed_batch_changes_nothing(spark):
    path, out = work_path(spark, "in"), work_path(spark, "out")
    _write(spark, path, [(i, i, 1, "a", "") for i in range(10)], 0)
    count = lambda b: b.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(2):  # a lost checkpoint replays the same batch id
        _drain(stream.per_batch(_source(spark, path), out, work_path(spark, "cp"), count))
    assert [r.n for r in spark.read.parquet(out).collect()] == [10]


def test_rates_over_several_batches(spark):
    path, out, cp = (work_path(spark, x) for x in ("in", "out", "cp"))
    for n, minutes in enumerate([[0, 0, 1], [1, 2, 2]]):
        _write(spark, path, [(n * 10 + i, m, 1, "browser", "") for i, m in enumerate(minutes)], n)
    rates = stream.request_rates(_source(spark, path).select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("mode")), "mode", "at")
    _drain(stream.per_batch(rates, out, cp, lambda b: b, mode="update"))
    final = stream.over_limit(stream.latest_per_window(spark, out, ["minute", "mode"]), F.lit(1)).orderBy("minute").collect()
    assert [(r.requests, r.over) for r in final] == [(2, True), (2, True), (2, True)]


def test_page_state_across_batches(spark):
    path, out, cp = (work_path(spark, x) for x in ("in", "out", "cp"))
    q = lambda: stream.append_rows(page_events(
        _source(spark, path).withColumn("code", F.lit(200)), ["user_id"], "ts", "props", "code", "event_id", forget_after="2 days"), out, cp)
    _write(spark, path, [(1, 0, 1, "a", "x y"), (2, 1, 1, "a", "yx"), (3, 2, 2, "a", "q")], 0)
    _drain(q())
    _write(spark, path, [(4, 60, 1, "a", "z"), (5, 4 * 24 * 60, 3, "a", "n")], 1)
    _drain(q())
    _write(spark, path, [(6, 4 * 24 * 60 + 5, 3, "a", "n")], 2)
    _drain(q())
    rows = spark.read.parquet(out).collect()
    by_id = {r.event_id: r.status for r in rows if r.event_id is not None}
    assert by_id == {1: "new", 2: "same", 3: "new", 4: "changed", 5: "new", 6: "same"}
    assert {r.user_id for r in rows if r.event_id is None and r.status == "removed"} == {1, 2}
