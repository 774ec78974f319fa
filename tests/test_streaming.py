from pyspark.sql import functions as F

from tally.operators import state
from tally.streaming import streams


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def events(spark, tmp_path, files=3):
    rows = spark.range(120).select((F.col("id") % 4).alias("user"), F.when(F.col("id") % 10 < 6, "a").otherwise("b").alias("phase"), (F.col("id") * 0.7).alias("s"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return rows, stream


def test_throttle_equals_batch(spark, tmp_path):
    rows, _ = events(spark, tmp_path)
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/one")
    kept = run(streams.throttled(stream, "user", "phase", "s", "event_id", 5.0), "append", "throttled")
    want = {r["user"]: r["kept"] for r in state.throttle(rows, ["user"], ["s", "event_id"], "phase", "s", 5.0).collect()}
    assert {r["user"]: r["n"] for r in kept.groupBy("user").agg(F.count("*").alias("n")).collect()} == want


def test_replay_ring(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    ring = run(streams.replay_ring(stream, "user", "event_id", "phase", 10), "update", "ring")
    last = ring.groupBy("user").agg(F.max("last").alias("last"), F.max("held").alias("held")).collect()
    assert {(r["user"], r["last"], r["held"]) for r in last} == {(k, 116 + k, 10) for k in range(4)}
    held = spark.createDataFrame([(k, "x") for k in range(5, 10)], "seq bigint, data string")
    rest, lost = streams.resume(held, "seq", 3)
    assert rest.count() == 5 and lost.first()["incomplete"]
    assert not streams.resume(held, "seq", 6)[1].first()["incomplete"]


def test_refresh_sink(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    total = lambda keys: rows.join(keys, "user", "left_semi").groupBy("user").agg(F.count("*").alias("n"))
    q = stream.writeStream.foreachBatch(streams.refresh_sink(f"{tmp_path}/out", ["user"], total)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    newest = sorted(p.name for p in (tmp_path / "out").iterdir())[-1]
    assert sorted(spark.read.parquet(f"{tmp_path}/out/{newest}").collect()) == sorted(rows.groupBy("user").agg(F.count("*").alias("n")).collect())


def test_windows_and_sessions(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    out = run(streams.windowed_counts(stream, "user", "ts", "1 hour", "10 hours"), "complete", "windows")
    assert sorted((r["user"], r["n"]) for r in out.collect()) == sorted((k, 15) for k in range(4) for _ in range(2))
    out = run(streams.sessions(stream, "user", "ts", "2 minutes", "10 hours"), "complete", "sessions")
    assert sorted(out.collect()) == sorted(state.session_runs(rows, ["user"], "ts", "2 minutes").collect())


def test_drained_streams_stay_off_the_driver(spark, tmp_path):
    """What a stream gives is read from files, over all micro-batches or from the last complete one; no table is kept by the driver."""
    from tally.plans.queries import _drained

    rows, stream = events(spark, tmp_path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    kept = _drained(streams.throttled(stream, "user", "phase", "s", "event_id", 0.0), "append")
    out = _drained(streams.sessions(stream, "user", "ts", "2 minutes", "10 hours"), "complete")
    assert kept.count() == 120 and sorted(out.collect()) == sorted(state.session_runs(rows, ["user"], "ts", "2 minutes").collect())
    for df in (kept, out):
        assert df.inputFiles() and "LogicalRelation" in df._jdf.queryExecution().analyzed().getClass().getName()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
