"""Streaming forms against their batch forms."""

from pyspark.sql import functions as F

from sparkloom.operators import control as K
from sparkloom.streaming import streams as S


def test_rate_limit_stream(spark, tmp_path):
    rows = [(k, i, i * 700, 1.0) for k in (1, 2) for i in range(12)]
    d = spark.createDataFrame(rows, "key long, event_id long, ts_ms long, cost double")
    for part, keep in (("a", "event_id < 6"), ("b", "event_id >= 6")):  # the bucket's state outlives a run
        d.filter(keep).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in/*")
        out = S.rate_limit_stream(stream, 3, 1 / 200_000).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        out.option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, K.token_bucket(d, 3, 1 / 200_000).collect()))


def test_rate_limits_go_by_the_events_clock(spark, tmp_path):
    # the second batch comes long after the first by its own clock for one key, at once for the other
    rows = [(1, i, i, 1.0) for i in range(5)] + [(1, 5, 10, 1.0)] + [(2, i, i, 1.0) for i in range(10, 15)] + [(2, 15, 3_000_000, 1.0)]
    d = spark.createDataFrame(rows, "key long, event_id long, ts_ms long, cost double")
    for part, keep in (("a", "event_id not in (5, 15)"), ("b", "event_id in (5, 15)")):
        d.filter(keep).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in/*")
        out = S.rate_limit_stream(stream, 3, 1 / 1000).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        out.option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, K.token_bucket(d, 3, 1 / 1000).collect()))
    assert {r[1]: r[2] for r in got}[5] is False and {r[1]: r[2] for r in got}[15] is True


def test_windowed_counts(spark, tmp_path):
    d = spark.range(100).select(F.timestamp_seconds(36000 + F.col("id") * 120).alias("ts"), F.lit("view").alias("event_type"), F.col("id").alias("event_id"))
    d.unionByName(d).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = S.windowed_counts(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    counts = [r["n"] for r in spark.table("windows").orderBy("start").collect()]
    assert counts[:2] == [30, 30]


def test_incremental_index(spark, tmp_path):
    d = spark.createDataFrame([("a", "1"), ("b", "1")], "source_file string, file_hash string")
    d.coalesce(1).write.parquet(f"{tmp_path}/in/x")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in/*")
    S.incremental_index(stream, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    spark.createDataFrame([("b", "2")], d.schema).coalesce(1).write.parquet(f"{tmp_path}/in/y")
    S.incremental_index(stream, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    table = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(map(tuple, S.latest(table).collect())) == [("a", "1"), ("b", "2")]


def test_negative_costs_give_back_up_to_the_capacity(spark, tmp_path):
    d = spark.createDataFrame([(1, i, i, c) for i, c in enumerate([2.0, -9.0, 3.0, 1.0, -1.0, 1.0])], "key long, event_id long, ts_ms long, cost double")
    d.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in/*")
    out = S.rate_limit_stream(stream, 3, 1e-9).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    out.option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, K.token_bucket(d, 3, 1e-9).collect()))


def test_reservations_on_state_equal_the_batch(spark, tmp_path):
    from sparkloom.plans.control_queries import reservation_events

    d = reservation_events(spark, "/root/testdata/sf0.001")
    n, before = d.count(), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(3):  # each run goes on from the state that the last one left
            d.filter(F.col("event_id").between(part * n // 3 + (part > 0), (part + 1) * n // 3)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
            stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in/*")
            out = S.reservation_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
            out.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = lambda x: sorted((r[0], r[1], r[2], None if r[3] is None else round(r[3], 6)) for r in x.collect())
    got, want = rows(spark.read.parquet(f"{tmp_path}/out")), rows(K.token_reservations(d))
    assert got == want and {r[2] for r in got} >= {"ok", "refunded", "unknown_reservation"}
