import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import structure as S
from tidebar.operators import labels as L
from tidebar.streaming import bars as Z
from tidebar.streaming import machines as M


def run(stream, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streamed_bars_equal_table_bars(spark, tmp_path):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tick_id"))
    ticks.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    run(Z.resample(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1h", late="1 hour"), "streamed")
    late = spark.table("streamed")
    assert set(late.columns) == {"series_id", "ts", "open", "high", "low", "close", "volume", "trade_count", "taker_buy"}
    want = {(r.series_id, r.ts): r.close for r in B.resample(ticks, "1h").collect()}
    got = {(r.series_id, r.ts): r.close for r in late.collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())


def test_streamed_swings_equal_table_swings(spark, tmp_path):
    b = B.bars_of_events(spark, "/root/testdata/sf0.001", "1h").select("series_id", "ts", "high", "low", "close", "bar_idx")
    b.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/bars")
    stream = spark.readStream.schema(b.schema).parquet(f"{tmp_path}/bars").withColumn("ts", F.col("ts").cast("timestamp"))
    run(Z.swings(stream), "swung")
    want = {(r.series_id, r.ts): (r.trend, r.bos, r.choch, r.last_high) for r in S.swings(b).collect()}
    got = {(r.series_id, r.ts): (r.trend, r.bos, r.choch, r.last_high) for r in spark.table("swung").collect()}
    assert got == want


def shuffled_bars(spark, tmp_path):
    """Hourly bars with their ATR in files by day; each file is out of order, and from the second day on each has a bar of the first day again, too late."""
    b = S.with_atr(B.bars_of_events(spark, "/root/testdata/sf0.001", "1h")).select("series_id", "ts", "bar_idx", "high", "low", "close", "open", "atr")
    first = b.filter("bar_idx = 3")
    days = [r.day for r in b.select(F.to_date("ts").alias("day")).distinct().orderBy("day").collect()][:8]
    for k, day in enumerate(days):
        own = b.filter(F.to_date("ts") == F.lit(day))
        if k > 1:
            own = own.unionByName(first.withColumn("high", F.col("high") * 100))
        own.orderBy(F.xxhash64("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
    return b, spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/bars"), days


def by_bar(rows, *columns):
    return {(r.series_id, r.ts): tuple(r[c] for c in columns) for r in rows}


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    M.use_rocksdb(spark)
    yield spark
    spark.conf.set(name, before)


@pytest.mark.parametrize("side", ["bull", "bear"])
def test_streamed_gaps_equal_table_gaps(rocksdb, tmp_path, side):
    b, stream, days = shuffled_bars(rocksdb, tmp_path)
    q = run(M.gaps(stream, side, cap=6, least_atr=0.1, late="25 hours"), f"gaps_{side}")
    got = by_bar(rocksdb.table(f"gaps_{side}").collect(), "count", "age", "near_top", "near_bot", "in_zone")
    name = f"fvg_{side}"
    want = by_bar(S.gaps(b, side, cap=6, least_atr=0.1).collect(), f"{name}_count", f"{name}_age", f"{name}_near_top", f"{name}_near_bot", f"{name}_in_zone")
    assert len(got) > 50 and any(v[0] for v in got.values()) and all(want[k] == v for k, v in got.items())
    # every bar that the watermark has passed is there, once
    passed = {k for k in want if k[1].date() < days[-2]}
    assert passed <= set(got)
    rows = sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])
    assert rows < 1500


def test_streamed_labels_equal_table_labels(rocksdb, tmp_path):
    b, stream, days = shuffled_bars(rocksdb, tmp_path)
    run(M.barrier_labels(stream, "short", 1.0, 5, late="25 hours"), "labelled")
    got = by_bar(rocksdb.table("labelled").collect(), "label")
    name = L.name_of("short", 1, 5)
    want = {k: v for k, v in by_bar(L.triple_barrier(b, (5,), (1,)).collect(), name).items() if v[0] is not None}
    assert len(got) > 20 and {v[0] for v in got.values()} == {0, 1} and all(want[k] == v for k, v in got.items())
    assert len(rocksdb.table("labelled").collect()) == len(got)


def test_a_series_that_ends_is_forgotten(rocksdb, tmp_path):
    """Its state goes when the watermark has passed its idle time."""
    rows = [("old", f"2024-01-01 {h:02d}:00:00", 2.0 + h, 1.0 + h, 1.5 + h, 0.1) for h in range(5)]
    later = [("new", f"2024-01-0{d} 00:00:00", 2.0, 1.0, 1.5, 0.1) for d in range(2, 8)]
    schema = "series_id string, ts string, high double, low double, close double, atr double"
    for part in (rows, later[:3], later[3:]):
        rocksdb.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = rocksdb.readStream.schema("series_id string, ts timestamp, high double, low double, close double, atr double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = run(M.gaps(stream, "bull", idle_ms=86_400_000, late="1 hour"), "ended")
    got = rocksdb.table("ended").collect()
    assert sum(r.series_id == "old" for r in got) == 5
    left = sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])
    assert left < 20
