"""The streaming coder gives the same totals whatever the batches; sinks return what was written."""

from pyspark.sql import functions as F

from pixelmill.operators.folds import Rate
from pixelmill.plans import lengths
from pixelmill.sources import rasters, sinks
from pixelmill.streaming import adaptive

SF = "/root/testdata/sf0.001"


def test_adaptive_stream(spark, tmp_path):
    events = rasters.table(spark, SF, "events").select("event_id", "event_type", "value", "ts")
    for k in range(3):  # three files, in id order: three micro-batches
        events.filter((F.col("event_id") >= 400 * k) & (F.col("event_id") < 400 * (k + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = adaptive.adaptive_bits(stream).writeStream.outputMode("update").format("memory").queryName("adaptive").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    got = {}
    for r in spark.table("adaptive").collect():
        got[r.event_type] = max(got.get(r.event_type, (0, 0)), (r.n, r.bits))
    want = {}
    for r in events.orderBy("event_id").collect():
        rate, n, bits = want.get(r.event_type, (Rate(), 0, 0))
        m = int(r.value // 1)
        want[r.event_type] = (rate, n + 1, bits + rate.price(m, m))
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (_, n, _) in want.items()}
    assert got == {k: (n, b) for k, (_, n, b) in want.items()}


def test_windowed_stream(spark, tmp_path):
    events = rasters.table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events*.parquet")
    run = adaptive.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_sinks(spark, tmp_path):
    df = lengths.bpp_med_order0(spark, SF)
    sinks.write_report(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == df.count()
    thresholds = spark.createDataFrame([(0, 1.5)], "ctx int, t double")
    sinks.write_model(df, thresholds, f"{tmp_path}/model")
    assert sinks.read_model(spark, thresholds, f"{tmp_path}/model").count() == df.count()
    assert sinks.read_model(spark, thresholds.withColumn("t", F.col("t") + 1), f"{tmp_path}/model") is None
    coded = spark.createDataFrame([(1, 0, bytearray(b"ab"))], "img long, ch int, payload binary")
    sinks.write_streams(coded, f"{tmp_path}/bin")
    assert bytes(sinks.read_streams(spark, f"{tmp_path}/bin").first().payload) == b"ab"
