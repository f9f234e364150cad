from pyspark.sql import functions as F

from chunkwright.streaming import transfers


def run(spark, stream, mode, name):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts")).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def test_states(spark, tmp_path):
    rows = [(1, 1, 10, "IN_PROGRESS", 5), (1, 2, 20, "COMPLETED", 5), (1, 3, 30, "IN_PROGRESS", 9), (2, 4, 10, "FAILED", 1), (2, 5, 11, "COMPLETED", 1)]
    stream = source(spark, tmp_path, rows, "transfer_id long, event_id long, ts long, state string, bytes long")
    got = {r.transfer_id: (r.state, r.bytes, r.n_applied) for r in run(spark, transfers.states(stream), "update", "states")}
    assert got == {1: ("COMPLETED", 10, 2), 2: ("FAILED", 1, 1)}


def test_acknowledged_once(spark, tmp_path):
    rows = [(1, 0, 10, True), (1, 0, 11, True), (1, 64, 12, True)]
    stream = source(spark, tmp_path, rows, "transfer_id long, offset long, ts long, ok boolean")
    assert len(run(spark, transfers.acknowledged_once(stream), "append", "acks")) == 2


def test_windowed_counters(spark, tmp_path):
    rows = [(1, 10, "A", 5), (2, 20, "A", 5), (3, 90_000, "A", 7)]
    stream = source(spark, tmp_path, rows, "event_id long, ts long, state string, bytes long")
    got = run(spark, transfers.windowed_counters(stream), "update", "windows")
    assert sorted((r.n_messages, r.n_bytes) for r in got) == [(1, 7), (2, 10)]
