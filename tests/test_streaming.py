"""The same windows over a stream as over a batch."""

import datetime as dt

from arcweave.streaming.events import stream, tumbling


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), "view" if i % 2 else "click", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    out = tumbling(stream(spark, str(tmp_path / "in"), df.schema), "10 minutes")
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, tumbling(df, "10 minutes").collect()))
    assert sorted(map(tuple, spark.table("w").collect())) == want and len(want) == 10
