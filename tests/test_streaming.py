from postlake.streaming.arrivals import arrival_counts

SCHEMA = "arrived timestamp, folder_key string, message_class string, visibility string"


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime

    rows = [(datetime(2024, 1, 1, 0, m), f"f{m % 2}", ("IPM.Note", None, "IPM.Task")[m % 3], ("visible", "deleted")[m % 4 == 3]) for m in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, arrival_counts(df).collect()))
    q = arrival_counts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("arrivals").collect())) == want and len(want) == 6
