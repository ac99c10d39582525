from pyspark.sql import functions as F

from tilespark.streaming.dirty import stale_tiles

SF = "/root/testdata/sf0.001"


def changes(reader):
    return reader.select(F.col("event_id").alias("id"), (F.lit(-33.5) + F.col("user_id") % 50 * 0.001).alias("lat"), (F.lit(-70.7) + F.col("event_id") % 50 * 0.001).alias("lon"), F.col("ts").cast("timestamp").alias("changed_at"))


def test_stream_agrees_with_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    expected = stale_tiles(changes(events), (12, 14)).agg(F.sum("changes"), F.count("*")).first()
    stream = stale_tiles(changes(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), (12, 14))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("stale").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM stale").agg(F.sum("changes"), F.count("*")).first() == expected
