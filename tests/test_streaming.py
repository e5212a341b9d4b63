"""Streams give what their batch forms give."""

from pyspark.sql import functions as F

from quarry.streaming.streams import answered, current_files, ingest_stream, token_windows


def test_ingest_is_incremental(spark, tmp_path):
    folder, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "point")
    folder.mkdir()
    (folder / "a.c").write_text("one")
    ingest_stream(spark, str(folder), out, point).awaitTermination()
    assert current_files(spark, out).count() == 1
    (folder / "b.c").write_text("two")
    ingest_stream(spark, str(folder), out, point).awaitTermination()
    assert current_files(spark, out).count() == 2
    assert spark.read.parquet(out).count() == 2


def test_token_windows_as_stream(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("model"), F.col("id").alias("tokens"))
    rows.write.parquet(str(tmp_path / "calls"))
    table = spark.read.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "calls"))
    q = token_windows(stream, "ts", "model", "tokens").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, token_windows(table, "ts", "model", "tokens").collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == want


def test_answers_within_the_timeout(spark):
    asked = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "id int, s int").select("id", F.timestamp_seconds("s").alias("asked"))
    got = spark.createDataFrame([(1, 10, "x"), (2, 4000, "late")], "id int, s int, body string").select("id", F.timestamp_seconds("s").alias("answered"), "body")
    assert {r["id"]: r["body"] for r in answered(asked, got).collect()} == {1: "x", 2: None, 3: None}
