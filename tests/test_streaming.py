from pyspark.sql import functions as F

from codestrata.streaming import traces as T


def test_accumulator_batch_equals_stream(spark, tmp_path):
    rows = [("a", "b", 1.0), ("a", "b", 3.0), ("b", "error", 2.0)]
    d = spark.createDataFrame(rows, "caller string, callee string, ms double")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = T.accumulate(s).writeStream.outputMode("complete").format("memory").queryName("acc").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.table("acc").collect()}
    assert got == {tuple(r) for r in T.accumulate(d).collect()} == {("a", "b", 2, 4.0, 1.0, 3.0, 0), ("b", "error", 1, 2.0, 2.0, 2.0, 1)}


def test_limiter(spark, tmp_path):
    d = spark.createDataFrame([("k", t) for t in (0, 1, 2, 3, 100, 101)], "key string, ts_ms long")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = T.limited(s, 2, 100).writeStream.outputMode("append").format("memory").queryName("lim").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.ts_ms, r.allowed) for r in spark.table("lim").orderBy("ts_ms").collect()] == [(0, True), (1, True), (2, False), (3, False), (100, True), (101, True)]


def test_merge_keeps_the_later_row(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")
    for i in range(2):
        d.withColumn("v", F.col("v") + i).where(F.lit(i == 0) | (F.col("path") == "a")).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    s = spark.readStream.schema(d.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    T.merge_batches(s, str(tmp_path / "t"), ["path"], str(tmp_path / "c")).awaitTermination(90)
    last = max((tmp_path / "t").glob("v*"), key=lambda p: int(p.name[1:]))
    assert {r.path for r in spark.read.parquet(str(last)).collect()} == {"a", "b"}


def test_quiet_sessions_and_new_since(spark):
    d = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("a", "2024-01-01 01:00:00")], "path string, t string").select("path", F.to_timestamp("t").alias("ts"))
    assert sorted(r.n for r in T.quiet_sessions(d).collect()) == [1, 2]
    a, b = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([("x",), ("y",)], "k string")
    assert [r.k for r in T.new_since(a, b, ["k"]).collect()] == ["y"]
