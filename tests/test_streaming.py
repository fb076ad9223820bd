"""Streams: the stash as stateful operator, the registry through foreachBatch."""

from pyspark.sql import functions as F

from glyphlake.streaming import event_time, registry_feed, stash

ROWS = "key string, event_id long, ts timestamp, op string, bytes binary, name string, mime string"


def test_stash_reads_once(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2026, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    get = (None, None, None)
    rows = [("a", 1, at(0), "put", b"five", "a b.png", "image/png"), ("a", 2, at(10), "get", *get), ("a", 3, at(20), "get", *get), ("b", 4, at(0), "put", b"six", None, None), ("b", 5, at(301), "get", *get), ("c", 6, at(0), "get", *get), ("d", 7, at(0), "put", b"", "e", "f"), ("d", 8, at(1), "get", *get)]
    df = spark.createDataFrame(rows, ROWS)
    assert [(r["key"], r["put_id"], r["get_id"]) for r in stash.served(df.where("key <> 'd'")).collect()] == [("a", 1, 2)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        q = stash.stream(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {r["get_id"]: (r["put_id"], r["status"], r["bytes"] and bytes(r["bytes"]), r["name"], r["mime"]) for r in spark.table("answers").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    lost = (None, 404, None, None, None)
    assert got == {2: (1, 200, b"five", "a b.png", "image/png"), 3: lost, 5: lost, 6: lost, 8: lost}


def test_registry_feed(spark, tmp_path):
    key = lambda c: c * 64
    schema = "key string, seq long, content_id string"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([(key("a"), 1, "old"), (key("b"), 1, "b"), ("bad", 1, "x")], schema).write.mode("append").parquet(source)
    registry_feed.feed(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "cp")).awaitTermination(120)
    more = spark.createDataFrame([(key("a"), 1, "new")], schema)
    more.write.mode("append").parquet(source)
    registry_feed.feed(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "cp")).awaitTermination(120)
    rows = {r["key"]: r["content_id"] for r in registry_feed.current(spark, table).collect()}
    assert rows == {key("a"): "new", key("b"): "b"}
    registry_feed.merge(table)(more, 1)  # the same batch once more
    assert registry_feed.current(spark, table).where(F.col("content_id") == "new").count() == 1


def test_registry_feed_rewrites_only_what_a_batch_touches(spark, tmp_path):
    table, key = str(tmp_path / "table"), lambda c: c * 64
    entries = lambda *rows: spark.createDataFrame(list(rows), "key string, seq long, content_id string")
    one = registry_feed.merge(table)
    state = lambda: {r["key"][0]: r["content_id"] for r in registry_feed.current(spark, table).collect()}
    assert registry_feed.current(spark, table) is None
    one(entries((key("a"), 1, "a0"), (key("b"), 1, "b0"), (key("B"), 1, "B0")), 0)
    one(entries((key("a"), 2, "a1")), 1)
    assert registry_feed.parts(spark, table) == {"aa": 1, "bb": 0}
    one(entries((key("b"), 2, "b2")), 2)
    one(entries((key("b"), 2, "b2")), 2)
    assert state() == {"a": "a1", "b": "b2", "B": "B0"}
    one(entries(), 3)
    one(entries((key("c"), 1, "c4")), 4)
    assert state() == {"a": "a1", "b": "b2", "B": "B0", "c": "c4"}
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == ["m3", "m4", "v1", "v2", "v4"]


def test_late_rows_are_left_out_of_a_stream(spark, tmp_path):
    """Ten minutes' patience: a row of the first hour that comes after one of the third is too late."""
    schema, source = "event_id long, ts timestamp, kind string", str(tmp_path / "in")
    steps = [[(1, "2026-01-01 00:05:00", "a")], [(2, "2026-01-01 02:30:00", "a")], [(3, "2026-01-01 00:06:00", "a"), (4, "2026-01-01 02:25:00", "a")], [(5, "2026-01-01 05:00:00", "a")], [(6, "2026-01-01 07:00:00", "a")]]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, "event_id long, ts string, kind string").selectExpr("event_id", "cast(ts as timestamp) ts", "kind").coalesce(1).write.mode("append").parquet(source)
        counted = event_time.windowed(spark.readStream.schema(schema).parquet(source), "1 hour", "10 minutes", ["kind"], [F.count("*").alias("n")])
        q = counted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {str(r["start"])[11:16]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["00:00"] == 1 and got["02:00"] == 2
