"""Streams give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from tidelog.operators import dedup, delivery, log
from tidelog.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_dedup_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("w", "t", f"k{i % 7}" if i % 7 else [None, ""][i % 2], f"{i:04d}", T0 + dt.timedelta(hours=i), "a" if i % 5 else "b") for i in range(120)], "workspace string, topic string, idempotency_key string, id string, timestamp timestamp, fingerprint string")
    for part in range(3):
        rows.filter(f"cast(id as int) div 40 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(streams.dedup(stream).writeStream.format("memory").queryName("dedup").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start())
    got = {r["id"]: (r["verdict"], r["receipt_id"]) for r in spark.table("dedup").collect()}
    assert got == {r["id"]: (r["verdict"], r["receipt_id"]) for r in dedup.by_window(rows).collect()}


def test_tail_resumes_behind_offsets(spark, tmp_path):
    rows = [(str(i), T0, "a" if i % 2 else "b", f"k{i}", "{}", i) for i in range(40)]
    events = log.to_log(spark.createDataFrame(rows, "id string, timestamp timestamp, type string, key string, data string, seq long"), "t", 2, ["seq"])
    full = events.withColumns({"headers": F.lit(None).cast("map<string,string>"), "idempotency_key": F.lit("")})
    from tidelog import schema as S

    full.select(*[f.name for f in S.EVENT]).write.parquet(str(tmp_path / "log"))
    query = streams.tail(spark, str(tmp_path / "log"), {0: 5, 1: 0}, "a").writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(query)
    want = full.filter("type = 'a' AND (partition = 1 OR offset >= 5)").count()
    assert spark.table("tail").count() == want > 0


def test_tail_starts_and_follows():
    import pytest

    from tidelog import schema as S

    bounds = {0: (3, 9), 1: (0, 0)}
    assert [streams.start_offset(bounds, 0, *a) for a in ((), (3,), (5, 6), (None, 8))] == [9, 3, 7, 9] and streams.start_offset(bounds, 1) == 0
    for partition, *a in ((0, 2), (0, 10), (0, None, 9), (0, None, (1 << 63) - 1), (0, None, -1), (2,)):
        with pytest.raises(S.OutOfRange):
            streams.start_offset(bounds, partition, *a)
    with pytest.raises(S.TooMany):
        streams.admit_stream({"a": 16}, "a")
    with pytest.raises(S.TooMany):
        streams.admit_stream({str(k): 8 for k in range(8)}, "z")
    streams.admit_stream({"a": 16}, "b")
    log_ = [{"offset": i, "type": "ab"[i % 2]} for i in range(250)]
    read = lambda offset, limit: [e for e in log_ if e["offset"] >= offset][:limit]
    assert [e and e["offset"] for e, _ in zip(streams.follow(read, 0, "b"), range(127))] == [*range(1, 250, 2), None, None]


def test_frames(spark):
    rows = log.to_log(spark.createDataFrame([("a", T0, "x", "k", '{"n":1}', 0)], "id string, timestamp timestamp, type string, key string, data string, seq long"), "t", 1, ["seq"])
    assert streams.frames(rows).first()["frame"] == 'id: 0\ndata: {"id":"a","topic":"t","partition":0,"offset":0,"timestamp":"2024-01-01T00:00:00.000000Z","type":"x","key":"k","data":{"n":1}}\n\n'


def test_rollup_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("w1", f"s{i % 2}", f"e{i % 9}", i % 3 + 1, ["delivered", "retry", "unknown", "dlq"][i % 4], T0 + dt.timedelta(seconds=i)) for i in range(90)], "workspace string, subscription_id string, event_id string, attempt int, status string, timestamp timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    drain(streams.rollup(stream).writeStream.format("memory").queryName("rollup").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start())
    subs = spark.createDataFrame([("s0", "w1"), ("s1", "w1")], "id string, workspace string")
    assert [tuple(r) for r in spark.table("rollup").collect()] == [tuple(r) for r in delivery.rollup(delivery.history(rows), subs).collect()]


def test_append_stream_is_idempotent_by_batch(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = []
    query = streams.append(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, name: seen.append((name, df.count())), str(tmp_path / "c"), "copy")
    query.awaitTermination()
    assert seen == [("copy-0", 10)]


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(minutes=1)), ("b", T0 + dt.timedelta(minutes=30))], "type string, timestamp timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("type string, timestamp timestamp").parquet(str(tmp_path / "in"))
    drain(streams.windowed_counts(stream, "10 minutes", "1 minute").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start())
    assert [(r["type"], r["events"]) for r in spark.table("counts").collect()] == [("a", 2)]
