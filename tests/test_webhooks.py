"""Delivery to webhooks through a transport that writes down what it is asked."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import policy
from tidelog.operators import delivery, log
from tidelog.streaming.webhooks import Sink, request_headers

KEY, T0 = bytes(range(32)), dt.datetime(2024, 1, 1)


def setup(spark, tmp_path, n=4, partitions=1, max_attempts=2):
    rows = [(str(i), T0 + dt.timedelta(seconds=i), "order", f"k{i}", f'{{"n":{i}}}', i) for i in range(n)]
    events = log.to_log(spark.createDataFrame(rows, "id string, timestamp timestamp, type string, key string, data string, seq long"), "orders", partitions, ["seq"]).withColumn("headers", F.lit(None).cast("map<string,string>"))
    subs = delivery.initialised(spark.createDataFrame([("s1", "w", "orders", "https://a.example/x", "s" * 32, {"x-token": "t"}, max_attempts, 2)], "id string, workspace string, topic string, url string, secret string, headers map<string,string>, max_attempts int, delay int"), KEY)
    book, script, now = tmp_path / "asked.jsonl", tmp_path / "answers.json", tmp_path / "now"
    now.write_text("1000")

    def transport(url, headers, payload):
        with open(book, "a") as f:
            f.write(json.dumps([url, headers, payload]) + "\n")
        answers = json.loads(script.read_text())
        found = answers.get(json.loads(payload)["id"], 200)
        if found is None:
            raise ConnectionResetError("gone")
        return (found, {}) if isinstance(found, int) else (found[0], {"Retry-After": found[1]})

    letters = []
    sink = Sink(spark, str(tmp_path / "sink"), KEY, transport, lambda rows: letters.extend(rows.collect()), lambda: float(now.read_text()))

    def asked():
        return [json.loads(x) for x in book.read_text().splitlines()] if book.exists() else []

    def tick(at, **answers):
        now.write_text(str(at))
        script.write_text(json.dumps({k.removeprefix("e"): v for k, v in answers.items()}))
        before = len(asked())
        n = sink.tick(events, subs)
        return n, [json.loads(p)["id"] for _, _, p in asked()[before:]]

    def history():
        return [(r["event_id"], r["attempt"], r["status"]) for r in sink.attempts().orderBy("offset", "cursor").collect()]

    return sink, tick, asked, history, letters, events, subs


def test_attempts_retries_and_dead_letters(spark, tmp_path):
    sink, tick, asked, history, letters, _, _ = setup(spark, tmp_path)
    assert tick(1000) == (1, ["0"])
    url, headers, payload = asked()[0]
    assert url == "https://a.example/x" and headers["X-Token"] == "t" and headers["X-Tidelog-ID"] == "0" and headers["X-Tidelog-Timestamp"] == "1000"
    assert headers == request_headers({"X-Token": "t"}, "0", "1000", "s" * 32, payload) and headers["X-Tidelog-Signature"] == policy.signature("s" * 32, "1000", payload)
    assert json.loads(payload) == {"id": "0", "topic": "orders", "partition": 0, "offset": 0, "timestamp": "2024-01-01T00:00:00.000000Z", "type": "order", "key": "k0", "data": {"n": 0}}
    assert tick(1001, e1=[503, "60"]) == (1, ["1"])  # blocks those behind it until the receiver's time
    assert tick(1060) == (0, []) and tick(1061, e1=None) == (1, ["1"])  # the second failure is the last
    assert [(r["topic"], r["key"], r["type"]) for r in letters] == [("orders.DLQ", "1", S.FAILURE_TYPE)]
    letter = json.loads(letters[0]["data"])
    assert (letter["attempts"], letter["error"], letter["subscription_id"], letter["original_offset"]) == (2, "transport failure", "s1", 1)
    assert tick(1062, e2=404) == (1, ["2"]) and len(letters) == 2  # permanent: no second attempt
    assert tick(1063) == (1, ["3"]) and tick(1064) == (0, [])
    assert history() == [
        ("0", 1, "sending"), ("0", 1, "delivered"), ("1", 1, "sending"), ("1", 1, "retry"), ("1", 2, "sending"), ("1", 2, "failed"), ("1", 2, "dlq"),
        ("2", 1, "sending"), ("2", 1, "failed"), ("2", 1, "dlq"), ("3", 1, "sending"), ("3", 1, "delivered"),
    ]
    latest = delivery.latest(sink.attempts()).collect()
    assert {r["event_id"]: r["status"] for r in latest} == {"0": "delivered", "1": "dlq", "2": "dlq", "3": "delivered"}


def test_lost_outcomes_are_unknown(spark, tmp_path, monkeypatch):
    sink, tick, asked, history, letters, events, subs = setup(spark, tmp_path, n=1)
    for at in (1000, 1030):  # the driver dies after the request
        monkeypatch.setattr(sink, "_outcomes", lambda *a: 1 / 0)
        try:
            tick(at)
        except ZeroDivisionError:
            pass
        monkeypatch.undo()
    assert tick(1031) == (0, []) and tick(1060) == (1, [])  # both attempts are used up
    assert history() == [("0", 1, "sending"), ("0", 1, "unknown"), ("0", 2, "sending"), ("0", 2, "unknown"), ("0", 2, "dlq")] and len(letters) == 1


def test_stream_delivers_all_partitions(spark, tmp_path):
    sink, tick, asked, history, letters, events, subs = setup(spark, tmp_path, n=6, partitions=3)
    (tmp_path / "answers.json").write_text("{}")
    events.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "log"))
    sink.run(stream, lambda: events, lambda: subs, str(tmp_path / "c")).awaitTermination()
    assert sorted(json.loads(p)["id"] for _, _, p in asked()) == [str(i) for i in range(6)]
    assert sink.tick(events, subs.withColumn("paused", F.lit(True))) == 0
