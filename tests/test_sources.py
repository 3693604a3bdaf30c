"""Framed segments, the Parquet store and the client."""

import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.client import Client, ClientError, main
from tidelog.operators import log, scan
from tidelog.sources import framed
from tidelog.sources.store import Store

T0 = dt.datetime(2024, 1, 1)


def small_log(spark, n=200):
    rows = [(str(i), T0 + dt.timedelta(seconds=i), "order.created", "customer", f'{{"n":{i},"s":"é<&>"}}', i) for i in range(n)]
    return log.to_log(spark.createDataFrame(rows, "id string, timestamp timestamp, type string, key string, data string, seq long"), "orders", 4, ["seq"])


def test_round_trip_and_corruption(spark, tmp_path):
    root = str(tmp_path / "log")
    rows = small_log(spark)
    written = framed.write(rows, root, 1024).collect()
    assert len(written) >= 2 and max(r["next"] for r in written) == 200
    pick = ["topic", "partition", "offset", "id", "timestamp", "type", "key", "data"]
    assert framed.read(spark, root).select(*pick).exceptAll(rows.select(*pick)).count() == 0
    assert framed.read(spark, root).count() == 200
    spark.dataSource.register(framed.FramedLog)
    assert spark.read.format("framed_log").load(root).count() == 200
    files = sorted((tmp_path / "log" / "orders" / "1").glob("*.log"))
    raw = files[-1].read_bytes()
    files[-1].write_bytes(raw + b"\0\0\1")  # a torn tail is let go
    assert framed.read(spark, root).count() == 200
    files[-1].write_bytes(raw[:12] + b"\xff" + raw[13:])
    with pytest.raises(S.Corrupt):
        framed.read(spark, root)
    files[-1].write_bytes(raw)
    files[0].write_bytes(files[0].read_bytes() + b"\0\0\1")  # torn, but not at the end
    with pytest.raises(S.Corrupt):
        framed.read(spark, root)
    files[0].unlink()


def test_decode_limits():
    assert framed.decode(b"") == ([], None)
    assert framed.decode(b"\0\0\0\0\0\0\0\0")[1] == "corrupt"
    frame = framed.encode({"id": "a", "offset": 0})
    assert framed.decode(frame)[0][0][0] == {"id": "a", "offset": 0}
    assert framed.decode(frame + frame[:-1])[1] == "torn"


def inputs(spark, rows):
    return spark.createDataFrame([(i, "t", f"k{i % 3}", d, k) for i, (d, k) in enumerate(rows)], "seq long, type string, key string, data string, idempotency_key string")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path), min_free_bytes=0)
    schema = '{"type":"object","required":["id"]}'
    store.create_topic("demo", "orders", 2, schema=schema)
    for bad in (("demo", "x.DLQ", 1), ("demo", "..", 1), ("demo", "y", 0), ("demo", "y", 257)):
        with pytest.raises(S.Invalid):
            store.create_topic(*bad)
    with pytest.raises(S.Conflict):
        store.create_topic("demo", "orders", 2)
    got = store.publish("demo", "orders", inputs(spark, [('{"id":1}', "a"), ("{}", ""), ('{"id":2}', ""), ("x", ""), ('{"id":3}', "b")]), ["seq"], "b1", F.lit(T0)).orderBy("seq").collect()
    assert [(r["status"], r["error"]) for r in got] == [(201, None), (400, "schema"), (201, None), (400, "data"), (201, None)]
    places = {r["seq"]: (r["partition"], r["offset"]) for r in got}
    again = store.publish("demo", "orders", inputs(spark, [('{ "id": 1 }', "a"), ('{"id":9}', "b")]).withColumn("key", F.when(F.col("seq") == 0, "k0").otherwise("k1")), ["seq"], "b2", F.lit(T0 + dt.timedelta(hours=1))).orderBy("seq").collect()
    assert (again[0]["status"], again[0]["deduplicated"], (again[0]["partition"], again[0]["offset"])) == (201, True, places[0])
    assert (again[1]["status"], again[1]["error"]) == (409, "conflict")
    assert store.log("demo", "orders").count() == 3
    store.publish("demo", "orders", inputs(spark, [('{"id":1}', "a"), ("{}", ""), ('{"id":2}', ""), ("x", ""), ('{"id":3}', "b")]), ["seq"], "b1", F.lit(T0))  # the same batch again
    assert store.log("demo", "orders").count() == 3
    bounds = {r["partition"]: r for r in store.bounds("demo", "orders").collect()}
    assert sum(r["events"] for r in bounds.values()) == 3
    full = max(bounds, key=lambda p: bounds[p]["events"])
    assert store.scan("demo", "orders", scan.Range(full, 0, limit=10)).count() == bounds[full]["events"]
    with pytest.raises(S.OutOfRange):
        store.scan("demo", "orders", scan.Range(full, 99))
    with pytest.raises(S.Unavailable):
        Store(spark, str(tmp_path), min_free_bytes=1 << 60).admit()
    store.audit("demo", "me", "topic.create", "orders")
    assert store.topics("demo") == ["orders"] and store.topics("other") == []


def test_a_batch_is_judged_in_its_order(spark, tmp_path):
    """Rows of a batch have one time; of two with a key the first is accepted, whatever their ids, also against an earlier batch."""
    store = Store(spark, str(tmp_path), min_free_bytes=0)
    store.create_topic("demo", "orders", 2)
    rows = [(f'{{"n":{i}}}', f"k{i % 6}") for i in range(18)]
    got = store.publish("demo", "orders", inputs(spark, rows).withColumn("key", F.lit("a")), ["seq"], "b1", F.lit(T0)).orderBy("seq").collect()
    assert [r["status"] for r in got] == [201] * 6 + [409] * 12
    again = store.publish("demo", "orders", inputs(spark, rows[::-1]).withColumn("key", F.lit("a")), ["seq"], "b2", F.lit(T0)).orderBy("seq").collect()
    assert [r["status"] for r in again] == [409] * 12 + [201] * 6 and all(r["deduplicated"] for r in again[12:])
    late = store.publish("demo", "orders", inputs(spark, rows[6:12]), ["seq"], "b3", F.lit(T0 + dt.timedelta(days=1))).collect()
    assert [r["status"] for r in late] == [201] * 6 and store.log("demo", "orders").count() == 12


def test_client_retries_reads_only():
    calls, waits = [], []
    answers = [(503, "x"), (200, {"ok": 1})]

    def transport(method, path, body):
        calls.append((method, path))
        return answers[min(len(calls) - 1, 1)]

    assert Client(transport, waits.append).call("GET", "/v1/topics") == {"ok": 1} and len(calls) == 2 and waits == [0.2]
    calls.clear()
    with pytest.raises(ClientError):
        Client(transport, waits.append).publish("t", "x", {})
    assert len(calls) == 1
    calls.clear()
    with pytest.raises(ClientError):
        Client(lambda *a: (302, "moved"), waits.append).call("GET", "/")


def service(answers, log_):
    """A transport that answers by the path's last part; what it was asked is logged."""

    def transport(method, path, body):
        name = path.split("?")[0].rsplit("/", 1)[1]
        log_.append((method, path, body))
        found = answers[name].pop(0) if isinstance(answers.get(name), list) else answers.get(name, {"ok": True})
        if isinstance(found, Exception):
            raise found
        return found if isinstance(found, tuple) else (200, found)

    return transport


LEASED = {"partition": 1, "token": "t", "epoch": 2, "events": [{"id": "a"}]}


@pytest.mark.parametrize(("failure", "joins", "waits"), [((409, {"error": "fenced"}), 2, []), ((503, {"error": "busy"}), 1, [0.2]), (OSError("offline"), 2, [0.2]), (TimeoutError("late"), 2, [0.2]), (ConnectionResetError(), 2, [0.2])])
def test_subscribe_recovers(failure, joins, waits):
    asked, slept, seen = [], [], []
    answers = {"join": [{"epoch": 1}, {"epoch": 2}], "pull": [failure, [LEASED]]}
    client = Client(service(answers, asked), slept.append)
    client.subscribe("t", "g", "m", lambda d: (seen.append(d.events), d.ack()), running=lambda: not seen)
    names = [p.rsplit("/", 1)[1] for _, p, _ in asked]
    assert seen == [[{"id": "a"}]] and names == ["join", "pull", *["join"] * (joins - 1), "pull", "ack", "leave"] and slept == waits
    assert asked[-2] == ("POST", "/v1/topics/t/groups/g/ack", {"member": "m", "epoch": 2, "partition": 1, "token": "t"})
    assert asked[-3][2] == {"member": "m", "epoch": joins, "limit": 100}


def test_subscribe_passes_errors_on():
    """A refused pull and a callback's error reach the caller, whatever leaving does."""
    for answers, error in (({"join": {"epoch": 1}, "pull": [(403, {"error": "no"})], "leave": (500, "x")}, ClientError), ({"join": {"epoch": 1}, "pull": [[LEASED]], "leave": OSError()}, KeyError)):
        asked = []
        with pytest.raises(error) as e:
            Client(service(answers, asked), lambda s: None).subscribe("t", "g", "m", lambda d: {}["callback"])
        assert asked[-1][1].endswith("/leave") and getattr(e.value, "status", 403) == 403


def test_requests_have_the_fields_of_the_service():
    asked = []
    answers = {"batch": {"results": [{"event": {"id": "a"}}, {"error": "type"}]}, "pull": [[LEASED]], "dead-letters": {"events": []}}
    c = Client(service(answers, asked))
    assert c.publish_batch("a/b", [{"type": "x", "data": 1}])[1] == {"error": "type"}
    c.publish("t", "x", {"n": 1}, key="k", headers={"h": "v"}, idempotency_key="i")
    c.dead_letters("t", 0, 5, limit=7)
    c.resolve_dead_letter("t", 0, 5, "retry")
    c.replay("t", "copy", "run", 1, 0, 9, type="x")
    c.reset("t", "g", 0, 3)
    (d,) = c.pull("t", "g", "m", 2)
    d.commit(4)
    d.nack()
    lease = {"member": "m", "epoch": 2, "partition": 1, "token": "t"}
    assert asked == [
        ("POST", "/v1/topics/a%2Fb/events/batch", {"events": [{"type": "x", "data": 1}]}),
        ("POST", "/v1/topics/t/events", {"type": "x", "key": "k", "data": {"n": 1}, "headers": {"h": "v"}, "idempotency_key": "i"}),
        ("GET", "/v1/topics/t/dead-letters?partition=0&offset=5&limit=7", None),
        ("POST", "/v1/topics/t/dead-letters/retry", {"partition": 0, "offset": 5, "confirm": True}),
        ("POST", "/v1/topics/t/replay", {"target": "copy", "replay_id": "run", "partition": 1, "offset": 0, "end_offset": 9, "limit": 100, "confirm": True, "type": "x"}),
        ("POST", "/v1/topics/t/groups/g/reset", {"partition": 0, "offset": 3, "confirm": True}),
        ("POST", "/v1/topics/t/groups/g/pull", {"member": "m", "epoch": 2, "limit": 100}),
        ("POST", "/v1/topics/t/groups/g/commit", lease | {"next_offset": 4}),
        ("POST", "/v1/topics/t/groups/g/nack", lease),
    ]
    with pytest.raises(ValueError):
        c.resolve_dead_letter("t", 0, 5, "drop")


def test_scan_all_and_command_line():
    pages = [{"events": [{"id": 1}], "next_offset": 5, "end_offset": 9, "done": False}, {"events": [], "next_offset": 7, "end_offset": 9, "done": False}, {"events": [{"id": 2}], "next_offset": 9, "end_offset": 9, "done": True}]
    asked = []
    client = Client(lambda m, p, b: (asked.append(p), (200, pages.pop(0)))[1])
    assert [e["id"] for e in client.scan_all("t", 0)] == [1, 2]
    assert asked[0].endswith("partition=0&offset=0&limit=100") and asked[2].endswith("partition=0&offset=7&limit=100&end_offset=9")
    out = io.StringIO()
    assert main(["topics", "list"], Client(lambda m, p, b: (200, ["a"])), out) == 0 and out.getvalue() == '["a"]\n'
    answers = {"join": {"epoch": 1}, "pull": [[], [LEASED], [LEASED]]}
    out = io.StringIO()
    assert main(["consume", "t", "g", "m", "--events", "2"], Client(service(answers, []), lambda s: None), out) == 0
    assert out.getvalue() == '[{"id": "a"}, {"id": "a"}]\n' and main(["nothing"], client, out) == 2
