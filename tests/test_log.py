"""The log, reads, replay, deduplication, groups, delivery and dead letters on small scenarios."""

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators import dedup, delivery, groups, log, metadata, metrics, replay, scan

T0 = dt.datetime(2024, 1, 1)


def events(spark, n, key=lambda i: f"customer_{i % 500}"):
    rows = [(str(i), T0 + dt.timedelta(seconds=i), "order.created", key(i), f'{{"sequence":{i}}}', i) for i in range(n)]
    return spark.createDataFrame(rows, "id string, timestamp timestamp, type string, key string, data string, seq long")


@pytest.fixture(scope="module")
def acceptance(spark):
    return log.to_log(events(spark, 10_000), "orders", 4, ["seq"], chunk=F.floor(F.col("seq") / 700)).cache()


def test_acceptance_scenario(spark, acceptance):
    found = {r["partition"]: r for r in log.bounds(acceptance, spark.range(5).select(F.lit("orders").alias("topic"), F.col("id").cast("int").alias("partition"))).collect()}
    assert [(found[p]["oldest"], found[p]["next"], found[p]["events"]) for p in range(4)] == [(0, 2500, 2500)] * 4
    assert found[4]["events"] == found[4]["next"] == 0
    assert log.gaps(acceptance).count() == 0
    rows = acceptance.select("key", "partition", "offset", "seq").collect()
    by_key = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        by_key.setdefault(r["key"], []).append((r["partition"], r["seq"]))
    assert all(len({p for p, _ in v}) == 1 and v == sorted(v) for v in by_key.values())


def test_chunked_numbers_equal_plain_ones(spark, acceptance):
    plain = log.to_log(events(spark, 10_000), "orders", 4, ["seq"])
    assert metadata.differs(plain.select("id", "partition", "offset", "record_bytes"), acceptance.select("id", "partition", "offset", "record_bytes")).count() == 0


def test_round_robin_and_base(spark):
    base = spark.createDataFrame([(0, 10), (1, 20)], "partition int, next long")
    rows = log.to_log(events(spark, 6, lambda i: "" if i % 2 else None), "t", 2, ["seq"], base=base).orderBy("seq").collect()
    assert [(r["partition"], r["offset"]) for r in rows] == [(0, 10), (1, 20), (0, 11), (1, 21), (0, 12), (1, 22)]


def test_segments_and_retention(spark):
    sizes = [60, 60, 30, 90, 2000, 1]
    rows = spark.createDataFrame([("t", 0, i, s, T0 + dt.timedelta(hours=i)) for i, s in enumerate(sizes)], "topic string, partition int, offset long, record_bytes int, timestamp timestamp")
    with pytest.raises(S.Invalid):
        log.segment_starts(rows, 100)
    big = rows.withColumn("record_bytes", F.col("record_bytes") * 11)
    found = log.segment_starts(big, 1100).orderBy("base").collect()
    assert [(r["base"], r["next"], r["size"]) for r in found] == [(0, 1, 660), (1, 3, 990), (3, 4, 990), (4, 5, 22000), (5, 6, 11)]
    segments = log.segment_starts(big, 1100)
    dropped = lambda **k: [r["dropped"] for r in log.retained(segments, F.lit(T0 + dt.timedelta(hours=5)), **k).orderBy("base").collect()]
    assert dropped(total_bytes=23001) == [True, True, False, False, False]
    assert dropped(total_bytes=1) == [True, True, True, True, False]  # the active segment stays
    assert dropped(seconds=3 * 3600) == [True, True, False, False, False]
    assert dropped() == [False] * 5
    pinned = spark.createDataFrame([("t", 0, 2)], "topic string, partition int, offset long")
    assert dropped(total_bytes=1, pinned=pinned) == [True, False, False, False, False]
    left = log.apply_retention(big, log.retained(segments, F.lit(T0), total_bytes=23001))
    assert [r["offset"] for r in left.orderBy("offset").collect()] == [3, 4, 5]


def test_damage(spark):
    rows = [("t", 0, 0, 5, False, False), ("t", 0, 5, 8, True, False), ("t", 1, 0, 5, True, False), ("t", 1, 5, 8, False, False), ("t", 2, 0, 5, False, False), ("t", 2, 6, 8, False, False), ("t", 3, 0, 5, False, True)]
    found = log.damage(spark.createDataFrame(rows, "topic string, partition int, base long, next long, torn boolean, corrupt boolean")).orderBy("partition").collect()
    assert [(r["partition"], r["damage"]) for r in found] == [(1, "torn before the end"), (2, "segments don't follow on"), (3, "checksum")]


def test_scan_counts_scanned_rows(spark):
    rows = log.to_log(events(spark, 8, lambda i: "k"), "t", 1, ["seq"]).cache()
    wanted = scan.Range(0, 0, end=6, limit=2, from_time=str(T0 + dt.timedelta(seconds=2)), until_time=str(T0 + dt.timedelta(seconds=5))).check(0, 8)
    seen, offset, pages = [], 0, 0
    while True:
        page = scan.Range(**{**wanted.__dict__, "offset": offset})
        state = scan.cursor(rows, page).first()
        seen += [r["id"] for r in scan.scan(rows, page).orderBy("offset").collect()]
        offset, pages = state["next_offset"], pages + 1
        if state["done"]:
            break
    assert seen == ["2", "3", "4"] and pages == 3
    none = scan.cursor(rows, scan.Range(0, 0, end=6, limit=2, type="missing")).first()
    assert (none["scanned"], none["matched"], none["next_offset"], none["done"]) == (2, 0, 2, False)
    for bad in ((-1, None), (10, 9), (7, 6), (9, None)):
        with pytest.raises(S.OutOfRange):
            scan.Range(0, bad[0], end=bad[1]).check(0, 8)
    with pytest.raises(S.Invalid):
        scan.Range(0, from_time="2024-01-02", until_time="2024-01-01").check(0, 8)
    with pytest.raises(S.Invalid):
        scan.Range(0, limit=1001).check(0, 8)


def test_byte_cap_keeps_the_crossing_row(spark):
    rows = spark.createDataFrame([("t", 0, i, 10) for i in range(9)], "topic string, partition int, offset long, record_bytes int")
    assert [r["offset"] for r in scan.read(rows, 0, 2, 100, 25).orderBy("offset").collect()] == [2, 3, 4]


def test_replay_key_and_provenance(spark):
    rows = spark.createDataFrame([("0" * 32, "orders", 0, 1, T0, "t", "k", "{}", {"a": "1", f"{S.PREFIX}.replay.id": "old"})], "id string, topic string, partition int, offset long, timestamp timestamp, type string, key string, data string, headers map<string,string>")
    r = replay.replay(rows, "run-1", "copy").first()
    assert r["idempotency_key"] == "replay-4e31fa056068f6137c9a9cebf13b6cacde2dfab8bd12d085779d4f267a4d81f2"
    p = f"{S.PREFIX}.replay."
    assert r["headers"] == {"a": "1", p + "id": "run-1", p + "source_id": "0" * 32, p + "source_topic": "orders", p + "source_partition": "0", p + "source_offset": "1"}


def _brute_dedup(rows, seconds, capacity):
    live, out = {}, {}
    for i, key, at, fp in rows:
        live = {k: v for k, v in live.items() if at - v[1] < seconds}
        if key in live:
            out[i] = ("deduplicated" if live[key][2] == fp else "conflict", live[key][0])
            continue
        out[i] = ("accepted", i)
        live[key] = (i, at, fp)
        while len(live) > capacity:
            del live[min(live, key=lambda k: (live[k][1], live[k][0]))]
    return out


def test_dedup_by_brute_force(spark):
    r = random.Random(3)
    rows = [(f"{i:05d}", f"k{r.randrange(60)}", i * 7, r.choice("ab")) for i in range(800)]
    df = spark.createDataFrame([("w", "t", k, i, T0 + dt.timedelta(seconds=at), fp) for i, k, at, fp in rows], "workspace string, topic string, idempotency_key string, id string, timestamp timestamp, fingerprint string")
    got = lambda d: {x["id"]: (x["verdict"], x["receipt_id"]) for x in d.collect()}
    assert got(dedup.by_window(df, 900)) == _brute_dedup(rows, 900, 10**9)
    assert got(dedup.by_window_and_capacity(df, 2000, 20)) == _brute_dedup(rows, 2000, 20)


def test_receipt_bound(spark):
    rows = [("w", "t", str(i), f"{i:06d}", T0 + dt.timedelta(milliseconds=i), "f") for i in range(4096 + 20)] + [("w", "t", k, f"z{k}", T0 + dt.timedelta(seconds=60), "f") for k in ("20", "0")]
    df = spark.createDataFrame(rows, "workspace string, topic string, idempotency_key string, id string, timestamp timestamp, fingerprint string")
    got = {x["id"]: x["verdict"] for x in dedup.by_window_and_capacity(df).collect()}
    assert got["z0"] == "accepted"
    assert got["z20"] == "accepted" or got["z20"] == "deduplicated"
    assert sum(v == "accepted" for v in got.values()) >= 4117


def test_assignment_and_lag(spark):
    members = spark.createDataFrame([("g", "b"), ("g", "a")], "group string, member string")
    slots = spark.range(4).select(F.lit("g").alias("group"), F.col("id").cast("int").alias("partition"))
    assert {r["partition"]: r["member"] for r in groups.assignment(members, slots).collect()} == {0: "a", 1: "b", 2: "a", 3: "b"}
    bounds = spark.createDataFrame([("t", 0, 5, 20)], "topic string, partition int, oldest long, next long")
    r = groups.lag(groups.start(bounds, "g", "earliest").withColumn("committed", F.lit(0).cast("long")), bounds).first()
    assert (r["lag"], r["unavailable"]) == (20, 5)
    assert groups.start(bounds, "g", "latest").first()["committed"] == 20


COMMAND = "group string, seq long, at long, command string, member string, epoch long, partition int, token long, offset long, limit int, end long"


def run(spark, *commands, partitions=1, ttl=60, visibility=10, end=10):
    rows = []
    for i, (at, what, who, *more) in enumerate(commands):
        m = more[0] if more else {}
        rows.append(("g", i, at, what, who, m.get("epoch"), m.get("p", 0 if what in ("ack", "nack", "commit", "reset") else None), m.get("token"), m.get("offset"), m.get("limit", 10), end))
    return [(r["verdict"], r["committed"], r["events"]) for r in groups.fold_commands(spark.createDataFrame(rows, COMMAND), partitions, ttl, visibility).orderBy("seq").collect()]


def test_prefix_commit_and_redelivery(spark):
    got = run(spark, (0, "join", "a"), (1, "pull", "a"), (2, "commit", "a", {"offset": 0}), (2, "commit", "a", {"offset": 11}), (2, "commit", "a", {"offset": 3}), (3, "pull", "a"), (4, "ack", "a"), (5, "pull", "a"))
    assert got == [("ok", None, 0), ("ok", None, 10), ("invalid", 0, 0), ("invalid", 0, 0), ("ok", 3, 0), ("ok", None, 7), ("ok", 10, 0), ("ok", None, 0)]


def test_fencing(spark):
    start = [(0, "join", "a"), (1, "pull", "a")]
    for what in [(2, "ack", "b"), (2, "ack", "a", {"token": 9}), (2, "ack", "a", {"p": 1}), (2, "ack", "a", {"epoch": 1}), (11, "ack", "a"), (61, "ack", "a")]:
        assert run(spark, *start, what)[-1][0] == "fenced", what
    assert run(spark, *start, (2, "join", "b"), (3, "ack", "a"))[-1][0] == "fenced"  # the new member took the lease away
    assert run(spark, *start, (2, "nack", "a"), (3, "pull", "a"))[-1] == ("ok", None, 10)
    assert run(spark, *start, (2, "reset", "a", {"offset": 5}))[-1][0] == "fenced"
    assert run(spark, *start, (2, "leave", "a"), (3, "reset", "a", {"offset": 5}), (3, "reset", "a", {"offset": 11}))[-2:] == [("ok", 5, 0), ("invalid", 5, 0)]


def test_delivery_state_machine(spark):
    schema = "subscription_id string, partition int, tick long, at long, end long, http_status int, crash boolean, max_attempts int, delay int, retry_after string"
    def go(*ticks):
        rows = [("s", 0, i, at, 2, status, crash, 2, 2, *(wish or [None])) for i, (at, status, crash, *wish) in enumerate(ticks)]
        return [(f"e{r['offset'] + 1}", r["action"], r["status"], r["attempt"]) for r in delivery.run_ticks(spark.createDataFrame(rows, schema)).orderBy("tick").collect()]
    assert go((0, 500, False), (1, 200, False), (2, 200, False), (3, 404, False)) == [("e1", "send", "sending", 1), ("e1", "answer", "retry", 1), ("e1", "wait", "retry", 1), ("e1", "send", "sending", 2), ("e1", "answer", "delivered", 2), ("e2", "send", "sending", 1), ("e2", "answer", "failed", 1), ("e2", "dead letter", "dlq", 1)]
    assert go((0, 200, True), (5, 200, False), (40, 500, False)) == [("e1", "send", "sending", 1), ("e1", "wait", "sending", 1), ("e1", "record", "unknown", 1), ("e1", "send", "sending", 2), ("e1", "answer", "failed", 2), ("e1", "dead letter", "dlq", 2)]
    # a receiver's wish counts for 429 and 503, where it is later than the backoff
    for status, wish, at, action in ((503, "60", 59, "wait"), (503, "60", 60, "send"), (429, "1", 1, "wait"), (429, "1", 2, "send"), (500, "60", 2, "send")):
        assert go((0, status, False, wish), (at, 200, False))[2][1] == action


def test_rate_limit_window_starts_at_first_request(spark):
    rows = spark.createDataFrame([("k", 0.5, 1), ("k", 0.9, 2), ("k", 1.2, 3), ("k", 1.5, 4), ("k", 1.6, 5)], "key string, at double, seq long")
    got = {r["seq"]: r["allowed"] for r in delivery.rate_limited(rows, 2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_limiter_is_bounded(spark):
    rows = [("l", f"k{i}", float(i), i) for i in range(4)] + [("l", "k4", 10.0, 4), ("l", "k0", 11.0, 5), ("l", "k4", 63.5, 6), ("l", "k3", 63.6, 7), ("l", "k1", 63.7, 8)]
    got = {r["seq"]: r["known"] for r in delivery.limited_keys(spark.createDataFrame(rows, "limiter string, key string, at double, seq long"), 4).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: True, 6: True, 7: True, 8: True}  # at 63.5 k1 to k3 go, k0 stays


def test_history_page_is_the_workspaces_own(spark):
    entries = spark.createDataFrame([("s1", i) for i in range(5)] + [("s2", i) for i in range(5, 9)], "subscription_id string, cursor long")
    subs = spark.createDataFrame([("s1", "w1"), ("s2", "w2")], "id string, workspace string")
    page, state = delivery.workspace_page(entries, subs, "w1", "s1", 1, 2)
    assert [r["cursor"] for r in page.collect()] == [2, 3] and tuple(state.first()) == (3, True)
    page, state = delivery.workspace_page(entries, subs, "w1", "s2", 0, 2)
    assert page.count() == 0 and tuple(state.first()) == (0, False)


def test_subscription_is_initialised(spark):
    from tidelog.functions import policy

    key = bytes(range(32))
    rows = [("a", "w", "orders", "https://a.example/x", "s" * 32, {"x-token": "t"}, 3, 2), ("b", "w", "x" * 125, "https://a.example/x", "s" * 32, {}, 3, 2), ("c", "w", "orders", "https://[::1]/", "s" * 32, {}, 3, 2)]
    found = delivery.initialised(spark.createDataFrame(rows, "id string, workspace string, topic string, url string, secret string, headers map<string,string>, max_attempts int, delay int"), key)
    assert "secret" not in found.columns and "headers" not in found.columns
    plain = found.select("*", policy.decrypt(F.col("encrypted_secret"), key, "webhook-secret").alias("s"), policy.decrypt(F.col("encrypted_headers"), key, "webhook-headers").alias("h"))
    a, b, c = plain.orderBy("id").collect()
    assert (a["error"], a["s"], a["h"], a["header_names"], a["dlq_topic"], a["group"]) == (None, "s" * 32, '{"X-Token":"t"}', ["X-Token"], "orders.DLQ", "webhook-a")
    assert (b["error"], c["error"]) == ("topic", "url: address") and b["encrypted_secret"] is None and c["group"] is None


def test_group_gauges(spark):
    bounds = spark.createDataFrame([("t", 0, 2, 10), ("t", 1, 0, 4)], "topic string, partition int, oldest long, next long")
    committed = spark.createDataFrame([("t", 0, "g", 1), ("t", 1, "g", 4)], "topic string, partition int, group string, committed long")
    members = spark.createDataFrame([("t", "g", "a", 50), ("t", "g", "b", 5)], "topic string, group string, member string, until long")
    leases = spark.createDataFrame([("t", "g", 0, "a", 20), ("t", "g", 1, "b", 20), ("t", "g", 1, "a", 9)], "topic string, group string, partition int, member string, until long")
    gauges, counts = groups.metrics(committed, bounds, members, leases, F.lit(10))
    assert {(r["partition"], r["lag"], r["unavailable"], r["in_flight"]) for r in gauges.collect()} == {(0, 9, 1, True), (1, 0, 0, False)}
    assert [(r["group"], r["members"]) for r in counts.collect()] == [("g", 1)]
    with pytest.raises(Exception, match="outside the log"):
        groups.metrics(committed.withColumn("committed", F.lit(11).cast("long")), bounds, members, leases, F.lit(10))[0].collect()


def test_prepared_appends(spark):
    inputs = spark.createDataFrame([("t", p, f"e{p}{i}", f"fp{i}", i) for p in (0, 1) for i in range(3)], "topic string, partition int, id string, fingerprint string, seq long")
    bounds = spark.createDataFrame([("t", 0, 5), ("t", 1, 0)], "topic string, partition int, next long")
    pending = replay.reserve(inputs, bounds, ["seq"])
    assert {(r["partition"], r["id"], r["offset"]) for r in pending.collect()} == {(p, f"e{p}{i}", (5, 0)[p] + i) for p in (0, 1) for i in range(3)}
    there = pending.filter("partition = 0 and seq < 2").select("topic", "partition", "offset", "id", "fingerprint")
    now = spark.createDataFrame([("t", 0, 7), ("t", 1, 0)], "topic string, partition int, next long")
    assert {(r["partition"], r["offset"]) for r in replay.append_prepared(pending, there, now).collect()} == {(0, 7), (1, 0), (1, 1), (1, 2)}
    assert replay.complete(pending, there).count() == 4
    with pytest.raises(Exception, match="place taken"):
        replay.append_prepared(pending, there.withColumn("id", F.lit("x")), now).collect()


def test_gaps_across_chunks(spark):
    kept = [0, 1, 2, 5, 6, 9, 10, 11, 30, 31]
    rows = spark.createDataFrame([("t", 0, o) for o in kept] + [("t", 1, 3)], "topic string, partition int, offset long")
    for chunk in (1, 3, 10, 1000):
        assert {(r["previous"], r["offset"]) for r in log.gaps(rows, chunk).collect()} == {(2, 5), (6, 9), (11, 30)}


def test_request_parameters():
    r = scan.parse_range({"partition": "1", "offset": "+5", "limit": "", "end_offset": "9", "from_time": "2024-01-01T00:00:00.123456789Z", "until_time": "2024-01-01T02:00:00+01:00", "type": "x"})
    assert (r.partition, r.offset, r.limit, r.end, r.type, r.key) == (1, 5, 100, 9, "x", "")
    assert r.from_time == dt.datetime(2024, 1, 1, 0, 0, 0, 123456, dt.UTC) and r.check(0, 9).end == 9
    for bad in ({}, {"partition": "0"}, {"partition": "x", "offset": "0"}, {"partition": "0", "offset": "1.5"}, {"partition": "0", "offset": str(1 << 63)}, {"partition": "0", "offset": "0", "limit": "a"}, {"partition": "0", "offset": "0", "from_time": "2024-01-01"}, {"partition": "0", "offset": "0", "from_time": "2024-13-01T00:00:00Z"}):
        with pytest.raises(S.Invalid) as e:
            scan.parse_range(bad)
        assert scan.error_status(e.value) == 400
    with pytest.raises(S.Invalid):  # equal times, spelled apart
        scan.Range(0, 0, from_time="2024-01-01T01:00:00Z", until_time="2024-01-01 01:00:00").check(0, 0)
    scan.Range(0, 0, from_time="2024-01-01 02:00:00", until_time="2024-01-01T03:00:00").check(0, 0)
    with pytest.raises(S.OutOfRange) as e:
        scan.Range(0, 5).check(0, 4)
    assert scan.error_status(e.value) == 416 and scan.error_status(KeyError()) == 400


def test_history_pages(spark):
    rows = spark.createDataFrame([(i,) for i in (1, 4, 6, 9)], "cursor long")
    page, state = delivery.keyset_page(rows, "cursor", 0, 2)
    assert [r["cursor"] for r in page.collect()] == [1, 4] and tuple(state.first()) == (4, True)
    page, state = delivery.keyset_page(rows, "cursor", 4, 2)
    assert [r["cursor"] for r in page.collect()] == [6, 9] and tuple(state.first()) == (9, False)
    assert tuple(delivery.keyset_page(rows, "cursor", 9, 2)[1].first()) == (9, False)


def test_exposition_escapes(spark):
    rows = spark.createDataFrame([("m", {"b": 'x"\n\\', "a": "1"}, 3.0), ("m", {}, 0.5)], "metric string, labels map<string,string>, value double")
    assert [r["line"] for r in metrics.exposition(rows).collect()] == ["m 0.5", 'm{a="1",b="x\\"\\n\\\\"} 3']


def test_upsert_and_backfill(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, n int")
    got = metadata.upsert(table, spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "id int, v string, n int"), ["id"], "n")
    assert {r["id"]: r["v"] for r in got.collect()} == {1: "a", 2: "c", 3: "d"}
    assert metadata.insert_ignore(table, spark.createDataFrame([(2, "x", 9), (4, "y", 9)], "id int, v string, n int"), ["id"]).count() == 3
    attempts = spark.createDataFrame([("s", "e", '{"attempts":2,"status":"retry"}'), ("s", "f", '{"attempts":0,"status":"sending"}')], "subscription_id string, event_id string, attempt string")
    history = spark.createDataFrame([], "subscription_id string, event_id string, attempt int, status string")
    assert [tuple(r) for r in metadata.backfill(attempts, history).collect()] == [("s", "e", 2, "retry")]


def test_subscription_rules(spark):
    good = ("https://a.example", "s" * 32, 3, 2, {"X": "1"})
    cases = [good, ("http://a.example", *good[1:]), (good[0], "s", *good[2:]), (*good[:2], 21, *good[3:]), (*good[:3], 0, good[4]), (*good[:4], {"Host": "1"})]
    rows = spark.createDataFrame(cases, "url string, secret string, max_attempts int, delay int, headers map<string,string>")
    assert [r["e"] for r in rows.select(delivery.subscription_error(rows).alias("e")).collect()] == [None, "url: scheme", "secret", "max_attempts", "delay", "headers: reserved"]


def test_crc_is_ieee():
    assert zlib.crc32(b"123456789") == 3421780262
