"""Vectors of hashing, JSON semantics and policy."""

import datetime as dt
import hashlib
import ipaddress
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import hashing, jsonsem, policy

KEYS = {"customer": 10531231725029507641, "same": 683243228863131483, "a": 12638187200555641996, "customer_0": 7429239177338957702, "customer_499": 17281109519492169528, "é": 775207407765167617, "日本": 1305338235904577169, "0": 12638135523509116079, "14": 574365116237742552}


def fnv(raw: bytes) -> int:
    h = 14695981039346656037
    for b in raw:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def test_key_hash(spark):
    keys = [*KEYS, "", "x" * 300, "日本" * 40]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", *[hashing.partition_for(F.col("key"), n).alias(f"p{n}") for n in (1, 2, 4, 7, 256)]).collect()
    for r in rows:
        want = fnv(r["key"].encode())
        assert KEYS.get(r["key"], want) == want
        assert [r[f"p{n}"] for n in (1, 2, 4, 7, 256)] == [want % n for n in (1, 2, 4, 7, 256)]


def test_key_hash_of_arrays():
    """Nulls, slices, empty arrays and keys of very different lengths."""
    keys = [None, "", "a", "日本", None, "x" * 5000, "b" * 3, "é"]
    for low, high in ((0, 8), (2, 6), (3, 3), (0, 2)):
        got = hashing.fnv1a(pa.array(keys, pa.string())[low:high])
        assert got.tolist() == [fnv((k or "").encode()) for k in keys[low:high]]


def test_acceptance_keys_are_even(spark):
    rows = spark.range(10_000).select(hashing.partition_for(F.concat(F.lit("customer_"), F.col("id") % 500), 4).alias("p")).groupBy("p").count().collect()
    assert {r["p"]: r["count"] for r in rows} == dict.fromkeys(range(4), 2500)


def test_checksum_and_digest(spark):
    r = spark.range(1).select(hashing.checksum(F.lit("123456789")).alias("c"), hashing.digest(F.lit("a")).alias("d"), hashing.json_string(F.lit('a"b\\é')).alias("j")).first()
    assert r["c"] == 3421780262 and r["d"] == hashlib.sha256(b"a").hexdigest() and r["j"] == '"a\\"b\\\\é"'


def test_json_validity(spark):
    cases = {'{"a":1}': True, "1": True, "": False, "{} x": False, "NaN": False, '{"a":1,"a":2}': True, "[1,]": False, '"\\u00e9"': True}
    rows = spark.createDataFrame([(x,) for x in cases], "data string").select("data", jsonsem.is_valid_json("data").alias("ok")).collect()
    assert {r["data"]: r["ok"] for r in rows} == cases
    assert not jsonsem.valid(None)


def test_fingerprint_keeps_literals():
    same = jsonsem.fingerprint_of("t", "k", None, '{"a":1234567890123456789,"b":2}')
    assert same == jsonsem.fingerprint_of("t", "k", {}, '{ "b": 2, "a": 1234567890123456789 }')
    others = [("t", "k", {}, '{"a":1234567890123456790,"b":2}'), ("u", "k", {}, '{"a":1234567890123456789,"b":2}'), ("t", "", {}, '{"a":1234567890123456789,"b":2}'), ("t", "k", {"h": "1"}, '{"a":1234567890123456789,"b":2}'), ("t", "k", {}, '{"a":1234567890123456789,"b":2.0}')]
    assert len({same, *(jsonsem.fingerprint_of(*x) for x in others)}) == 6


def test_json_schema(spark):
    schema = '{"type":"object","required":["id"],"properties":{"id":{"type":"string"},"n":{"minimum":2}}}'
    rows = spark.createDataFrame([('{"id":"a"}',), ('{"id":1}',), ("{}",), ("nope",), ('{"id":"a","n":1}',)], "d string").select(jsonsem.matches_schema(F.col("d"), schema).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False, False, False, False]
    for bad in ('{"$ref":"https://x.example/y"}', '{"dependentSchemas":{}}', "[]"):
        with pytest.raises(ValueError):
            jsonsem.compile_schema(bad)
    ok = jsonsem.compile_schema('{"$defs":{"x":{"type":"integer"}},"items":{"$ref":"#/$defs/x"},"uniqueItems":true}')
    assert not list(jsonsem.errors(ok, [1, 2])) and list(jsonsem.errors(ok, [1, 1])) and list(jsonsem.errors(ok, ["a"]))


def test_backoff_and_retry_after(spark):
    now = dt.datetime(2024, 5, 6, 7, 8, 9)
    day = lambda t: t.strftime("%a, %d %b %Y %H:%M:%S GMT")
    raw = {"60": 60, " 7 ": 7, "9999999999": 3600, "-1": 0, "garbage": 0, "": 0, day(now + dt.timedelta(seconds=90)): 90, day(now - dt.timedelta(hours=1)): 0, (now + dt.timedelta(seconds=30)).strftime("%A, %d-%b-%y %H:%M:%S GMT"): 30, (now + dt.timedelta(seconds=40)).strftime("%a %b %e %H:%M:%S %Y"): 40}
    rows = spark.createDataFrame([(x,) for x in raw], "raw string").select("raw", policy.retry_after(F.col("raw"), F.lit(now)).alias("s")).collect()
    assert {r["raw"]: r["s"] for r in rows} == raw
    r = spark.range(1).select(policy.retry_delay(F.lit(2), F.lit(3)).alias("a"), policy.retry_delay(F.lit(3600), F.lit(20)).alias("b"), policy.retry_delay(F.lit(1), F.lit(1)).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (8, 3600, 1)


def test_classification(spark):
    want = {200: "delivered", 301: "failed", 400: "failed", 401: "failed", 403: "failed", 404: "failed", 408: "retry", 422: "failed", 425: "retry", 429: "retry", 500: "retry", 503: "retry", None: "retry"}
    rows = spark.createDataFrame([(x,) for x in want], "s int").select("s", policy.classify(F.col("s"), F.lit(1), F.lit(3)).alias("one"), policy.classify(F.col("s"), F.lit(3), F.lit(3)).alias("last")).collect()
    assert {r["s"]: r["one"] for r in rows} == want
    assert all(r["last"] == ("delivered" if r["s"] == 200 else "failed") for r in rows)


def test_addresses_and_urls(spark):
    cases = {"127.0.0.1": False, "10.1.2.3": False, "169.254.0.1": False, "::1": False, "::ffff:127.0.0.1": False, "100.100.100.200": False, "2002:7f00:1::": False, "8.8.8.8": True, "2606:4700::1": True, "x": False}
    rows = spark.createDataFrame([(x,) for x in cases], "ip string").select("ip", policy.is_public_ip("ip").alias("ok"), policy.public_ipv4(F.col("ip")).alias("four")).collect()
    assert {r["ip"]: r["ok"] for r in rows} == cases
    assert all(r["four"] == r["ok"] for r in rows if "." in r["ip"] and ":" not in r["ip"])
    urls = {"https://a.example/x": None, "http://a.example": "scheme", "https://127.0.0.1/": "address", "https://u:p@a.example": "credentials", "https://a.example:8080": "port", "https://[::1]/x": "address", "https://[fd00::1]/": "address", "https://[::ffff:10.0.0.1]:443/": "address", "https://[2606:4700::1]/x": None, "https://[2606:4700::1]:80/x": "port", "https://[]/": "scheme", "https://[x]/": "address", "https://a.example:x/": "port", "https:///p": "scheme", "https://a.example:443/": None, "https://a.example/#f": "fragment", "https://a.example/" + "x" * 2048: "length", None: "length"}
    rows = spark.createDataFrame([(x,) for x in urls], "u string").select("u", policy.url_error(F.col("u")).alias("e")).collect()
    assert {r["u"]: r["e"] for r in rows} == urls


def test_addresses_equal_the_library(spark):
    """IPv4 and IPv6 literals of every denied range, their neighbours and random ones, against Python's own parser."""
    r = random.Random(5)
    four, six = set(), {"::", "::1", "1::", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::8.8.8.8", "64:ff9b::1.2.3.4", "2606:4700::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"}
    for net in map(ipaddress.ip_network, policy.DENIED):
        for n in (int(net.network_address), int(net.broadcast_address), int(net.network_address) - 1, int(net.broadcast_address) + 1):
            if 0 <= n < 1 << net.max_prefixlen:
                (four if net.version == 4 else six).add(str(ipaddress.ip_address(n) if net.version == 4 else ipaddress.IPv6Address(n)))
    for _ in range(200):
        six.add(str(ipaddress.IPv6Address(r.getrandbits(128))))
        six.add(ipaddress.IPv6Address(r.getrandbits(128) & ~(0xFFFFFFFFFFFF << r.randrange(80))).exploded)
        four.add(str(ipaddress.IPv4Address(r.getrandbits(32))))
    wrong = ["", ":", ":::", "1::2::3", "12345::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "fe80::1%eth0", "::1.2.3", "::1.2.3.256", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "g::", "1:2:3:4:5:6:7::8"]
    rows = spark.createDataFrame([(x,) for x in [*four, *six, *wrong]], "a string").select("a", policy.public_ipv4(F.col("a")).alias("four"), policy.public_ipv6(F.col("a")).alias("six"), policy.ipv6_groups(F.col("a")).alias("groups")).collect()
    for row in rows:
        assert row["four"] == (row["a"] in four and policy.public_address(row["a"])), row
        assert row["six"] == (row["a"] in six and policy.public_address(row["a"])), row
        assert (row["groups"] is not None) == (row["a"] in six), row
        if row["a"] in six:
            assert sum(g << (112 - 16 * i) for i, g in enumerate(row["groups"])) == int(ipaddress.IPv6Address(row["a"]))


def test_redaction(spark):
    rows = spark.createDataFrame([("s", "secret", {"Authorization": "x", "X-A": "1"})], "id string, secret string, headers map<string,string>")
    r = rows.select(policy.redacted(F.col("headers"), F.array(F.lit("authorization"))).alias("h")).first()
    assert r["h"] == {"Authorization": "***", "X-A": "1"}
    assert policy.without_secrets(rows).collect()[0].asDict() == {"id": "s", "header_names": ["Authorization", "X-A"]}


def test_headers(spark):
    cases = [({"X-A": "1"}, None), ({f"h{i}": "" for i in range(17)}, "count"), ({"a b": "1"}, "name"), ({"a": "é"}, "value"), ({"a": "x\n"}, "value"), ({"Host": "x"}, "reserved"), (dict([(f"X-{S.PREFIX}-b", "1")]), "reserved"), ({"a": "1", "A": "2"}, "duplicate"), ({"a": "x" * 1025}, "size"), ({f"h{i}": "x" * 1000 for i in range(9)}, "total"), ({}, None)]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h map<string,string>").select("i", policy.headers_error(F.col("h")).alias("e"), policy.header_names(F.col("h")).alias("n")).collect()
    assert {r["i"]: r["e"] for r in rows} == {i: e for i, (_, e) in enumerate(cases)}
    r = spark.createDataFrame([({"x-tRace-ID": "1"},)], "h map<string,string>").select(policy.canonical_headers(F.col("h")).alias("h")).first()
    assert r["h"] == {"X-Trace-Id": "1"}


def test_signature_and_secrets(spark):
    want = "v1=da54d054c6c42cc9950b89a9afffe7bcdafff0cea3bd354ab40fe78e1e527905"
    r = spark.createDataFrame([("s" * 32, "1700000000", '{"a":1}')], "a string, b string, c string").select(policy.sign("a", "b", "c").alias("s")).first()
    assert r["s"] == want
    key = bytes(range(32))
    sealed = spark.createDataFrame([("secret",)], "v string").select(policy.encrypt(F.col("v"), key, "headers").alias("e"))
    e = sealed.first()["e"]
    assert spark.createDataFrame([(e,)], "e string").select(policy.decrypt(F.col("e"), key, "headers").alias("v")).first()["v"] == "secret"
    with pytest.raises(Exception):
        spark.createDataFrame([(e,)], "e string").select(policy.decrypt(F.col("e"), key, "other").alias("v")).collect()


def test_names_scopes_and_validation(spark):
    names = {"a": True, "A.b_c-9": True, ".": False, "..": False, "": False, "-a": False, "x" * 128: True, "x" * 129: False, None: False}
    rows = spark.createDataFrame([(x,) for x in names], "n string").select("n", policy.valid_name(F.col("n")).alias("ok")).collect()
    assert {r["n"]: r["ok"] for r in rows} == names
    scopes = [(["admin"], True), (["metrics:read"], True), (["topic:a:produce", "topic:*:read"], True), (["topic:a:write"], False), (["topic:..:read"], False), ([], False), (["x"], False), (["admin"] * 65, False)]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(scopes)], "i int, s array<string>").select("i", policy.valid_scopes(F.col("s")).alias("ok")).collect()
    assert {r["i"]: r["ok"] for r in rows} == {i: ok for i, (_, ok) in enumerate(scopes)}
    inputs = [("t", "k", "", True, 5, None), ("", "k", "", True, 5, "type"), ("é" * 129, "k", "", True, 5, "type"), ("t", "k" * 4097, "", True, 5, "key"), ("t", None, "i" * 257, True, 5, "idempotency_key"), ("t", "k", "", False, 5, "data"), ("t", "k", "", True, 2 << 20, "event_bytes")]
    rows = spark.createDataFrame([(i, *x[:5]) for i, x in enumerate(inputs)], "i int, t string, k string, d string, v boolean, b int")
    found = rows.select("i", policy.publish_error(F.col("t"), F.col("k"), F.lit(None).cast("map<string,string>"), F.col("d"), F.col("v"), F.col("b")).alias("e")).collect()
    assert {r["i"]: r["e"] for r in found} == {i: x[5] for i, x in enumerate(inputs)}
