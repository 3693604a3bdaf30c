"""Validation and delivery policy as column expressions."""

from __future__ import annotations

import base64
import hashlib
import hmac
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import schema as S


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(S.NAME_PATTERN) & ~name.isin(".", ".."), F.lit(False))


def publish_error(kind: Column, key: Column, headers: Column, idempotency_key: Column, data_valid: Column, event_bytes: Column, max_event_bytes: int = S.MAX_EVENT_BYTES) -> Column:
    """Why an input is refused, or null."""
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    return (
        F.when(~size(kind).between(1, S.MAX_TYPE_BYTES), "type")
        .when(size(key) > S.MAX_KEY_BYTES, "key")
        .when(F.coalesce(F.size(headers), F.lit(0)) > S.MAX_HEADERS, "headers")
        .when(size(idempotency_key) > S.MAX_IDEMPOTENCY_BYTES, "idempotency_key")
        .when(~F.coalesce(data_valid, F.lit(False)), "data")
        .when(event_bytes > max_event_bytes, "event_bytes")
    )


def is_dead_letter(topic: Column, kind: Column) -> Column:
    return topic.endswith(S.DLQ_SUFFIX) & (kind == S.FAILURE_TYPE)


#: Header names that a subscription can't set (fixed values of HTTP), and prefixes.
RESERVED_HEADERS = ["host", "content-type", "content-length", "content-encoding", "connection", "transfer-encoding", "trailer", "te", "upgrade", "expect", "proxy-authorization", "proxy-authenticate", "forwarded", "user-agent"]
RESERVED_PREFIXES = [f"x-{S.PREFIX}-", "x-forwarded-"]


def headers_error(headers: Column) -> Column:
    """Why custom delivery headers are refused, or null."""
    names, values = F.map_keys(headers), F.map_values(headers)
    lower = F.transform(names, F.lower)
    total = F.aggregate(F.map_entries(headers), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    reserved = lambda n: n.isin(RESERVED_HEADERS) | n.startswith(RESERVED_PREFIXES[0]) | n.startswith(RESERVED_PREFIXES[1])
    return (
        F.when(F.size(headers) > 16, "count")
        .when(~F.forall(F.map_entries(headers), lambda e: F.octet_length(e["key"]).between(1, 64) & (F.octet_length(e["value"]) <= 1024)), "size")
        .when(~F.forall(names, lambda n: n.rlike(r"^[a-zA-Z0-9!#$%&'*+.^_`|~-]+$")), "name")
        .when(~F.forall(values, lambda v: v.rlike(r"\A[\t\x20-\x7e]*\z")), "value")
        .when(F.exists(lower, reserved), "reserved")
        .when(F.size(F.array_distinct(lower)) < F.size(lower), "duplicate")
        .when(total > 8192, "total")
    )


def header_names(headers: Column) -> Column:
    return F.array_sort(F.map_keys(headers))


def canonical_headers(headers: Column) -> Column:
    """Names in canonical case: each part between hyphens begins with a capital."""
    return F.transform_keys(headers, lambda k, _: F.array_join(F.transform(F.split(k, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 64)))), "-"))


def retry_delay(seconds: Column, attempt: Column) -> Column:
    """min(seconds doubled attempt - 1 times, one hour), in seconds."""
    return F.least(seconds * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(32))), F.lit(float(S.MAX_DELAY))).cast("long")


def retry_after(raw: Column, now: Column) -> Column:
    """Seconds or one of HTTP's three date formats, held to 0..3600; anything else is 0."""
    text = F.trim(raw)
    seconds = text.try_cast("bigint")
    dates = [
        F.try_to_timestamp(F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(F.regexp_replace(F.regexp_extract(text, r"^[A-Za-z]+, (\d{2}-[A-Za-z]{3}-\d{2} \d{2}:\d{2}:\d{2}) GMT$", 1), "-", " "), F.lit("dd MMM yy HH:mm:ss")),
        F.try_to_timestamp(F.regexp_replace(F.regexp_extract(text, r"^[A-Za-z]{3} ([A-Za-z]{3} [ \d]\d \d{2}:\d{2}:\d{2} \d{4})$", 1), "  ", " 0"), F.lit("MMM dd HH:mm:ss yyyy")),
    ]
    until = F.unix_seconds(F.coalesce(*dates)) - F.unix_seconds(now)
    return F.greatest(F.lit(0), F.least(F.lit(S.MAX_DELAY), F.coalesce(seconds, until, F.lit(0)))).cast("long")


def classify(http_status: Column, attempt: Column, max_attempts: Column) -> Column:
    """Outcome of an attempt; a null status is a transport error (D3)."""
    again = http_status.isNull() | http_status.isin(408, 425, 429) | (http_status >= 500)
    return F.when(http_status.between(200, 299), "delivered").when(~again, "failed").when(attempt >= max_attempts, "failed").otherwise("retry")


def next_delay(http_status: Column, seconds: Column, attempt: Column, raw_retry_after: Column, now: Column) -> Column:
    """Backoff, or the receiver's wish if that is later and the status is 429 or 503."""
    own = retry_delay(seconds, attempt)
    return F.when(http_status.isin(429, 503), F.greatest(own, retry_after(F.coalesce(raw_retry_after, F.lit("")), now))).otherwise(own)


#: Ranges that aren't public (fixed values of the address registries).
DENIED = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::/96", "::1/128", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8"]
_NETWORKS = [ipaddress.ip_network(x) for x in DENIED]


def public_address(raw: str | None) -> bool:
    try:
        ip = ipaddress.ip_address((raw or "").strip("[]"))
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not any(ip.version == n.version and ip in n for n in _NETWORKS)


@F.pandas_udf(T.BooleanType())
def is_public_ip(raw: pd.Series) -> pd.Series:
    return raw.map(public_address)


_DOTTED = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _denied_ipv4(n: Column) -> Column:
    inside = F.lit(False)
    for net in (n for n in _NETWORKS if n.version == 4):
        inside = inside | n.between(int(net.network_address), int(net.broadcast_address))
    return inside


def public_ipv4(raw: Column) -> Column:
    """The same for dotted IPv4 without Python: ranges of integers."""

    def number(parts):
        return sum((F.element_at(parts, k + 1).try_cast("long") * (1 << 8 * (3 - k)) for k in range(1, 4)), F.element_at(parts, 1).try_cast("long") * (1 << 24))

    inside = let(number(F.split(raw, r"\.")), _denied_ipv4)
    return F.coalesce(F.when(raw.rlike(f"^{_DOTTED}$"), ~inside), F.lit(False))


def ipv6_groups(raw: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 literal, null if it is none. A zone makes it none."""
    tail = F.regexp_extract(raw, rf":({_DOTTED})$", 1)
    pair = lambda x, i: F.hex(F.element_at(x, i).cast("long") * 256 + F.element_at(x, i + 1).cast("long"))
    dotted = F.transform(F.split(tail, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    text = F.when(tail != "", F.concat(F.substring(raw, F.lit(1), F.length(raw) - F.length(tail)), pair(dotted, 1), F.lit(":"), pair(dotted, 3))).otherwise(raw)

    def expand(text):
        groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
        sides = F.split(text, "::", -1)
        left, right = groups(F.element_at(sides, 1)), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        missing = F.lit(8) - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        ok = text.rlike(r"^[0-9a-fA-F:]{2,39}$") & ~text.rlike(r"[0-9a-fA-F]{5}|:::|^:[^:]|[^:]:$") & F.when(F.size(sides) == 1, missing == 0).otherwise((F.size(sides) == 2) & (missing >= 1))
        return F.when(ok, F.transform(whole, lambda g: F.conv(g, 16, 10).cast("int")))

    return let(text, expand)


def public_ipv6(raw: Column) -> Column:
    """The same for IPv6; an address that holds an IPv4 one is judged by it."""

    def judge(g):
        at = lambda i: F.element_at(g, i + 1)
        denied = F.lit(False)
        for net in (n for n in _NETWORKS if n.version == 6):
            value, whole = int(net.network_address), net.prefixlen // 16
            inside = F.lit(True)
            for i in range(whole):
                inside = inside & (at(i) == (value >> (112 - 16 * i)) & 0xFFFF)
            if rest := net.prefixlen % 16:
                inside = inside & (F.shiftright(at(whole), 16 - rest) == ((value >> (112 - 16 * whole)) & 0xFFFF) >> (16 - rest))
            denied = denied | inside
        mapped = (at(5) == 0xFFFF) & (at(0) + at(1) + at(2) + at(3) + at(4) == 0)
        return F.when(mapped, ~_denied_ipv4(at(6).cast("long") * 65536 + at(7))).otherwise(~denied)

    return F.coalesce(let(ipv6_groups(raw), lambda g: F.when(g.isNotNull(), judge(g))), F.lit(False))


def url_error(url: Column) -> Column:
    """Why a delivery URL is refused, or null (P18); literal hosts must be public addresses."""

    def judge(authority):
        host = F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)
        port = F.regexp_extract(authority, r":(\d*)$", 1)
        other = F.regexp_extract(authority, r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:]*)(.*)$", 1)

        def of(host):
            address = F.when(host.startswith("["), ~public_ipv6(F.substring(host, F.lit(2), F.length(host) - 2))).when(host.rlike(r"^[\d.]+$"), ~public_ipv4(host)).otherwise(F.lit(False))
            return (
                F.when(~F.lower(url).startswith("https://") | host.isin("", "[]"), "scheme")
                .when(authority.contains("@"), "credentials")
                .when(url.contains("#"), "fragment")
                .when(~port.isin("", "443") | ~other.rlike(r"^(:\d*)?$"), "port")
                .when(address, "address")
            )

        return let(host, of)

    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.when(url.isNull() | (F.octet_length(url) > 2048), "length").otherwise(let(authority, judge))


def redacted(headers: Column, names: Column) -> Column:
    """Headers whose named values (in any case) are replaced: what is shown instead of secrets."""
    lower = F.transform(names, F.lower)
    return F.transform_values(headers, lambda k, v: F.when(F.array_contains(lower, F.lower(k)), F.lit("***")).otherwise(v))


def without_secrets(rows, secret: tuple[str, ...] = ("secret", "headers", "encrypted_secret", "encrypted_headers", "password_hash", "key_hash", "token_hash")):
    """A table as it may be answered: columns that hold secrets are left out, header names stay."""
    shown = rows.withColumn("header_names", header_names(F.col("headers"))) if "headers" in rows.columns and "header_names" not in rows.columns else rows
    return shown.drop(*[c for c in secret if c in shown.columns])


@F.pandas_udf(T.StringType())
def sign(secret: pd.Series, timestamp: pd.Series, payload: pd.Series) -> pd.Series:
    """HMAC-SHA256 of ``timestamp.payload`` (P20)."""
    return pd.Series([signature(a, b, c) for a, b, c in zip(secret, timestamp, payload)])


def signature(secret: str, timestamp: str, payload: str) -> str:
    return "v1=" + hmac.new(secret.encode(), f"{timestamp}.{payload}".encode(), hashlib.sha256).hexdigest()


def parse_key(raw: str) -> bytes:
    key = base64.b64decode(raw, validate=True)
    if len(key) != 32:
        raise S.Invalid("the key must be 32 bytes")
    return key


def encrypt(value: Column, key: bytes, purpose: str) -> Column:
    """AES-256-GCM, nonce first, with the purpose as associated data; base64."""
    return F.base64(F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 24)), F.lit(purpose)))


def decrypt(value: Column, key: bytes, purpose: str) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(purpose)).cast("string")


def allowed(role: Column, scopes: Column, topic: Column, action: Column) -> Column:
    """Scope predicate."""
    own = F.arrays_overlap(scopes, F.array(F.lit("admin"), F.concat(F.lit("topic:"), topic, F.lit(":"), action), F.concat(F.lit("topic:*:"), action)))
    return F.when(role.isin("owner", "admin"), F.lit(True)).when(role == "developer", action != "admin").when(role == "viewer", action == "read").otherwise(F.coalesce(own, F.lit(False)))


def metrics_allowed(role: Column, scopes: Column) -> Column:
    return role.isin("owner", "admin", "developer", "viewer") | F.coalesce(F.arrays_overlap(scopes, F.array(F.lit("admin"), F.lit("metrics:read"))), F.lit(False))


def valid_scopes(scopes: Column) -> Column:
    """Grammar of a key's scopes, 1 to 64 of them."""

    def one(s):
        parts = F.split(s, ":")
        name = F.get(parts, F.lit(1))
        topic = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "topic") & (valid_name(name) | (name == "*")) & F.get(parts, F.lit(2)).isin("produce", "consume", "read")
        return s.isin("admin", "metrics:read") | F.coalesce(topic, F.lit(False))

    return F.size(scopes).between(1, 64) & F.forall(scopes, one)


def valid_expiry(expires: Column, now: Column) -> Column:
    return (expires > now) & (expires <= now + F.expr("INTERVAL 366 DAYS"))
