"""Schemas, limits, fixed names and errors of the event log."""

from __future__ import annotations

from pyspark.sql import types as T

#: Prefix of the header and type names that carry meaning; another deployment may set its own.
PREFIX = "tidelog"
FAILURE_TYPE = f"{PREFIX}.delivery.failed"
DLQ_SUFFIX = ".DLQ"

#: Limits (fixed values that clients rely on).
NAME_PATTERN = r"^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}$"
MAX_TYPE_BYTES, MAX_KEY_BYTES, MAX_HEADERS, MAX_IDEMPOTENCY_BYTES = 256, 4096, 64, 256
MAX_PARTITIONS, MAX_TOPICS = 256, 100
MAX_EVENT_BYTES, MAX_RECORD_BYTES = 1 << 20, 2 << 20
PAGE_ROWS, PAGE_BYTES = 1000, 4 << 20
BATCH_ROWS, REPLAY_ROWS, HISTORY_ROWS = 100, 100, 100
SEGMENT_BYTES, LEAST_SEGMENT_BYTES = 4 << 20, 1024
DEDUP_SECONDS, DEDUP_CAPACITY = 24 * 3600, 4096
MAX_DELIVERIES, MAX_MEMBERS = 8, 256
MAX_DELAY = 3600
LIMITER_KEYS = 10_000
FRAME_BYTES = 8
MIN_FREE_BYTES = 64 << 20
#: Bounds of the publish latency histogram in seconds.
LATENCY_BOUNDS = [0.0001, 0.001, 0.005, 0.01, 0.05, 0.1, 1.0, 10.0]

EVENT = T.StructType(
    [
        T.StructField("workspace", T.StringType(), False),
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("key", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("record_bytes", T.IntegerType()),
    ]
)
FAILURE = "original_event STRUCT<id: STRING, topic: STRING, partition: INT, offset: BIGINT, type: STRING, key: STRING, headers: MAP<STRING, STRING>, data: STRING>, original_topic STRING, original_partition INT, original_offset BIGINT, subscription_id STRING, attempts INT, error STRING, failed_at STRING"


class LogError(Exception):
    """Base of the engine's errors; status is the HTTP status that the same failure has over HTTP."""

    status = 400


class Invalid(LogError):
    status = 400


class Conflict(LogError):
    status = 409


class Fenced(LogError):
    status = 409


class OutOfRange(LogError):
    status = 416


class TooMany(LogError):
    status = 429


class Forbidden(LogError):
    status = 403


class Missing(LogError):
    status = 404


class Unavailable(LogError):
    status = 503


class Corrupt(LogError):
    status = 503
