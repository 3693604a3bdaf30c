"""Log views of the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.log import to_log

PARTITIONS, SEGMENT = 4, 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("data"), "event_id", "user_id")


def event_log(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS) -> DataFrame:
    """Topic ``events``: keyed by user, in the order of arrival, numbered day by day."""
    return to_log(event_rows(spark, sf_dir), "events", partitions, ["timestamp", "event_id"], chunk=F.to_date("timestamp"))


def partitions(spark: SparkSession, n: int = PARTITIONS, topic: str = "events") -> DataFrame:
    return spark.range(n).select(F.lit(topic).alias("topic"), F.col("id").cast("int").alias("partition"))


def fnv_sql(key: str) -> str:
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length({key}) + 1), lambda i: ascii({key}[i])::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
LOG = f"""
src AS (SELECT CAST(event_id AS VARCHAR) AS id, ts, CAST(user_id AS VARCHAR) AS key, event_type AS type, props AS data, event_id, user_id FROM events),
keys AS MATERIALIZED (SELECT key, {fnv_sql('key')} AS hash FROM (SELECT DISTINCT key FROM src)),
numbered AS (SELECT src.*, CAST(hash % {PARTITIONS} AS INTEGER) AS partition, hash, CAST(row_number() OVER (PARTITION BY hash % {PARTITIONS} ORDER BY ts, event_id) - 1 AS BIGINT) AS "offset" FROM src JOIN keys USING (key)),
log AS MATERIALIZED (SELECT 'events' AS topic, *, CAST(8 + strlen('{{"id":' || to_json(id) || ',"topic":"events","partition":' || partition || ',"offset":' || "offset" || ',"timestamp":"' || {ISO} || '","type":' || to_json(type) || ',"key":' || to_json(key) || ',"data":' || data || '}}') AS INTEGER) AS record_bytes FROM numbered)"""
#: Segments by recursion: one step an offset.
SEGMENTS = f"""{LOG},
steps AS (SELECT partition, 0::BIGINT AS o, record_bytes::BIGINT AS size, 0 AS seg FROM log WHERE "offset" = 0
 UNION ALL SELECT n.partition, n."offset", CASE WHEN s.size + n.record_bytes > {SEGMENT} THEN n.record_bytes ELSE s.size + n.record_bytes END, CASE WHEN s.size + n.record_bytes > {SEGMENT} THEN s.seg + 1 ELSE s.seg END
 FROM steps s JOIN log n ON n.partition = s.partition AND n."offset" = s.o + 1),
segments AS MATERIALIZED (SELECT s.partition, CAST(min(s.o) AS BIGINT) AS base, CAST(max(s.o) + 1 AS BIGINT) AS next, CAST(sum(l.record_bytes) AS BIGINT) AS size, max(l.ts) AS last FROM steps s JOIN log l ON l.partition = s.partition AND l."offset" = s.o GROUP BY s.partition, s.seg)"""


def with_log(body: str) -> str:
    return f"WITH {LOG} {body}"


def with_segments(body: str) -> str:
    return f"WITH RECURSIVE {SEGMENTS} {body}"
