"""Structured Streaming: live tail (S4), appends (W1), exact deduplication (P4), rollups (M8), windowed counts (an extension)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog import schema as S


#: Streams that a service serves at once, in all and of a workspace; events of one page; seconds of silence before a heartbeat.
MOST_STREAMS, MOST_STREAMS_OF_WORKSPACE, TAIL_PAGE, HEARTBEAT = 64, 16, 100, 10.0


def start_offset(bounds: dict[int, tuple[int, int]], partition: int, offset: int | None = None, last_id: int | None = None) -> int:
    """Where a tail begins: behind the last event seen, else at the offset asked for, else at the end.

    bounds: (oldest, next) of each partition.
    """
    if partition not in bounds:
        raise S.OutOfRange("no such partition")
    oldest, latest = bounds[partition]
    at = latest if offset is None else offset
    if last_id is not None:
        if not 0 <= last_id < (1 << 63) - 1:
            raise S.OutOfRange("no such event")
        at = last_id + 1
    if not oldest <= at <= latest:
        raise S.OutOfRange(f"offsets must be within [{oldest}, {latest}]")
    return at


def admit_stream(open_streams: dict[str, int], workspace: str) -> None:
    """Refuses a stream beyond the bounds (S4). open_streams: how many each workspace has."""
    if sum(open_streams.values()) >= MOST_STREAMS or open_streams.get(workspace, 0) >= MOST_STREAMS_OF_WORKSPACE:
        raise S.TooMany("stream connection limit")


def tail(spark: SparkSession, path: str, offsets: dict[int, int], kind: str = "", files_per_trigger: int = 100) -> DataFrame:
    """Events from each partition's offset (start_offset) on, as they are written; the checkpoint holds the cursor.

    Partitions that offsets leaves out aren't followed; no offsets at all mean the whole log.
    """
    rows = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(path)
    if offsets:
        start = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
        rows = rows.filter(F.col("offset") >= F.element_at(start, F.col("partition")))
    return rows.filter(F.col("type") == kind) if kind else rows


def frames(rows: DataFrame) -> DataFrame:
    """Server-sent frames of a partition's events: the id is what a client resumes behind."""
    from tidelog.functions.hashing import record_text

    text = record_text(*(F.col(x) for x in ("topic", "partition", "offset", "id", "timestamp", "type", "key", "data")))
    return rows.select("partition", "offset", F.concat(F.lit("id: "), F.col("offset").cast("string"), F.lit("\ndata: "), text, F.lit("\n\n")).alias("frame"))


def follow(read: Callable[[int, int], list[dict]], offset: int, kind: str = "", wait: Callable[[float], bool] = lambda s: False, running: Callable[[], bool] = lambda: True) -> Iterator[dict | None]:
    """Events of one partition from offset on, a page of TAIL_PAGE at a time; None is a heartbeat.

    read(offset, limit) gives a page; wait(seconds) says whether something came in that time. The type is
    matched after the page is cut, so the cursor also passes events of other types.
    """
    while running():
        page = read(offset, TAIL_PAGE)
        for event in page:
            offset = event["offset"] + 1
            if not kind or event["type"] == kind:
                yield event
        if not page and not wait(HEARTBEAT):
            yield None


def append(rows: DataFrame, publish: Callable[[DataFrame, str], object], checkpoint: str, query: str):
    """Publishes each micro-batch under a name of its own, so a retried one is no duplicate."""
    return rows.writeStream.queryName(query).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: publish(df, f"{query}-{n}")).trigger(availableNow=True).start()


VERDICTS = "workspace string, topic string, idempotency_key string, id string, timestamp timestamp, verdict string, receipt_id string"


def dedup(rows: DataFrame, seconds: int = S.DEDUP_SECONDS) -> DataFrame:
    """Verdict of each row like the batch operator's: receipts anchored at the accepted event, with conflicts.

    rows: workspace, topic, idempotency_key, id, timestamp, fingerprint. Rows without a key are accepted and touch no
    state. State is one receipt a key. The watermark is on the time of arrival, not the event's: so no row is ever too late
    for a verdict, and a key's state goes when it has been quiet for so long. Rows of a key are ordered within a
    micro-batch; the log delivers them in order.
    """
    names = ["workspace", "topic", "idempotency_key", "id", "timestamp"]

    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, fingerprint, own = state.get if state.exists else (None, None, None)
        rows, out = pd.concat(list(batches)).sort_values(["timestamp", "id"]), []
        for now, print_, event in zip(rows["timestamp"].map(lambda t: t.timestamp()), rows["fingerprint"], rows["id"]):
            if at is not None and now - at < seconds:
                out.append(("deduplicated" if print_ == fingerprint else "conflict", own))
            else:
                at, fingerprint, own = now, print_, event
                out.append(("accepted", event))
        rows[["verdict", "receipt_id"]] = out
        state.update((at, fingerprint, own))
        state.setTimeoutTimestamp(max(int(rows["_arrival"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + seconds * 1000)
        yield rows[[*names, "verdict", "receipt_id"]]

    keyless = F.coalesce("idempotency_key", F.lit("")) == ""
    free = rows.filter(keyless).select(*names, F.lit("accepted").alias("verdict"), F.col("id").alias("receipt_id"))
    keyed = rows.filter(~keyless).withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", "0 seconds").groupBy("workspace", "topic", "idempotency_key")
    judged = keyed.applyInPandasWithState(judge, VERDICTS, "at double, fingerprint string, id string", "append", GroupStateTimeout.EventTimeTimeout)
    return judged.unionByName(free)


def rollup(history: DataFrame, within: str = "1 day") -> DataFrame:
    """Outcome counts of history records, each (subscription, event, attempt, status) once (update mode)."""
    key = ["subscription_id", "event_id", "attempt", "status"]
    fresh = history.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(key)
    s = F.col("status")
    return fresh.groupBy("workspace").agg(F.count_if(s == "delivered").alias("delivered"), F.count_if(s.isin("retry", "failed")).alias("failed"), F.count_if(s == "unknown").alias("unknown"), F.count_if(s == "dlq").alias("dead_letters"))


def windowed_counts(rows: DataFrame, window: str, lateness: str) -> DataFrame:
    """Events by type and event-time window. An extension: the log itself knows no event-time windows."""
    return rows.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", window), "type").agg(F.count("*").alias("events"))
