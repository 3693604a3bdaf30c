"""Replay (W7) and prepared appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.hashing import json_string


def replay_key(replay_id: Column, topic: Column, partition: Column, offset: Column, event_id: Column) -> Column:
    """Derived idempotency key: a retry of the same replay is deduplicated, another replay copies anew."""
    identity = F.concat(F.lit("["), json_string(replay_id), F.lit(","), json_string(topic), F.lit(","), partition.cast("string"), F.lit(","), offset.cast("string"), F.lit(","), json_string(event_id), F.lit("]"))
    return F.concat(F.lit("replay-"), F.sha2(identity, 256))


def replay(events: DataFrame, replay_id: str, target: str) -> DataFrame:
    """Inputs for the target topic: same type, key and data, provenance headers (which overwrite), derived key."""
    p = f"{S.PREFIX}.replay."
    own = F.create_map(
        F.lit(p + "id"), F.lit(replay_id), F.lit(p + "source_id"), F.col("id"), F.lit(p + "source_topic"), F.col("topic"),
        F.lit(p + "source_partition"), F.col("partition").cast("string"), F.lit(p + "source_offset"), F.col("offset").cast("string"),
    )
    kept = F.map_filter(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*[p + x for x in ("id", "source_id", "source_topic", "source_partition", "source_offset")]))
    key = replay_key(F.lit(replay_id), F.col("topic"), F.col("partition"), F.col("offset"), F.col("id"))
    return events.select(F.lit(target).alias("target"), F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), F.col("id").alias("source_id"), "timestamp", "type", "key", "data", F.map_concat(kept, own).alias("headers"), key.alias("idempotency_key"))


def reserve(inputs: DataFrame, bounds: DataFrame, order: list[str], chunk: Column | None = None) -> DataFrame:
    """Prepared appends: the places that inputs (topic, partition, id and more) will have, by order behind the log's end.

    bounds: topic, partition, next. The rows are kept as pending before anything is appended; recover() says later what
    became of each, and complete() drops those that are in the log.
    """
    from tidelog.operators.log import number_rows

    ends = bounds.select("topic", "partition", "next")
    rows = number_rows(inputs, ["topic", "partition"], order, "_n", chunk).join(F.broadcast(ends), ["topic", "partition"])  # MAX_PARTITIONS rows a topic
    return rows.withColumn("offset", F.col("next") + F.col("_n")).drop("_n", "next")


def append_prepared(pending: DataFrame, log: DataFrame, bounds: DataFrame) -> DataFrame:
    """pending's rows that are to be appended at their places; raises when read if one's place is taken by another event."""
    rows = recover(pending.join(F.broadcast(bounds.select("topic", "partition", "next")), ["topic", "partition"]), log, following=True)
    action = F.when(F.col("action") == "conflict", F.raise_error(F.concat(F.lit("place taken: "), F.col("offset").cast("string")))).otherwise(F.col("action"))
    return rows.withColumn("action", action).filter("action = 'append'").drop("action", "next")


def complete(pending: DataFrame, log: DataFrame) -> DataFrame:
    """pending without what the log has."""
    return pending.join(log.select("topic", "partition", "offset", "id"), ["topic", "partition", "offset", "id"], "left_anti")


def recover(pending: DataFrame, log: DataFrame, following: bool = False) -> DataFrame:
    """What to do with each prepared append: complete, append or conflict (W8, J8). following: places behind the end count too.

    pending: topic, partition, offset, id, fingerprint, next (the partition's high watermark). log: the same places' id and fingerprint.
    """
    there = log.select("topic", "partition", "offset", F.col("id").alias("log_id"), F.col("fingerprint").alias("log_fingerprint"))
    joined = pending.join(there, ["topic", "partition", "offset"], "left")
    same = (F.col("id") == F.col("log_id")) & (F.col("fingerprint") == F.col("log_fingerprint"))
    action = F.when(F.col("log_id").isNotNull(), F.when(same, "complete").otherwise("conflict")).when(F.col("offset") >= F.col("next") if following else F.col("offset") == F.col("next"), "append").otherwise("conflict")
    return joined.withColumn("action", action).drop("log_id", "log_fingerprint")
