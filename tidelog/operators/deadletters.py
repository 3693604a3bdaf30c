"""Dead letters: envelopes (D5), parsing (P14), listing (X1, J6), resolution (X2) and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.policy import valid_name

PLACE = ["workspace", "topic", "partition", "offset"]


def envelopes(failed: DataFrame) -> DataFrame:
    """Inputs for the dead-letter topics: one partition, keyed by the event's id.

    failed: an event's columns with subscription_id, attempts, error, failed_at (text).
    """
    original = F.struct("id", "topic", "partition", "offset", "type", "key", F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")).alias("headers"), "data")
    body = F.to_json(F.struct(original.alias("original_event"), F.col("topic").alias("original_topic"), F.col("partition").alias("original_partition"), F.col("offset").alias("original_offset"), "subscription_id", "attempts", "error", "failed_at"))
    return failed.select(F.concat("topic", F.lit(S.DLQ_SUFFIX)).alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("key"), F.lit(S.FAILURE_TYPE).alias("type"), body.alias("data"))


def parse(events: DataFrame) -> DataFrame:
    """Adds failure (a struct, null if malformed) and malformed to dead-letter events.

    Every rule counts: suffix, type, JSON shape, agreement with the original event, valid id, signs.
    """
    f = F.from_json("data", S.FAILURE, {"mode": "PERMISSIVE"})
    rows = events.withColumn("_f", f)
    g = lambda x: F.col(f"_f.{x}")
    ok = (
        F.col("topic").endswith(S.DLQ_SUFFIX) & (F.col("type") == S.FAILURE_TYPE) & g("original_event").isNotNull()
        & (g("original_topic") == F.expr(f"substring(topic, 1, length(topic) - {len(S.DLQ_SUFFIX)})")) & (g("original_event.topic") == g("original_topic"))
        & (g("original_event.partition") == g("original_partition")) & (g("original_event.offset") == g("original_offset")) & valid_name(g("original_event.id"))
        & (g("original_partition") >= 0) & (g("original_offset") >= 0) & (F.coalesce(g("original_event.type"), F.lit("")) != "") & g("original_event.data").isNotNull()
        & (g("attempts") >= 1) & (F.coalesce(g("subscription_id"), F.lit("")) != "")
    )
    ok = F.coalesce(ok, F.lit(False))
    return rows.withColumn("failure", F.when(ok, F.col("_f"))).withColumn("malformed", ~ok).drop("_f")


def listed(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Parsed dead letters with their decisions, if any."""
    return parse(events).join(decisions.select(*PLACE, "action", "status"), PLACE, "left")


def resolve(events: DataFrame, decisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Verdict of each wanted decision (place, action, actor): done before, conflict, malformed, missing or pending."""
    known = decisions.select(*PLACE, F.col("action").alias("decided"))
    there = parse(events).select(*PLACE, "failure", "malformed")
    rows = wanted.join(there, PLACE, "left").join(known, PLACE, "left")
    verdict = F.when(F.col("malformed").isNull(), "missing").when(F.col("malformed"), "malformed").when(F.col("decided") == F.col("action"), "done before").when(F.col("decided").isNotNull(), "conflict").otherwise("pending")
    return rows.withColumn("verdict", verdict)


def retries(events: DataFrame) -> DataFrame:
    """Inputs that republish parsed dead letters: the original with provenance headers."""
    p = f"{S.PREFIX}.dlq."
    e = lambda x: F.col(f"failure.original_event.{x}")
    own = F.create_map(F.lit(p + "source_id"), F.col("id"), F.lit(p + "original_id"), e("id"), F.lit(p + "source_offset"), F.col("offset").cast("string"), F.lit(p + "source_partition"), F.col("partition").cast("string"))
    kept = F.map_filter(F.coalesce(e("headers"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*[p + x for x in ("source_id", "original_id", "source_offset", "source_partition")]))
    return events.filter("failure is not null").select(F.col("failure.original_topic").alias("target"), "id", "offset", e("type").alias("type"), e("key").alias("key"), e("data").alias("data"), F.map_concat(kept, own).alias("headers"))


def next_pending(decisions: DataFrame) -> DataFrame:
    """The first decision that isn't complete."""
    return decisions.filter(F.col("status") == "pending").orderBy(*PLACE).limit(1)
