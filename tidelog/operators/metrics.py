"""Operational metrics: counters (M1, M3), histogram (M2), gauges (M4-M6), rates and quantiles (M10), exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.policy import is_dead_letter


def publish_counters(appends: DataFrame) -> DataFrame:
    """Per workspace and topic: events, bytes, dead letters and seconds of new appends (M1).

    appends: workspace, topic, type, record_bytes, seconds, deduplicated.
    """
    return appends.filter(~F.col("deduplicated")).groupBy("workspace", "topic").agg(F.count("*").alias("events"), F.sum("record_bytes").cast("long").alias("bytes"), F.count_if(is_dead_letter(F.col("topic"), F.col("type"))).alias("dead_letters"), F.sum("seconds").alias("seconds"))


def latency_histogram(appends: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative buckets with sum and count, one row per key and bound (M2): one aggregation, then a row per bound."""
    cells = [F.count_if(F.col("seconds") <= b).alias(f"_b{i}") for i, b in enumerate(S.LATENCY_BOUNDS)]
    wide = appends.groupBy(*keys).agg(*cells, F.count("*").alias("count"), F.sum("seconds").alias("sum"))
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(S.LATENCY_BOUNDS)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket")))
    return wide.select(*keys, "count", "sum", F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.le", "_r.bucket", "sum", "count")


def histogram_quantile(histogram: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The quantile by linear interpolation within its bucket (M10); beyond the last bound, that bound."""
    w = Window.partitionBy(*keys).orderBy("bound")
    rows = histogram.withColumn("bound", F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double")))
    rows = rows.withColumns({"below": F.coalesce(F.lag("bucket").over(w), F.lit(0)), "start": F.coalesce(F.lag("bound").over(w), F.lit(0.0)), "rank": F.col("count") * q})
    hit = rows.filter((F.col("bucket") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | (F.col("start") == 0) & (F.col("rank") == 0)))
    inside = F.col("start") + (F.col("bound") - F.col("start")) * (F.col("rank") - F.col("below")) / F.greatest(F.col("bucket") - F.col("below"), F.lit(1))
    return hit.withColumn("quantile", F.when(F.col("le") == "+Inf", F.col("start")).otherwise(inside)).groupBy(*keys).agg(F.min("quantile").alias("quantile"))


def rates(rows: DataFrame, keys: list[str], window: str, slide: str) -> DataFrame:
    """Events per second in sliding windows of event time."""
    counted = rows.groupBy(*keys, F.window("timestamp", window, slide)).agg(F.count("*").alias("events"))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return counted.select(*keys, F.unix_seconds("window.start").alias("window_start"), "events", (F.col("events") / seconds).alias("rate"))


def workspace_rollup(counters: DataFrame, bounds: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Totals and numbers of topics, partitions, groups and consumers of each workspace (M3)."""
    published = counters.groupBy("workspace").agg(F.sum("events").alias("published"), F.sum("bytes").alias("bytes"), F.sum("dead_letters").alias("dead_letters"))
    active = bounds.groupBy("workspace").agg(F.count_distinct("topic").alias("topics"), F.count("*").alias("partitions"))
    own = groups.groupBy("workspace").agg(F.count("*").alias("groups"))
    live = members.groupBy("workspace").agg(F.count("*").alias("consumers"))
    out = published.join(active, "workspace", "full").join(own, "workspace", "left").join(live, "workspace", "left")
    return out.select("workspace", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("published", "bytes", "dead_letters", "topics", "partitions", "groups", "consumers")])


def pressure(disk: DataFrame, min_free: int = S.MIN_FREE_BYTES) -> DataFrame:
    """1 where the reserve and one record more don't fit."""
    return disk.withColumn("pressure", ((F.col("available_bytes") - min_free) < S.MAX_RECORD_BYTES).cast("int"))


def long_gauges(bounds: DataFrame, lags: DataFrame) -> DataFrame:
    """metric, labels, value of partition and consumer gauges (M4, M5)."""

    def rows(df: DataFrame, labels: list[str], values: dict[str, str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in values.items()])
        pairs = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.col(x).cast("string") for x in labels]))
        return df.select(pairs.alias("labels"), F.explode(cells).alias("_c")).select("_c.metric", "labels", "_c.value")

    own = rows(bounds, ["topic", "partition"], {"broker_disk_bytes": "bytes", "partition_oldest_offset": "oldest", "partition_next_offset": "next", "partition_retained_events": "events"})
    return own.unionByName(rows(lags, ["topic", "group", "partition"], {"consumer_lag": "lag", "consumer_committed_offset": "committed", "consumer_unavailable_events": "unavailable"}))


def exposition(samples: DataFrame) -> DataFrame:
    """Text lines of samples (metric, labels, value), in the order of metric and labels."""
    names = F.array_sort(F.map_keys("labels"))
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    inner = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), quoted(F.element_at("labels", n)))), ",")
    whole = F.when(F.col("value") == F.floor("value"), F.col("value").cast("decimal(38,0)").cast("string")).otherwise(F.col("value").cast("string"))
    line = F.concat("metric", F.when(F.size("labels") > 0, F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(""), F.lit(" "), whole)
    return samples.select("metric", line.alias("line")).orderBy("metric", "line")
