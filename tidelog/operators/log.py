"""The log itself: routing (P2, P2b), dense offsets (P3, O1), segments (W4), bounds (S5), retention (W5, O3), checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.hashing import partition_for, record_text
from tidelog.operators.fold import micros, sorted_runs


def number_rows(rows: DataFrame, keys: list[str], order: list[str], name: str, chunk: Column | None = None) -> DataFrame:
    """Dense numbers from zero within keys.

    chunk (any expression that doesn't fall along the order, such as the day of arrival) splits long sequences: rows are
    numbered within (keys, chunk), and each chunk starts at the sum of the chunks before it. So no task sorts
    a whole log partition; what is joined has a row for each key and chunk.
    """
    if chunk is None:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    rows = rows.withColumn("_chunk", chunk)
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)) - 1
    return rows.withColumn("_local", local).join(bases, [*keys, "_chunk"]).withColumn(name, (F.col("_base") + F.col("_local")).cast("long")).drop("_chunk", "_base", "_local")


def to_log(rows: DataFrame, topic: str, partitions: int, order: list[str], chunk: Column | None = None, workspace: str = "demo", base: DataFrame | None = None) -> DataFrame:
    """Appends rows (id, timestamp, type, key, data and more) in the given order to an empty or given log.

    Keyed rows go to the key's partition, others round robin. base: partition and next of the log so far.
    """
    rows = rows.withColumns({"workspace": F.lit(workspace), "topic": F.lit(topic)})
    empty = F.coalesce(F.col("key"), F.lit("")) == ""
    keyed = rows.filter(~empty).withColumn("partition", partition_for(F.col("key"), partitions))
    turn = round_robin(rows.filter(empty), partitions, order, chunk)
    log = number_rows(keyed.unionByName(turn), ["topic", "partition"], order, "offset", chunk)
    if base is not None:
        log = log.join(F.broadcast(base.select("partition", F.col("next").alias("_next"))), "partition", "left")  # MAX_PARTITIONS rows at most
        log = log.withColumn("offset", F.col("offset") + F.coalesce("_next", F.lit(0))).drop("_next")
    return with_record_bytes(log)


def round_robin(rows: DataFrame, partitions: int, order: list[str], chunk: Column | None = None) -> DataFrame:
    """Partition = arrival number modulo the partition count."""
    numbered = number_rows(rows, ["workspace", "topic"], order, "_turn", chunk)
    return numbered.withColumn("partition", (F.col("_turn") % partitions).cast("int")).drop("_turn")


def with_record_bytes(log: DataFrame) -> DataFrame:
    text = record_text(*(F.col(x) for x in ("topic", "partition", "offset", "id", "timestamp", "type", "key", "data")))
    return log.withColumn("record_bytes", (F.octet_length(text) + S.FRAME_BYTES).cast("int"))


def segment_starts(log: DataFrame, segment_bytes: int = S.SEGMENT_BYTES) -> DataFrame:
    """topic, partition, base, next, size, last: a segment ends where the next record would pass segment_bytes.

    The sum resets at every segment, so it is a fold over each partition: one search in a running sum for a segment.
    """
    if segment_bytes < S.LEAST_SEGMENT_BYTES:
        raise S.Invalid(f"segments have {S.LEAST_SEGMENT_BYTES} bytes at least")

    schema = "topic string, partition int, base long, next long, size long, last timestamp"
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def rows(found: list[list], time: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate([*kinds, time])], names=["topic", "partition", "base", "next", "size", "last"])

    def run(batches):
        now = None  # the open segment: topic, partition, base, next, size, last
        for batch in batches:
            out, time = [], micros(batch.column("timestamp"))
            offsets, sizes = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("offset", "record_bytes"))
            total = np.append(0, np.cumsum(sizes))
            for key, i, end in sorted_runs(batch, ["topic", "partition"]):
                if now is None or (now[0], now[1]) != key:
                    out += [now] if now else []
                    now = [*key, int(offsets[i]), int(offsets[i]), 0, 0]
                while i < end:
                    if now[4] and now[4] + sizes[i] > segment_bytes:
                        out.append(now)
                        now = [*key, int(offsets[i]), int(offsets[i]), 0, 0]
                    fits = int(np.searchsorted(total, total[i] + segment_bytes - now[4], "right")) - 1
                    last = min(end, max(i + (not now[4]), fits))  # an empty segment takes any record
                    now[3], now[4], now[5] = int(offsets[last - 1]) + 1, int(now[4] + total[last] - total[i]), int(time[last - 1])
                    i = last
            kind = batch.column("timestamp").type
            if out:
                yield rows(out, kind)
        if now:
            yield rows([now], kind)

    columns = log.select("topic", "partition", "offset", "record_bytes", "timestamp")
    return columns.repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset").mapInArrow(run, schema)


def bounds(log: DataFrame, partitions: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """oldest, next, events, bytes (and segments) of each row of partitions: topic, partition, and next and floor if known.

    An empty partition keeps its high watermark: next and floor come from the manifest.
    """
    found = log.groupBy("topic", "partition").agg(F.min("offset").alias("_oldest"), (F.max("offset") + 1).alias("_next"), F.count("*").alias("events"), F.sum("record_bytes").cast("long").alias("bytes"))
    zero = F.lit(0).cast("long")
    known = [F.col("next") if "next" in partitions.columns else zero, F.col("floor") if "floor" in partitions.columns else zero]
    joined = partitions.join(found, ["topic", "partition"], "left")
    out = joined.select("topic", "partition", F.coalesce("_oldest", F.greatest(*known)).alias("oldest"), F.greatest(F.coalesce("_next", zero), known[0]).alias("next"), F.coalesce("events", zero).alias("events"), F.coalesce("bytes", zero).alias("bytes"))
    if segments is not None:
        n = segments.groupBy("topic", "partition").agg(F.count("*").alias("segments"))
        out = out.join(n, ["topic", "partition"], "left").withColumn("segments", F.coalesce("segments", F.lit(1)).cast("long"))
    return out


def retained(segments: DataFrame, now: Column, seconds: int = 0, total_bytes: int = 0, partitions: int = 1, pinned: DataFrame | None = None) -> DataFrame:
    """Segments with dropped: the longest prefix that is expired or oversize, sealed and not pinned.

    pinned: topic, partition, offset of prepared appends; a segment with one at or before its end stays.
    """
    own = Window.partitionBy("topic", "partition").orderBy("base")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("topic", "partition")
    rows = segments
    if pinned is not None:
        rows = rows.join(pinned.groupBy("topic", "partition").agg(F.min("offset").alias("_pin")), ["topic", "partition"], "left")
    else:
        rows = rows.withColumn("_pin", F.lit(None).cast("long"))
    remaining = F.sum("size").over(whole) - F.coalesce(F.sum("size").over(before), F.lit(0))
    expired = (F.unix_micros(now) - F.unix_micros("last") >= seconds * 1_000_000) if seconds else F.lit(False)
    oversize = (remaining > total_bytes // partitions) if total_bytes else F.lit(False)
    sealed = F.lead("base").over(own).isNotNull()
    ok = (expired | oversize) & sealed & ~F.coalesce(F.col("_pin") < F.col("next"), F.lit(False))
    rows = rows.withColumn("_ok", ok.cast("int"))
    return rows.withColumn("dropped", F.min("_ok").over(own.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok", "_pin")


def apply_retention(log: DataFrame, segments: DataFrame) -> DataFrame:
    """The log without dropped segments; offsets stay as they are."""
    floor = segments.filter("dropped").groupBy("topic", "partition").agg(F.max("next").alias("_floor"))
    return log.join(floor, ["topic", "partition"], "left").filter(F.col("_floor").isNull() | (F.col("offset") >= F.col("_floor"))).drop("_floor")


def gaps(log: DataFrame, chunk_rows: int = 1 << 20) -> DataFrame:
    """Rows whose offset doesn't follow the one before in their partition (O2).

    Offsets are looked at in chunks of chunk_rows, so no task sorts a whole partition; a chunk's first row follows the
    last one of the chunk before, which a table of a row for each chunk knows.
    """
    keys = ["topic", "partition"]
    rows = log.withColumn("_chunk", F.floor(F.col("offset") / chunk_rows))
    ends = rows.groupBy(*keys, "_chunk").agg(F.max("offset").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_end")
    local = F.lag("offset").over(Window.partitionBy(*keys, "_chunk").orderBy("offset"))
    found = rows.withColumn("previous", local).filter(F.col("previous").isNull() | (F.col("offset") != F.col("previous") + 1))
    found = found.join(ends, [*keys, "_chunk"]).withColumn("previous", F.coalesce("previous", "_before")).drop("_chunk", "_before")
    return found.filter(F.col("previous").isNotNull() & (F.col("offset") != F.col("previous") + 1))


def damage(segments: DataFrame) -> DataFrame:
    """Segments (topic, partition, base, next, torn, corrupt) that recovery must refuse, and why.

    A torn tail is tolerated in the last segment only; bases must follow on.
    """
    w = Window.partitionBy("topic", "partition").orderBy("base")
    rows = segments.withColumns({"_previous": F.lag("next").over(w), "_last": F.lead("base").over(w).isNull()})
    why = F.when(F.col("corrupt"), "checksum").when(F.col("torn") & ~F.col("_last"), "torn before the end").when(F.col("_previous").isNotNull() & (F.col("base") != F.col("_previous")), "segments don't follow on")
    return rows.withColumn("damage", why).filter(F.col("damage").isNotNull()).drop("_previous", "_last")
