"""Reads: offset pages (S1), filtered scans (S2, P8, P9), drained snapshots (S3), topics (S6), JSONL export (W6), cursors."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S


@dataclass(frozen=True)
class Range:
    """One partition's scan: offsets [offset, end), times [from_time, until_time), exact matches where not empty."""

    partition: int
    offset: int = 0
    end: int | None = None
    limit: int = S.PAGE_ROWS
    from_time: datetime | str | None = None
    until_time: datetime | str | None = None
    type: str = ""
    key: str = ""
    id: str = ""

    def check(self, oldest: int, next_offset: int) -> Range:
        """Raises what the service would; returns the range with its end."""
        if not 1 <= self.limit <= S.PAGE_ROWS:
            raise S.Invalid(f"limit must be 1..{S.PAGE_ROWS}")
        if self.from_time is not None and self.until_time is not None and not instant(self.from_time) < instant(self.until_time):
            raise S.Invalid("from must be before until")
        end = next_offset if self.end is None else self.end
        if self.offset < oldest or self.offset > next_offset or end < self.offset or end > next_offset:
            raise S.OutOfRange(f"offsets must be within [{oldest}, {next_offset}]")
        return Range(**{**self.__dict__, "end": end})

    def matches(self) -> Column:
        """What remains a filter after the page is cut."""
        out = F.lit(True)
        for name in ("type", "key", "id"):
            if value := getattr(self, name):
                out = out & (F.col(name) == value)
        if self.from_time is not None:
            out = out & (F.col("timestamp") >= F.lit(self.from_time).cast("timestamp"))
        if self.until_time is not None:
            out = out & (F.col("timestamp") < F.lit(self.until_time).cast("timestamp"))
        return out


def instant(value: datetime | str) -> datetime:
    """A time with its zone (UTC if it names none), whatever its spelling; digits beyond microseconds are cut."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", value))
        except ValueError:
            raise S.Invalid(f"no time: {value}") from None
    return value if value.tzinfo else value.replace(tzinfo=UTC)


_RFC3339 = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)")


def parse_range(values: dict[str, str]) -> Range:
    """A Range from a request's query parameters (P11); what doesn't parse is S.Invalid (400).

    partition and offset are required, limit is 100 unless given, end_offset the snapshot's end, times are RFC 3339.
    """
    found: dict = {}
    for name, own, needed in (("partition", "partition", True), ("offset", "offset", True), ("limit", "limit", False), ("end_offset", "end", False)):
        raw = values.get(name, "")
        if raw == "" and not needed:
            continue
        if not re.fullmatch(r"[+-]?\d{1,19}", raw) or not -(1 << 63) <= int(raw) < 1 << 63:
            raise S.Invalid(f"{name} must be a whole number")
        found[own] = int(raw)
    for name in ("from_time", "until_time"):
        if raw := values.get(name, ""):
            if not _RFC3339.fullmatch(raw):
                raise S.Invalid(f"{name} must be RFC 3339")
            found[name] = instant(raw)
    return Range(**{"limit": 100, **found, **{name: values.get(name, "") for name in ("type", "key", "id")}})


def error_status(error: Exception) -> int:
    """The HTTP status of a scan's or replay's failure (P12): the error's own, 400 for anything else."""
    return getattr(error, "status", 400)


def read(log: DataFrame, partition: int, offset: int, limit: int, page_bytes: int = S.PAGE_BYTES) -> DataFrame:
    """Up to limit rows from offset, the last one that which reaches page_bytes.

    Offsets are dense but for retention, so limit rows are within the next limit offsets after the first retained; the
    sort is of one page (orderBy and limit), and the byte cap's window is over that page alone.
    """
    page = log.filter((F.col("partition") == partition) & (F.col("offset") >= offset)).orderBy("offset").limit(limit)
    before = F.coalesce(F.sum("record_bytes").over(Window.partitionBy("topic", "partition").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return page.withColumn("_before", before).filter(F.col("_before") < page_bytes).drop("_before")


def scan(log: DataFrame, wanted: Range, page_bytes: int = S.PAGE_BYTES) -> DataFrame:
    """One page: the limit counts scanned rows, the filters come after it."""
    page = read(log if wanted.end is None else log.filter(F.col("offset") < wanted.end), wanted.partition, wanted.offset, wanted.limit, page_bytes)
    return page.filter(wanted.matches())


def cursor(log: DataFrame, wanted: Range, page_bytes: int = S.PAGE_BYTES) -> DataFrame:
    """One row: scanned, matched, next_offset, end_offset, done of the same page (M11). wanted: checked."""
    page = read(log.filter(F.col("offset") < wanted.end), wanted.partition, wanted.offset, wanted.limit, page_bytes)
    out = page.agg(F.count("*").alias("scanned"), F.count_if(wanted.matches()).alias("matched"), (F.coalesce(F.max("offset") + 1, F.lit(wanted.offset))).cast("long").alias("next_offset"))
    return out.withColumns({"end_offset": F.lit(wanted.end).cast("long"), "done": F.col("next_offset") == wanted.end})


def pages(log: DataFrame, ends: DataFrame, limit: int, kind: str = "") -> DataFrame:
    """All partitions drained to a snapshot's ends (topic, partition, next), each row with its page number (S3).

    Dense offsets make the page a division, so no window is needed.
    """
    snapshot = log.join(F.broadcast(ends.select("topic", "partition", F.col("next").alias("_end"))), ["topic", "partition"])  # MAX_PARTITIONS rows a topic
    rows = snapshot.filter(F.col("offset") < F.col("_end")).drop("_end").withColumn("page", F.floor(F.col("offset") / limit).cast("long"))
    return rows.filter(F.col("type") == kind) if kind else rows


def export_jsonl(events: DataFrame) -> DataFrame:
    """One JSON line per event, empty optional fields left out."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    body = F.struct("id", "topic", "partition", "offset", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "type", full("key").alias("key"), F.col("data").alias("data"))
    return events.select("partition", "offset", F.to_json(body).alias("line"))


def topics(config: DataFrame, bounds: DataFrame, workspace: str, principal_allows: Column | None = None) -> DataFrame:
    """A workspace's visible topics by name with their totals."""
    rows = config.filter(F.col("workspace") == workspace)
    if principal_allows is not None:
        rows = rows.filter(principal_allows)
    totals = bounds.groupBy("topic").agg(F.sum("events").alias("events"), F.sum("bytes").alias("bytes"), F.count("*").alias("partitions_seen"))
    return rows.join(totals, rows["name"] == totals["topic"], "left").drop("topic").orderBy("name")
