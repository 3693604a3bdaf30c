"""Framed segments (S7): 4-byte length, 4-byte IEEE CRC-32 (both big-endian), one JSON document a record.

Files are ``<root>/<topic>/<partition>/<base offset, 20 digits>.log``. Reading goes through Spark's binaryFile source, so
any file system that Spark reads will do; a segment is one row of a few megabytes. A Python Data Source offers the
same as ``spark.read.format("framed_log")`` for local folders, one task a segment, and as a stream.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelog import schema as S

_HEAD = struct.Struct(">II")
_PLACE = re.compile(r"([^/]+)/(\d+)/(\d{20})\.log$")
FIELDS = "topic string, partition int, offset long, id string, timestamp string, type string, key string, headers map<string,string>, data string, record_bytes int"


def encode(record: dict) -> bytes:
    body = json.dumps({k: v for k, v in record.items() if v not in (None, "", {})}, ensure_ascii=False, separators=(",", ":")).encode()
    if len(body) > S.MAX_RECORD_BYTES:
        raise S.Invalid("record exceeds 2 MiB")
    return _HEAD.pack(len(body), zlib.crc32(body)) + body


def decode(raw: bytes) -> tuple[list[tuple[dict, int]], str | None]:
    """Records with their framed sizes; then ``torn`` (an unfinished record at the end), ``corrupt`` or None."""
    out, at = [], 0
    while at < len(raw):
        if len(raw) - at < S.FRAME_BYTES:
            return out, "torn"
        size, crc = _HEAD.unpack_from(raw, at)
        if not 0 < size <= S.MAX_RECORD_BYTES:
            return out, "corrupt"
        body = raw[at + S.FRAME_BYTES : at + S.FRAME_BYTES + size]
        if len(body) < size:
            return out, "torn"
        if zlib.crc32(body) != crc:
            return out, "corrupt"
        out.append((json.loads(body), S.FRAME_BYTES + size))
        at += S.FRAME_BYTES + size
    return out, None


def _rows(topic: str, partition: int, raw: bytes) -> Iterator[tuple]:
    for r, size in decode(raw)[0]:
        yield (topic, partition, r.get("offset", 0), r.get("id"), r.get("timestamp"), r.get("type"), r.get("key", ""), r.get("headers") or {}, r.get("data"), size)


def segments(spark: SparkSession, root: str) -> DataFrame:
    """topic, partition, base, next, size, torn, corrupt of every segment file (the input of log.damage, S8)."""
    out = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("base", pa.int64()), ("next", pa.int64()), ("size", pa.int64()), ("torn", pa.bool_()), ("corrupt", pa.bool_())])

    def inspect(batches):
        for batch in batches:
            found = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                topic, partition, base = _PLACE.search(path).groups()
                records, state = decode(raw)
                offsets = [r.get("offset", 0) for r, _ in records]
                dense = offsets == list(range(int(base), int(base) + len(offsets))) and all(r.get("topic", topic) == topic for r, _ in records)
                found.append((topic, int(partition), int(base), int(base) + len(offsets), sum(n for _, n in records), state == "torn", state == "corrupt" or not dense))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(out.types)], schema=out)

    return _files(spark, root).mapInArrow(inspect, "topic string, partition int, base long, next long, size long, torn boolean, corrupt boolean")


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(root).select("path", "content")


def read(spark: SparkSession, root: str, check: bool = True) -> DataFrame:
    """All events under root. check: damage is refused first; only a torn tail of a partition's last segment is let go."""
    if check:
        from tidelog.operators.log import damage

        if bad := damage(segments(spark, root)).head():
            raise S.Corrupt(f"{bad['topic']}/{bad['partition']}/{bad['base']}: {bad['damage']}")
    names = [x.split(" ")[0] for x in FIELDS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32()]

    def parse(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                topic, partition, _ = _PLACE.search(path).groups()
                rows = list(_rows(topic, int(partition), raw))
                columns = [[list(r[i].items()) for r in rows] if n == "headers" else [r[i] for r in rows] for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _files(spark, root).mapInArrow(parse, FIELDS).withColumn("timestamp", F.to_timestamp("timestamp"))


def write(log: DataFrame, root: str, segment_bytes: int = S.SEGMENT_BYTES) -> DataFrame:
    """Writes each partition's segments (W4) below a folder that all executors share; returns what was written.

    A file is written beside its name and then renamed, so a task that runs again replaces what it wrote (W3).
    """
    from tidelog.operators.fold import ordered_fold

    def save(s) -> dict:
        folder = f"{root}/{s['topic']}/{s['partition']}"
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/{s['base']:020d}.log"
        with open(f"{name}.{os.getpid()}.part", "wb") as f:
            f.write(b"".join(s["frames"]))
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{name}.{os.getpid()}.part", name)
        return {"topic": s["topic"], "partition": s["partition"], "base": s["base"], "next": s["next"], "size": s["size"]}

    def begin(row):
        return {"topic": row["topic"], "partition": row["partition"], "base": row["offset"], "next": row["offset"], "size": 0, "frames": []}

    def step(s, row):
        frame = encode({**row, "headers": dict(row["headers"] or [])})
        done = []
        if s["size"] and s["size"] + len(frame) > segment_bytes:
            done = [save(s)]
            s |= {"base": row["offset"], "size": 0, "frames": []}
        s["frames"].append(frame)
        s |= {"next": row["offset"] + 1, "size": s["size"] + len(frame)}
        return done

    rows = log.select("topic", "partition", "offset", "id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "type", "key", "headers" if "headers" in log.columns else F.lit(None).cast("map<string,string>").alias("headers"), "data")
    return ordered_fold(rows, ["topic", "partition"], ["offset"], begin, step, "topic string, partition int, base long, next long, size long", lambda s: [save(s)])


class _Segment(InputPartition):
    def __init__(self, topic: str, partition: int, path: str, last: bool):
        self.topic, self.partition, self.path, self.last = topic, partition, path, last


class FramedLog(DataSource):
    """``format("framed_log").load(root)`` of a local or mounted folder."""

    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        found: dict[tuple[str, int], list[str]] = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if m := _PLACE.search(f"{folder}/{name}"):
                    found.setdefault((m[1], int(m[2])), []).append(f"{folder}/{name}")
        return [_Segment(t, p, path, path == max(paths)) for (t, p), paths in sorted(found.items()) for path in sorted(paths)]

    def read(self, part: _Segment):
        with open(part.path, "rb") as f:
            raw = f.read()
        state = decode(raw)[1]
        if state == "corrupt" or state == "torn" and not part.last:
            raise S.Corrupt(f"{part.path}: {state}")
        yield from _rows(part.topic, part.partition, raw)
