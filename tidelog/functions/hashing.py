"""Key hashing (P2), digests (P22), checksums (P26) and the canonical record text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits (fixed values).
BASIS, PRIME = 14695981039346656037, 1099511628211


def fnv1a(keys: pa.Array) -> np.ndarray:
    """FNV-1a of the keys' UTF-8 bytes, unsigned; a null key is empty. One pass over the bytes of all keys at each place."""
    raw = keys.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    starts, sizes = ends[:-1], np.diff(ends)
    out = np.full(len(raw), BASIS, np.uint64)
    order = np.argsort(-sizes, kind="stable")  # longer keys first: those that have a byte at a place are in front
    starts, sizes = starts[order], sizes[order]
    h = out[order]
    for place in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -place, "left"))
        h[:n] = (h[:n] ^ text[starts[:n] + place]) * np.uint64(PRIME)
    out[order] = h
    return out


def partition_for(key: Column, partitions: int) -> Column:
    """The unsigned hash modulo the partition count: an Arrow function, as 64 unsigned bits don't fit a long under ANSI."""

    def route(keys: pa.Array) -> pa.Array:
        return pa.array((fnv1a(keys) % np.uint64(partitions)).astype(np.int32))

    route.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(route, "int")(key.cast("string"))


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def checksum(value: Column) -> Column:
    """IEEE CRC-32."""
    return F.crc32(value)


def json_string(value: Column) -> Column:
    """A string as a JSON literal."""
    whole = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("a")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def record_text(topic: Column, partition: Column, offset: Column, event_id: Column, ts: Column, kind: Column, key: Column, data: Column) -> Column:
    """The canonical JSON record; record_bytes is its length plus the frame."""
    parts = [('{"id":', json_string(event_id)), (',"topic":', json_string(topic)), (',"partition":', partition.cast("string")), (',"offset":', offset.cast("string")), (',"timestamp":"', iso(ts)), ('","type":', json_string(kind)), (',"key":', json_string(key)), (',"data":', F.coalesce(data, F.lit("null")))]
    return F.concat(*[x for text, c in parts for x in (F.lit(text), c)], F.lit("}"))
