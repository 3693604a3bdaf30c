"""An ordered fold per key, for semantics that no window frame expresses (resetting sums, leases, receipts).

Rows are dealt by key, sorted and streamed; only the current key's state is in memory, so a key may have any number of
rows. A fold is sequential in its key, as the semantics are; keys run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], begin: Callable[[dict], object], step: Callable[[object, dict], list[dict]], schema: str, end: Callable[[object], list[dict]] | None = None) -> DataFrame:
    """begin(row) makes a key's state, step(state, row) changes it and returns rows, end(state) closes it."""
    names = [x.strip().split(" ")[0] for x in _fields(schema)]

    def run(batches):
        own, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != own:
                    if own is not None and end:
                        out += end(state)
                    own, state = key, begin(row)
                out += step(state, row)
            if out:
                yield _batch(out)
        if own is not None and end and (out := end(state)):
            yield _batch(out)

    def _batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], type=types[n]) for n in names], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    parsed = rows.sparkSession.createDataFrame([], schema).schema
    types = {f.name: to_arrow_type(f.dataType, timestamp_utc=True) if "timestamp_utc" in to_arrow_type.__code__.co_varnames else to_arrow_type(f.dataType) for f in parsed}
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, parsed)


def sorted_runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Key, first row and end of each run of equal keys in a batch that is sorted by them, compared column by column."""
    n = batch.num_rows
    if not n:
        return
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        column = batch.column(k)
        both = pc.equal(column.slice(1), column.slice(0, n - 1))
        nulls = pc.xor(pc.is_null(column.slice(1)), pc.is_null(column.slice(0, n - 1)))
        new[1:] |= ~pc.fill_null(both, True).to_numpy(zero_copy_only=False) | nulls.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new).tolist()
    for a, b in zip(starts, [*starts[1:], n]):
        yield tuple(batch.column(k)[a].as_py() for k in keys), a, b


def micros(column: pa.Array) -> np.ndarray:
    """A timestamp column as microseconds."""
    return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]
