"""Operator 4: removal of repeated byte strings (suffix-array dedup).

Every byte covered by a string of LENGTH bytes that also starts earlier (smaller id, or same document and earlier start)
is removed, judged on the input. The search is sparse prefix doubling (see repeats).

Defined cases: null text is empty; texts shorter than LENGTH keep all; documents that repeat an id are compared by start
alone, so equal rows treat each other as one place; a null id is smaller than all others; removal may leave
incomplete UTF-8, so what is kept is binary.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidelog.llm.common import byte_column, record_batch, slices, tidy
from tidelog.llm.repeats import Spec, covered, keyed, repeats

LENGTH, ANCHOR = 100, 24


@cache
def _names() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def byte_symbols(text: bytes) -> np.ndarray:
    return _names()[np.frombuffer(text, np.uint8)]


SPEC = Spec(LENGTH, ANCHOR, by_document=False, owners=False, symbols=byte_symbols)


def remove_repeats(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), then the columns named by more.

    kept_text() gives it as a string.
    """
    rows = keyed(docs.select("doc_id", "text", *more))
    found = repeats(SPEC, rows).groupBy("did", "tag").agg(F.collect_set("at").alias("places"))
    joined = rows.join(found, ["did", "tag"], "left").select("doc_id", "text", "places", *more)
    base = joined.drop("text", "places")
    schema = base.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(b"").alias("kept"), *more).schema
    head = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches):
        for batch in slices(batches, "text"):
            sizes, gone, spans, kept = [], [], [], []
            for text, places in zip(byte_column(batch, "text"), batch.column("places")):
                raw = np.frombuffer(text, np.uint8)
                out = covered(len(raw), places.values.to_numpy(), LENGTH) if places.is_valid else np.zeros(len(raw), bool)
                sizes.append(len(raw))
                gone.append(int(out.sum()))
                spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                kept.append(raw[~out].tobytes() if gone[-1] else text)
            first = record_batch(head, [batch.column("doc_id"), sizes, gone, spans, kept])
            yield pa.RecordBatch.from_arrays([*first.columns, *(batch.column(x) for x in more)], names=[*head.names, *more])

    return joined.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(cut), schema)


def kept_text(kept):
    """What is kept as text; characters that removal has cut through are left out."""

    @F.pandas_udf(StringType())
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: x.decode("utf-8", "ignore"))

    return decode(kept)
