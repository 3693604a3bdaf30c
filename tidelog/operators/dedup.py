"""Idempotent publishing in batch (P4, J9, O8): receipts live 24 hours from the accepted event, the newest 4,096 of a topic."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators.fold import micros, ordered_fold, sorted_runs

VERDICT = "workspace string, topic string, idempotency_key string, id string, timestamp timestamp, verdict string, receipt_id string"


def _row(row: dict, verdict: str, receipt: str) -> dict:
    return {**{k: row[k] for k in ("workspace", "topic", "idempotency_key", "id", "timestamp")}, "verdict": verdict, "receipt_id": receipt}


def by_window(rows: DataFrame, seconds: int = S.DEDUP_SECONDS, order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Verdict of each row (accepted, deduplicated, conflict) by the time window alone.

    rows: workspace, topic, idempotency_key, id, timestamp, fingerprint. A receipt is anchored at the accepted event and
    duplicates don't extend it. Keys are independent, so the fold runs by key; a receipt takes one search in its key's
    sorted times. Rows without a key are accepted where they are, so they never meet in one task.
    """
    keys, names = ["workspace", "topic", "idempotency_key"], ["workspace", "topic", "idempotency_key", "id", "timestamp"]
    keyless = F.coalesce("idempotency_key", F.lit("")) == ""
    window = int(seconds * 1_000_000)

    def run(batches):
        own = at = fingerprint = receipt = None
        for batch in batches:
            time, ids, prints = micros(batch.column("timestamp")), batch.column("id").to_pylist(), batch.column("fingerprint")
            verdicts, receipts = [], []
            for key, i, end in sorted_runs(batch, keys):
                if key != own:
                    own, at = key, None
                while i < end:
                    if at is None or time[i] - at >= window:
                        at, fingerprint, receipt = int(time[i]), prints[i].as_py(), ids[i]
                        verdicts.append("accepted")
                        receipts.append(receipt)
                        i += 1
                    last = i + int(np.searchsorted(time[i:end], at + window))
                    verdicts += ["deduplicated" if x == fingerprint else "conflict" for x in prints.slice(i, last - i).to_pylist()]
                    receipts += [receipt] * (last - i)
                    i = last
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(verdicts, pa.string()), pa.array(receipts, pa.string())], names=[*names, "verdict", "receipt_id"])

    keyed = rows.filter(~keyless).select(*dict.fromkeys([*names, "fingerprint", *order]))
    judged = keyed.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, VERDICT)
    return judged.union(rows.filter(keyless).select(*names, F.lit("accepted"), F.col("id")))


def by_window_and_capacity(rows: DataFrame, seconds: int = S.DEDUP_SECONDS, capacity: int = S.DEDUP_CAPACITY, order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """The same with the topic's bound on receipts, which couples its keys: the fold runs by topic.

    Rows are judged in the given order, the first of it the time. Rows without a key are accepted where they are.
    """
    keyless = F.coalesce("idempotency_key", F.lit("")) == ""
    names = ["workspace", "topic", "idempotency_key", "id", "timestamp"]

    def begin(row):
        return {"heap": [], "live": {}}

    def step(s, row):
        heap, live, now = s["heap"], s["live"], row["timestamp"]
        while heap and (now - heap[0][0]).total_seconds() >= seconds:
            _, own, key = heapq.heappop(heap)
            if key in live and live[key][0] == own:
                del live[key]
        key = row["idempotency_key"]
        if key in live:
            own, fingerprint = live[key]
            return [_row(row, "deduplicated" if fingerprint == row["fingerprint"] else "conflict", own)]
        live[key] = (row["id"], row["fingerprint"])
        heapq.heappush(heap, (now, row["id"], key))
        if len(heap) > capacity:
            _, own, old = heapq.heappop(heap)
            if old in live and live[old][0] == own:
                del live[old]
        return [_row(row, "accepted", row["id"])]

    keyed = rows.filter(~keyless).select(*dict.fromkeys([*names, "fingerprint", *order]))
    judged = ordered_fold(keyed, ["workspace", "topic"], list(order), begin, step, VERDICT)
    return judged.union(rows.filter(keyless).select(*names, F.lit("accepted"), F.col("id")))


def newest_receipts(accepted: DataFrame, capacity: int = S.DEDUP_CAPACITY) -> DataFrame:
    """The newest receipts of each topic at an instant, by (timestamp, id)."""
    from pyspark.sql import Window

    w = Window.partitionBy("workspace", "topic").orderBy(F.desc("timestamp"), F.desc("id"))
    return accepted.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= capacity).drop("_n")


def new_rows(rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """Rows whose key has no receipt."""
    return rows.join(receipts.select("workspace", "topic", "idempotency_key"), ["workspace", "topic", "idempotency_key"], "left_anti")
