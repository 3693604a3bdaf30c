"""Webhook delivery (W11): signed POSTs through an injected transport, attempts recorded before and after.

transport(url, headers, payload) returns (status, headers) or raises OSError; it runs on executors, one call a due event,
and nothing here opens a connection by itself. Attempts are appended to a table in a folder that all machines share:

* a tick takes each subscription's next event of each partition (one is in flight at a time) whose time has come;
* ``sending`` is written before the request, with the time after which its outcome counts as unknown; a tick that finds
  ``sending`` records ``unknown`` and tries again, so a lost executor costs an attempt, never an event;
* the outcome (D3, D4) is written after it; a failure that is final becomes a dead letter, published by the caller's
  function and only then recorded as ``dlq``, so a repeated publish is one with the same key.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import policy
from tidelog.functions.hashing import record_text
from tidelog.operators import deadletters

ATTEMPT = "subscription_id string, topic string, partition int, offset long, event_id string, attempt int, status string, http_status int, error string, latency_ms long, at timestamp, next_at timestamp, cursor long"
SETTLED, SENDING_SECONDS = ("delivered", "dlq"), 30
_NAMES = [x.split()[0] for x in ATTEMPT.split(", ")]
_ANSWER = "subscription_id string, topic string, partition int, offset long, http_status int, error string, wish string, latency_ms long, completed timestamp"


def request_headers(own: dict[str, str], event_id: str, timestamp: str, secret: str, payload: str) -> dict[str, str]:
    """The subscription's headers, then the service's, which win."""
    mark = f"X-{S.PREFIX.capitalize()}-"
    return {**own, "Content-Type": "application/json", "User-Agent": f"{S.PREFIX}/0.1", f"{mark}ID": event_id, f"{mark}Timestamp": timestamp, f"{mark}Signature": policy.signature(secret, timestamp, payload)}


class Sink:
    """Delivers a log's events to subscriptions.

    subscriptions: id, workspace, topic, url, encrypted_secret, encrypted_headers, max_attempts, delay, paused (see
    delivery.initialised). publish(rows) appends dead letters (topic, partition, key, type, data).
    """

    def __init__(self, spark: SparkSession, root: str, key: bytes, transport: Callable, publish: Callable[[DataFrame], object], clock: Callable[[], float] = time.time):
        self.spark, self.root, self.key, self.transport, self.publish, self.clock = spark, root.rstrip("/"), key, transport, publish, clock

    def attempts(self) -> DataFrame:
        """All records; cursor orders those of a subscription's partition."""
        try:
            return self.spark.read.schema(ATTEMPT).option("recursiveFileLookup", "true").parquet(f"{self.root}/attempts")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ATTEMPT)

    def _record(self, rows: DataFrame) -> DataFrame:
        """Appends records and gives them back as they were written: what follows doesn't compute them again."""
        path = f"{self.root}/attempts/{uuid.uuid4().hex}"
        rows.select(*_NAMES).write.parquet(path)
        return self.spark.read.schema(ATTEMPT).parquet(path)

    def due(self, log: DataFrame, subscriptions: DataFrame, now: float) -> DataFrame:
        """The event that each live subscription's partition waits for, if its time has come, with its last attempt."""
        keys = ["subscription_id", "topic", "partition"]
        last = self.attempts().groupBy(*keys).agg(F.max_by(F.struct("offset", "attempt", "status", "error", "next_at", "cursor"), "cursor").alias("last"))
        live = subscriptions.filter(~F.col("paused")).withColumnRenamed("id", "subscription_id")
        starts = log.groupBy("topic", "partition").agg(F.min("offset").alias("oldest"))
        rows = live.join(F.broadcast(starts), "topic").join(last, keys, "left")  # a row a partition: MAX_PARTITIONS a topic
        over = F.col("last.status").isin(*SETTLED)
        at = F.greatest(F.coalesce(F.when(over, F.col("last.offset") + 1).otherwise(F.col("last.offset")), F.col("oldest")), F.col("oldest"))
        rows = rows.withColumn("offset", at).withColumn("open", F.coalesce(~over & (F.col("last.offset") == F.col("offset")), F.lit(False)))
        for name, kind in (("attempt", "int"), ("status", "string"), ("error", "string"), ("next_at", "timestamp")):
            rows = rows.withColumn(name, F.when(F.col("open"), F.col(f"last.{name}")).cast(kind))
        rows = rows.withColumns({"attempt": F.coalesce("attempt", F.lit(0)), "cursor": F.coalesce("last.cursor", F.lit(0).cast("long"))}).drop("last", "open", "oldest")
        moment = F.timestamp_seconds(F.lit(now))
        return rows.filter(F.col("next_at").isNull() | (F.col("next_at") <= moment)).join(log.drop("workspace").withColumnRenamed("id", "event_id"), ["topic", "partition", "offset"])

    def tick(self, log: DataFrame, subscriptions: DataFrame) -> int:
        """One attempt of each due event; returns how many there were."""
        now = self.clock()
        moment = F.timestamp_seconds(F.lit(now))
        folder = f"{self.root}/due/{uuid.uuid4().hex}"
        self.due(log, subscriptions, now).write.parquet(folder)
        due = self.spark.read.parquet(folder)
        n = due.count()
        if not n:
            return 0
        none = {"http_status": F.lit(None).cast("int"), "latency_ms": F.lit(None).cast("long")}
        lost = due.filter("status = 'sending'").withColumns({**none, "status": F.lit("unknown"), "error": F.lit("outcome unknown after an interruption"), "at": moment, "next_at": F.lit(None).cast("timestamp"), "cursor": F.col("cursor") + 1})
        trying = (F.col("attempt") < F.col("max_attempts")) & (F.coalesce("status", F.lit("")) != "failed")
        until = F.timestamp_seconds(F.lit(now + SENDING_SECONDS))
        sending = due.filter(trying).withColumns({**none, "attempt": F.col("attempt") + 1, "status": F.lit("sending"), "error": F.lit(None).cast("string"), "at": moment, "next_at": until, "cursor": F.col("cursor") + 2})
        self._record(lost.select(*_NAMES).unionByName(sending.select(*_NAMES)))
        answered = self._record(self._outcomes(due.filter(trying), self._answers(due.filter(trying))))
        done = due.filter(~trying).withColumns({**none, "status": F.lit("failed"), "error": F.coalesce("error", F.lit("outcome unknown after an interruption")), "at": moment}).select(*_NAMES)
        failed = answered.filter("status = 'failed'").unionByName(done)
        rows = failed.select("subscription_id", "topic", "partition", "offset", "attempt", F.col("error").alias("_error"), "at", "cursor", "event_id").join(log.drop("workspace"), ["topic", "partition", "offset"])
        letters = rows.withColumns({"attempts": F.greatest("attempt", F.lit(1)), "error": F.col("_error"), "failed_at": F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")})
        if letters.limit(1).count():
            self.publish(deadletters.envelopes(letters))
            self._record(failed.withColumns({"status": F.lit("dlq"), "cursor": F.col("cursor") + 2}))
        return n

    def _answers(self, due: DataFrame) -> DataFrame:
        """What the receivers answer; one request a row."""
        payload = record_text(*(F.col(x) for x in ("topic", "partition", "offset", "event_id", "timestamp", "type", "key", "data")))
        asked = due.select("subscription_id", "topic", "partition", "offset", "event_id", "url", payload.alias("payload"), policy.decrypt(F.col("encrypted_secret"), self.key, "webhook-secret").alias("secret"), policy.decrypt(F.col("encrypted_headers"), self.key, "webhook-headers").alias("headers"), policy.url_error(F.col("url")).alias("refused"))
        transport, clock = self.transport, self.clock

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    began, status, error, wish = clock(), None, None, ""
                    if r.refused is not None:
                        status, error = 400, f"url: {r.refused}"
                    else:
                        try:
                            status, answer = transport(r.url, request_headers(json.loads(r.headers), r.event_id, str(int(began)), r.secret, r.payload), r.payload)
                            wish = next((v for k, v in (answer or {}).items() if k.lower() == "retry-after"), "")
                            error = None if 200 <= status < 300 else f"HTTP {status}"
                        except OSError:
                            error = "transport failure"
                    ended = clock()
                    out.append((r.subscription_id, r.topic, r.partition, r.offset, status, error, wish, int((ended - began) * 1000), pd.Timestamp(ended, unit="s", tz="UTC")))
                names = [x.split()[0] for x in _ANSWER.split(", ")]
                yield pd.DataFrame(out, columns=names).astype({"http_status": "Int32"})

        return asked.repartition("subscription_id", "partition").mapInPandas(send, _ANSWER)

    def _outcomes(self, due: DataFrame, answers: DataFrame) -> DataFrame:
        keys = ["subscription_id", "topic", "partition", "offset"]
        rows = due.drop("error", "status").join(answers, keys).withColumn("attempt", F.col("attempt") + 1)
        status = policy.classify(F.col("http_status"), F.col("attempt"), F.col("max_attempts"))
        pause = policy.next_delay(F.col("http_status"), F.col("delay"), F.col("attempt"), F.col("wish"), F.col("completed"))
        then = F.when(F.col("status") == "retry", F.timestamp_seconds(F.unix_micros("completed") / 1e6 + pause))
        return rows.withColumn("status", status).withColumns({"at": F.col("completed"), "next_at": then, "cursor": F.col("cursor") + 3})

    def run(self, events: DataFrame, log: Callable[[], DataFrame], subscriptions: Callable[[], DataFrame], checkpoint: str):
        """Ticks whenever a stream brings events; each micro-batch delivers until nothing is due."""

        def each(_, __):
            while self.tick(log(), subscriptions()):
                pass

        return events.writeStream.option("checkpointLocation", os.fspath(checkpoint)).foreachBatch(each).trigger(availableNow=True).start()
