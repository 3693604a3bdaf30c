"""A Parquet store of topics: manifests (W3), batch publishing (W1, W2), reads (S1-S6), retention (W5), audit.

Layout: ``<root>/<workspace>/<topic>/topic.json`` and ``.../events/batch=<name>/partition=<n>/*.parquet``. A batch is one
atomic directory: published under a name, a second publish of the same name changes nothing, so a retried
micro-batch is no duplicate. root is a folder that the driver and executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import jsonsem, policy
from tidelog.operators import dedup, log, scan


def replace_json(path: str, value: dict) -> None:
    """Durable replacement: temporary file, fsync, rename, fsync of the folder."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w") as f:
        json.dump(value, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    folder = os.open(os.path.dirname(path), os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


class Store:
    def __init__(self, spark: SparkSession, root: str, min_free_bytes: int = S.MIN_FREE_BYTES):
        self.spark, self.root, self.min_free = spark, root, min_free_bytes

    def _path(self, workspace: str, topic: str, *more: str) -> str:
        return os.path.join(self.root, workspace, topic, *more)

    def create_topic(self, workspace: str, name: str, partitions: int, *, schema: str = "", retention_bytes: int = 0, retention_seconds: int = 0, max_event_bytes: int = S.MAX_EVENT_BYTES, description: str = "", internal: bool = False) -> dict:
        import re

        if not re.match(S.NAME_PATTERN, name) or name in (".", "..") or not 1 <= partitions <= S.MAX_PARTITIONS or min(retention_bytes, retention_seconds) < 0:
            raise S.Invalid("name, partitions or retention")
        if name.endswith(S.DLQ_SUFFIX) and not internal:
            raise S.Invalid(f"{S.DLQ_SUFFIX} names are reserved")
        if not 0 < max_event_bytes <= S.MAX_EVENT_BYTES:
            raise S.Invalid("max_event_bytes")
        if schema:
            jsonsem.compile_schema(schema)
        if os.path.exists(self._path(workspace, name, "topic.json")):
            raise S.Conflict("topic exists")
        if len(self.topics(workspace)) >= S.MAX_TOPICS:
            raise S.Invalid(f"a workspace has {S.MAX_TOPICS} topics at most")
        config = {"workspace": workspace, "name": name, "partitions": partitions, "schema": schema, "retention_bytes": retention_bytes, "retention_seconds": retention_seconds, "max_event_bytes": max_event_bytes, "description": description, "created_at": time.time(), "next": [0] * partitions, "floor": [0] * partitions}
        replace_json(self._path(workspace, name, "topic.json"), config)
        return config

    def config(self, workspace: str, topic: str) -> dict:
        try:
            with open(self._path(workspace, topic, "topic.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            raise S.Invalid("no such topic") from None

    def topics(self, workspace: str) -> list[str]:
        folder = os.path.join(self.root, workspace)
        return sorted(x for x in (os.listdir(folder) if os.path.isdir(folder) else []) if os.path.exists(os.path.join(folder, x, "topic.json")))

    def admit(self) -> None:
        """Refuses appends while the reserve and one more record don't fit."""
        os.makedirs(self.root, exist_ok=True)
        if shutil.disk_usage(self.root).free < self.min_free + S.MAX_RECORD_BYTES:
            raise S.Unavailable("storage pressure")

    def log(self, workspace: str, topic: str) -> DataFrame:
        config = self.config(workspace, topic)
        if not os.path.isdir(self._path(workspace, topic, "events")):
            return self.spark.createDataFrame([], S.EVENT)
        rows = self.spark.read.schema(S.EVENT).parquet(self._path(workspace, topic, "events"))
        floors = config["floor"]
        if not any(floors):
            return rows
        keep = F.lit(False)
        for p, floor in enumerate(floors):
            keep = keep | ((F.col("partition") == p) & (F.col("offset") >= floor))
        return rows.filter(keep)

    def receipts(self, workspace: str, topic: str, now) -> DataFrame:
        """Keyed events that may still have a receipt: of the last S.DEDUP_SECONDS (Parquet's statistics skip older files)."""
        recent = F.col("timestamp") > now - F.expr(f"INTERVAL {S.DEDUP_SECONDS} SECONDS")
        return self.log(workspace, topic).filter(recent & F.expr("coalesce(idempotency_key, '') <> ''"))

    def publish(self, workspace: str, topic: str, rows: DataFrame, order: list[str], batch: str | None = None, now=None) -> DataFrame:
        """Appends the valid, new rows; returns every row's id, error, status, and its place or its receipt's.

        rows: type, key, data and optionally headers, idempotency_key and the order columns. Errors don't stop the other rows.
        """
        self.admit()
        config = self.config(workspace, topic)
        batch = batch or uuid.uuid4().hex
        target = self._path(workspace, topic, "events", f"batch={batch}")
        for name, kind in (("headers", "map<string,string>"), ("idempotency_key", "string")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        now = F.current_timestamp() if now is None else now
        rows = rows.withColumns({"id": F.sha2(F.concat_ws("|", F.lit(batch), *[F.col(c).cast("string") for c in order]), 256).substr(1, 32), "timestamp": now, "workspace": F.lit(workspace), "topic": F.lit(topic)})
        valid = jsonsem.is_valid_json(F.col("data"))
        size = F.octet_length(F.to_json(F.struct("type", "key", "headers", "data", "idempotency_key")))
        error = policy.publish_error(F.col("type"), F.col("key"), F.col("headers"), F.col("idempotency_key"), valid, size, config["max_event_bytes"])
        if config["schema"]:
            error = F.coalesce(error, F.when(~jsonsem.matches_schema(F.col("data"), config["schema"]), "schema"))
        checked = rows.withColumn("error", error)
        good = checked.filter("error is null")
        past = self.receipts(workspace, topic, now)
        print_ = jsonsem.fingerprint(F.col("type"), F.coalesce("key", F.lit("")), F.to_json("headers"), F.col("data"))
        pick = ["workspace", "topic", "idempotency_key", "id", "timestamp", "fingerprint"]
        # Rows of a batch have one time: they are judged in the batch's own order, behind all that the log has.
        own = [f"_order{k}" for k in range(len(order))]
        kinds = dict(rows.dtypes)
        before = past.withColumn("fingerprint", print_).select(*pick, F.lit(0).alias("_new"), *[F.lit(None).cast(kinds[c]).alias(o) for c, o in zip(order, own)])
        new = good.filter("coalesce(idempotency_key, '') <> ''").withColumn("fingerprint", print_).select(*pick, F.lit(1).alias("_new"), *[F.col(c).alias(o) for c, o in zip(order, own)])
        verdicts = dedup.by_window_and_capacity(before.unionByName(new), order=("timestamp", "_new", *own, "id")).select("id", "verdict", "receipt_id")
        judged = good.join(verdicts, "id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("accepted")))
        if not os.path.isdir(target):
            base = self.spark.createDataFrame([(p, n) for p, n in enumerate(config["next"])], "partition int, next long")
            new = log.to_log(judged.filter("verdict = 'accepted'").withColumn("key", F.coalesce("key", F.lit(""))), topic, config["partitions"], order, workspace=workspace, base=base)
            names = [f.name for f in S.EVENT]
            new.select(*[F.col(c).cast(f.dataType) for c, f in zip(names, S.EVENT)]).repartition("partition").sortWithinPartitions("partition", "offset").write.mode("overwrite").partitionBy("partition").parquet(f"{target}.part")
            os.replace(f"{target}.part", target)
            for r in self.spark.read.schema(S.EVENT).parquet(target).groupBy("partition").agg(F.max("offset").alias("last")).collect():
                config["next"][r["partition"]] = r["last"] + 1
            replace_json(self._path(workspace, topic, "topic.json"), config)
        places = self.log(workspace, topic).select(F.col("id").alias("receipt_id"), "partition", "offset")
        status = F.when(F.col("error").isNotNull(), 400).when(F.col("verdict") == "conflict", 409).otherwise(201)
        out = checked.select("id", "error", *[c for c in order if c != "id"]).join(judged.select("id", "verdict", F.coalesce("receipt_id", "id").alias("receipt_id")), "id", "left").join(places, "receipt_id", "left")
        conflict = F.col("verdict") == "conflict"
        return out.select("id", *[c for c in order if c != "id"], F.coalesce("error", F.when(conflict, F.lit("conflict"))).alias("error"), status.alias("status"), F.when(~conflict, F.col("partition")).alias("partition"), F.when(~conflict, F.col("offset")).alias("offset"), (F.col("verdict") == "deduplicated").alias("deduplicated"))

    def bounds(self, workspace: str, topic: str) -> DataFrame:
        config = self.config(workspace, topic)
        own = self.spark.createDataFrame([(topic, p, n, f) for p, (n, f) in enumerate(zip(config["next"], config["floor"]))], "topic string, partition int, next long, floor long")
        return log.bounds(self.log(workspace, topic), own)

    def scan(self, workspace: str, topic: str, wanted: scan.Range) -> DataFrame:
        config = self.config(workspace, topic)
        if not 0 <= wanted.partition < config["partitions"]:
            raise S.OutOfRange("no such partition")
        checked = wanted.check(config["floor"][wanted.partition], config["next"][wanted.partition])
        return scan.scan(self.log(workspace, topic), checked)

    def retain(self, workspace: str, topic: str, now, segment_bytes: int = S.SEGMENT_BYTES) -> dict:
        """Raises the partitions' floors over dropped segments; offsets are never used again."""
        config = self.config(workspace, topic)
        segments = log.segment_starts(self.log(workspace, topic), segment_bytes)
        dropped = log.retained(segments, now, config["retention_seconds"], config["retention_bytes"], config["partitions"])
        for r in dropped.filter("dropped").groupBy("partition").agg(F.max("next").alias("floor")).collect():
            config["floor"][r["partition"]] = max(config["floor"][r["partition"]], r["floor"])
        replace_json(self._path(workspace, topic, "topic.json"), config)
        return config

    def audit(self, workspace: str, actor: str, action: str, target: str) -> None:
        """Appended and synced before the act; a failure here blocks it."""
        os.makedirs(os.path.join(self.root, workspace), exist_ok=True)
        with open(os.path.join(self.root, workspace, "audit.jsonl"), "a") as f:
            f.write(json.dumps({"actor": actor, "action": action, "target": target, "at": time.time()}) + "\n")
            f.flush()
            os.fsync(f.fileno())
