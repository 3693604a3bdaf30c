"""Delivery: attempt state machine (D1, D2), outcomes (D3, D4), history and rollups (D8, M7, M8), pages (O7, D7), limits (L1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import policy
from tidelog.operators.fold import ordered_fold

STATUSES = ["sending", "retry", "failed", "delivered", "dlq", "unknown"]
KEY = ["subscription_id", "event_id", "attempt", "status"]


def classify(attempts: DataFrame) -> DataFrame:
    """Outcome and delay to the next attempt of each response.

    attempts: http_status (null: transport error), attempt, max_attempts, delay, retry_after, completed_at.
    """
    status = policy.classify(F.col("http_status"), F.col("attempt"), F.col("max_attempts"))
    delay = policy.next_delay(F.col("http_status"), F.col("delay"), F.col("attempt"), F.col("retry_after"), F.col("completed_at"))
    return attempts.withColumn("status", status).withColumn("next_delay", F.when(F.col("status") == "retry", delay))


DELIVERED = "subscription_id string, partition int, tick long, offset long, action string, status string, attempt int, next_at long"


def run_ticks(ticks: DataFrame) -> DataFrame:
    """The attempt state machine of each subscription's partition, tick by tick.

    ticks: subscription_id, partition, tick, at (seconds), end (the partition's high watermark), http_status (what the
    receiver would answer now; null: transport error), crash (the answer is lost), max_attempts, delay and optionally
    retry_after (the answer's header). What comes out names events by their offset in the partition. One event is in
    flight at a time: a failure that isn't due blocks those behind it. A lost answer leaves ``sending``, which the
    next tick records as ``unknown`` before it tries again. A receiver's wish counts where it is later than the backoff.
    """
    wish = policy.retry_after(F.coalesce("retry_after", F.lit("")), F.timestamp_seconds("at")) if "retry_after" in ticks.columns else F.lit(0).cast("long")

    def step(s, row):
        out = []
        note = lambda action: out.append({"subscription_id": row["subscription_id"], "partition": row["partition"], "tick": row["tick"], "offset": s["at"], "action": action, "status": s["status"], "attempt": s["attempt"], "next_at": s["next"]})
        if s["at"] >= row["end"]:
            return out
        if row["at"] < s["next"]:
            note("wait")
            return out
        if s["status"] == "sending":
            s["status"] = "unknown"
            note("record")
        if s["attempt"] < row["max_attempts"]:
            s["attempt"] += 1
            s["status"], s["next"] = "sending", row["at"] + 30
            note("send")
            if row["crash"]:
                return out
            code = row["http_status"]
            again = code is None or code in (408, 425, 429) or code >= 500
            s["status"] = "delivered" if code is not None and 200 <= code < 300 else "failed" if not again or s["attempt"] >= row["max_attempts"] else "retry"
            pause = max(min(row["delay"] << min(s["attempt"] - 1, 32), S.MAX_DELAY), row["wish"] if code in (429, 503) else 0)
            s["next"] = row["at"] + pause if s["status"] == "retry" else row["at"]
            note("answer")
        else:
            s["status"] = "failed"
        if s["status"] == "failed":
            s["status"] = "dlq"
            note("dead letter")
        if s["status"] in ("delivered", "dlq"):
            s |= {"at": s["at"] + 1, "status": "", "attempt": 0, "next": 0}
        return out

    return ordered_fold(ticks.withColumn("wish", wish), ["subscription_id", "partition"], ["tick"], lambda row: {"at": 0, "status": "", "attempt": 0, "next": 0}, step, DELIVERED)


def history(records: DataFrame) -> DataFrame:
    """Valid records, each (subscription, event, attempt, status) once."""
    return records.filter(F.col("status").isin(STATUSES) & (F.col("attempt") >= 1)).dropDuplicates(KEY)


def latest(entries: DataFrame) -> DataFrame:
    """The last state of each subscription's event by history cursor."""
    last = F.max_by(F.struct("attempt", "status", "cursor"), "cursor").alias("_l")
    return entries.groupBy("subscription_id", "event_id").agg(last).select("subscription_id", "event_id", "_l.attempt", "_l.status", "_l.cursor")


def rollup(entries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Outcome counts of each workspace."""
    joined = entries.select("subscription_id", "status").join(subscriptions.select(F.col("id").alias("subscription_id"), "workspace"), "subscription_id")
    s = F.col("status")
    return joined.groupBy("workspace").agg(F.count_if(s == "delivered").alias("delivered"), F.count_if(s.isin("retry", "failed")).alias("failed"), F.count_if(s == "unknown").alias("unknown"), F.count_if(s == "dlq").alias("dead_letters"))


def rollup_increment(new: DataFrame, seen: DataFrame, counts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Counts after new records: only those not in the history yet add one (M8)."""
    fresh = history(new).join(seen.select(*KEY), KEY, "left_anti")
    both = counts.unionByName(rollup(fresh, subscriptions))
    return both.groupBy("workspace").agg(*[F.sum(c).alias(c) for c in ("delivered", "failed", "unknown", "dead_letters")])


def keyset_page(rows: DataFrame, cursor: str, after: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page behind a cursor, and one row: next_cursor, has_more (O7). One row more is looked at."""
    ahead = rows.filter(F.col(cursor) > after).orderBy(cursor).limit(limit + 1)
    numbered = ahead.withColumn("_n", F.row_number().over(Window.orderBy(cursor)))  # of limit + 1 rows
    page = numbered.filter(F.col("_n") <= limit).drop("_n")
    state = numbered.agg(F.coalesce(F.max(F.when(F.col("_n") <= limit, F.col(cursor))), F.lit(after)).cast("long").alias("next_cursor"), (F.count("*") > limit).alias("has_more"))
    return page, state


def workspace_page(entries: DataFrame, subscriptions: DataFrame, workspace: str, subscription: str, after: int, limit: int = S.HISTORY_ROWS) -> tuple[DataFrame, DataFrame]:
    """A subscription's history page as its workspace may see it: another workspace's subscription gives nothing."""
    own = subscriptions.filter((F.col("workspace") == workspace) & (F.col("id") == subscription)).select(F.col("id").alias("subscription_id"))
    return keyset_page(entries.join(F.broadcast(own), "subscription_id"), "cursor", after, limit)  # one row


def logs(attempts: DataFrame, subscriptions: DataFrame, workspace: str, limit: int = S.HISTORY_ROWS) -> DataFrame:
    """A workspace's latest attempts in the order of their events."""
    own = subscriptions.filter(F.col("workspace") == workspace).select(F.col("id").alias("subscription_id"))
    return attempts.join(own, "subscription_id").orderBy("event_id", "subscription_id").limit(limit)


def due(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions that a tick serves."""
    return subscriptions.filter(~F.col("paused"))


def pause(subscriptions: DataFrame, which: Column, paused: bool = True) -> DataFrame:
    return subscriptions.withColumn("paused", F.when(which, F.lit(paused)).otherwise(F.col("paused")))


def subscription_error(rows: DataFrame) -> Column:
    """Why a subscription is refused, or null."""
    return (
        F.when(policy.url_error(F.col("url")).isNotNull(), F.concat(F.lit("url: "), policy.url_error(F.col("url"))))
        .when(~F.octet_length("secret").between(32, 1024), "secret")
        .when(~F.col("max_attempts").between(1, 20), "max_attempts")
        .when(~F.col("delay").between(1, 3600), "delay")
        .when(policy.headers_error(F.col("headers")).isNotNull(), F.concat(F.lit("headers: "), policy.headers_error(F.col("headers"))))
    )


def initialised(rows: DataFrame, key: bytes) -> DataFrame:
    """Subscriptions (id, workspace, topic, url, secret, headers, max_attempts, delay) as they are kept.

    error says why one is refused; else its secret and headers are encrypted under their purposes, the plain ones go, and
    dlq_topic (DLQ_PARTITIONS partitions) and group (from the earliest offset) are what must be made for it.
    """
    error = F.coalesce(subscription_error(rows), F.when(F.octet_length("topic") + len(S.DLQ_SUFFIX) > 128, F.lit("topic")))
    ok = F.col("error").isNull()
    names = policy.canonical_headers(F.col("headers"))
    out = rows.withColumn("error", error).withColumns({
        "encrypted_secret": F.when(ok, policy.encrypt(F.col("secret"), key, "webhook-secret")), "encrypted_headers": F.when(ok, policy.encrypt(F.to_json(names), key, "webhook-headers")),
        "header_names": F.when(ok, policy.header_names(names)), "dlq_topic": F.when(ok, F.concat("topic", F.lit(S.DLQ_SUFFIX))), "group": F.when(ok, F.concat(F.lit("webhook-"), "id")), "paused": F.lit(False),
    })
    return out.drop("secret", "headers")


def limited_keys(requests: DataFrame, capacity: int = S.LIMITER_KEYS, idle: float = 60.0) -> DataFrame:
    """Whether the limiter knows or can take each request's key (L1): key, seq, known.

    It has at most so many keys; when it is full, those whose window began more than idle seconds ago go, and a
    new key is refused if none did. requests: limiter, key, at (seconds), seq. The bound couples a limiter's keys, so
    the fold runs by limiter.
    """

    def step(s, row):
        key, at = row["key"], row["at"]
        if key not in s and len(s) >= capacity:
            for k in [k for k, since in s.items() if at - since > idle]:
                del s[k]
        known = key in s or len(s) < capacity
        if known and at - s.get(key, -1e300) >= 1.0:
            s[key] = at
        return [{"limiter": row["limiter"], "key": key, "seq": row["seq"], "known": known}]

    return ordered_fold(requests, ["limiter"], ["at", "seq"], lambda row: {}, step, "limiter string, key string, seq long, known boolean")


def rate_limited(requests: DataFrame, limit: int, seconds: float = 1.0) -> DataFrame:
    """Whether each request (key, at in seconds, seq) passes: windows begin at a key's first request after the last one (L1)."""

    def step(s, row):
        if s["start"] is None or row["at"] - s["start"] >= seconds:
            s["start"], s["n"] = row["at"], 0
        ok = s["n"] < limit
        s["n"] += ok
        return [{"key": row["key"], "seq": row["seq"], "allowed": ok}]

    return ordered_fold(requests, ["key"], ["at", "seq"], lambda row: {"start": None, "n": 0}, step, "key string, seq long, allowed boolean")
