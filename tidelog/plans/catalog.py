"""The log engine's named queries: each a (query, SQL) pair; SQL is None where SQL can't express the fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import policy
from tidelog.functions.hashing import iso, partition_for
from tidelog.operators import deadletters, dedup, delivery, groups, log, metadata, metrics, replay, scan
from tidelog.plans.views import ISO, PARTITIONS, SEGMENT, event_log, event_rows, fnv_sql, partitions, table, with_log, with_segments

_FOUND: dict = {}


def query(sql: str | None = None):
    def keep(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


# --- log core -----------------------------------------------------------------------------------------------


@query(with_log('SELECT id, partition, "offset", record_bytes FROM log'))
def log_assign(spark, sf_dir):
    return event_log(spark, sf_dir).select("id", "partition", "offset", "record_bytes")


@query(with_segments('SELECT l.partition, CAST(min("offset") AS BIGINT) AS oldest, CAST(max("offset") + 1 AS BIGINT) AS next, count(*) AS events, CAST(sum(record_bytes) AS BIGINT) AS bytes, (SELECT count(*) FROM segments s WHERE s.partition = l.partition) AS segments FROM log l GROUP BY l.partition'))
def log_bounds(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    return log.bounds(rows, partitions(spark), log.segment_starts(rows, SEGMENT)).drop("topic")


@query(with_segments(f"SELECT partition, base, next, size, {ISO.replace('ts', 'last', 1)} AS last FROM segments"))
def log_segments(spark, sf_dir):
    return log.segment_starts(event_log(spark, sf_dir), SEGMENT).select("partition", "base", "next", "size", iso(F.col("last")).alias("last"))


def _retention_sql(ok: str) -> str:
    return with_segments(
        f""", r AS (SELECT *, sum(size) OVER (PARTITION BY partition) - coalesce(sum(size) OVER (PARTITION BY partition ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining, lead(base) OVER (PARTITION BY partition ORDER BY base) IS NOT NULL AS sealed FROM segments),
k AS (SELECT *, CAST(({ok}) AND sealed AS INTEGER) AS ok FROM r)
SELECT partition, base, next, min(ok) OVER (PARTITION BY partition ORDER BY base ROWS UNBOUNDED PRECEDING) = 1 AS dropped FROM k"""
    )


@query(_retention_sql(f"remaining > {400_000 // PARTITIONS}"))
def log_retention_bytes(spark, sf_dir):
    segments = log.segment_starts(event_log(spark, sf_dir), SEGMENT)
    return log.retained(segments, F.current_timestamp(), total_bytes=400_000, partitions=PARTITIONS).select("partition", "base", "next", "dropped")


@query(_retention_sql("epoch_us((SELECT max(ts) FROM events)) - epoch_us(last) >= 10 * 86400 * 1000000::BIGINT"))
def log_retention_time(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    segments = log.segment_starts(event_log(spark, sf_dir), SEGMENT)
    return log.retained(segments, F.lit(now), seconds=10 * 86400).select("partition", "base", "next", "dropped")


@query(with_log(', h AS (SELECT partition, "offset", lag("offset") OVER (PARTITION BY partition ORDER BY "offset") AS previous FROM log WHERE "offset" % 10 <> 3) SELECT partition, previous, "offset" FROM h WHERE previous IS NOT NULL AND "offset" <> previous + 1'))
def log_contiguity(spark, sf_dir):
    return log.gaps(event_log(spark, sf_dir).filter("offset % 10 <> 3")).select("partition", "previous", "offset")


@query("""SELECT conv_id, turn, CASE WHEN strlen(role) NOT BETWEEN 1 AND 256 THEN 'type' WHEN turn * 60 > 256 THEN 'idempotency_key' WHEN conv_id % 11 = 0 THEN 'data' WHEN strlen(text) > 400 THEN 'event_bytes' END AS error FROM conversations""")
def publish_validate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = F.repeat(F.lit("x"), (F.col("turn") * 60).cast("int"))
    error = policy.publish_error(F.col("role"), F.col("conv_id").cast("string"), F.lit(None).cast("map<string,string>"), key, F.col("conv_id") % 11 != 0, F.octet_length("text"), 400)
    return c.select("conv_id", "turn", error.alias("error"))


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS turn FROM orders), p AS (SELECT *, CAST(turn % 3 AS INTEGER) AS partition FROM n) SELECT o_orderkey, partition, CAST(row_number() OVER (PARTITION BY partition ORDER BY turn) - 1 AS BIGINT) AS "offset" FROM p""")
def round_robin(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderstatus").alias("type"), F.lit("").alias("key"), F.lit("{}").alias("data"), "o_orderkey")
    return log.to_log(rows, "orders", 3, ["timestamp", "o_orderkey"], chunk=F.date_trunc("month", "timestamp")).select("o_orderkey", "partition", "offset")


@query("SELECT l_orderkey, l_linenumber, CAST(" + fnv_sql("CAST(l_orderkey AS VARCHAR)") + " % 256 AS INTEGER) AS partition FROM lineitem")
def partition_lineitem(spark, sf_dir):
    """Routing of the largest table: one scan of two columns, no shuffle."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", partition_for(F.col("l_orderkey").cast("string"), 256).alias("partition"))


# --- scans, export, replay ----------------------------------------------------------------------------------

_PAGE = ["id", "partition", "offset", "type", "key", "data"]
_PAGE_SQL = 'id, partition, "offset", type, key, data'


def _page_sql(partition: int, offset: int, limit: int, where: str) -> str:
    return with_log(f', page AS (SELECT * FROM log WHERE partition = {partition} AND "offset" >= {offset} ORDER BY "offset" LIMIT {limit}) SELECT {_PAGE_SQL} FROM page WHERE {where}')


@query(_page_sql(0, 0, 100, "type = 'purchase'"))
def scan_page(spark, sf_dir):
    return scan.scan(event_log(spark, sf_dir), scan.Range(0, 0, limit=100, type="purchase")).select(*_PAGE)


@query(_page_sql(1, 50, 500, "ts >= (SELECT min(ts) FROM events) + INTERVAL 3 DAY AND ts < (SELECT min(ts) FROM events) + INTERVAL 9 DAY"))
def scan_time_range(spark, sf_dir):
    low = table(spark, sf_dir, "events").agg(F.min(F.col("ts").cast("timestamp"))).select(F.date_format(F.col("min(CAST(ts AS TIMESTAMP))") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.date_format(F.col("min(CAST(ts AS TIMESTAMP))") + F.expr("INTERVAL 9 DAYS"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()
    return scan.scan(event_log(spark, sf_dir), scan.Range(1, 50, limit=500, from_time=low[0], until_time=low[1])).select(*_PAGE)


_KEY_PAGE = 'partition = 2 AND "offset" BETWEEN 10 AND 1009'
_SOME_KEY = f"(SELECT max(key) FROM log WHERE {_KEY_PAGE})"


@query(_page_sql(2, 10, 1000, f"key = {_SOME_KEY}"))
def scan_by_key(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    key = rows.filter("partition = 2 AND offset BETWEEN 10 AND 1009").agg(F.max("key")).first()[0]
    return scan.scan(rows, scan.Range(2, 10, limit=1000, key=key or "none")).select(*_PAGE)


@query(_page_sql(2, 10, 1000, f"key = {_SOME_KEY} AND id = (SELECT min(id) FROM log WHERE key = {_SOME_KEY} AND {_KEY_PAGE})"))
def scan_by_key_and_id(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    page = rows.filter("partition = 2 AND offset BETWEEN 10 AND 1009")
    key, event = page.groupBy("key").agg(F.min("id").alias("id")).orderBy(F.desc("key")).first() or ("none", "none")
    return scan.scan(rows, scan.Range(2, 10, limit=1000, key=key, id=event)).select(*_PAGE)


@query(with_log(', page AS (SELECT *, coalesce(sum(record_bytes) OVER (ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM log WHERE partition = 2 AND "offset" >= 100 ORDER BY "offset" LIMIT 1000)) SELECT partition, "offset", record_bytes FROM page WHERE before < 20000'))
def scan_byte_capped(spark, sf_dir):
    return scan.read(event_log(spark, sf_dir), 2, 100, 1000, 20_000).select("partition", "offset", "record_bytes")


@query(with_log(""", e AS (SELECT max("offset") + 1 AS e FROM log WHERE partition = 3), page AS (SELECT * FROM log WHERE partition = 3 AND "offset" >= 20 ORDER BY "offset" LIMIT 150) SELECT count(*) AS scanned, count(*) FILTER (WHERE type = 'click') AS matched, CAST(max("offset") + 1 AS BIGINT) AS next_offset, CAST((SELECT e FROM e) AS BIGINT) AS end_offset, max("offset") + 1 = (SELECT e FROM e) AS done FROM page"""))
def scan_cursor(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    last = rows.filter("partition = 3").agg(F.max("offset")).first()[0] or 0
    return scan.cursor(rows, scan.Range(3, 20, limit=150, type="click").check(0, last + 1))


@query(with_log("SELECT id, partition, \"offset\", CAST(\"offset\" // 100 AS BIGINT) AS page FROM log WHERE type = 'purchase'"))
def scan_all_pages(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    return scan.pages(rows, log.bounds(rows, partitions(spark)), 100, "purchase").select("id", "partition", "offset", "page")


@query(with_log(f"""SELECT partition, "offset", '{{"id":"' || id || '","topic":"events","partition":' || partition || ',"offset":' || "offset" || ',"timestamp":"' || {ISO} || '","type":"' || type || '","key":"' || key || '","data":' || to_json(data) || '}}' AS line FROM log WHERE partition = 0 AND "offset" < 500"""))
def export_jsonl(spark, sf_dir):
    return scan.export_jsonl(scan.scan(event_log(spark, sf_dir), scan.Range(0, 0, limit=500)))


def _replayed(rows, name: str = "run-1"):
    """The whole log's purchases, all partitions, as inputs of the topic copy."""
    return replay.replay(rows.filter("type = 'purchase'").withColumn("headers", F.lit(None).cast("map<string,string>")), name, "copy")


_REPLAY_KEY = """'replay-' || sha256('["run-1","events",' || partition || ',' || "offset" || ',"' || id || '"]')"""


@query(with_log(f""", r AS (SELECT *, CAST(hash % 2 AS INTEGER) AS target_partition FROM log WHERE type = 'purchase')
SELECT id AS source_id, target_partition, CAST(row_number() OVER (PARTITION BY target_partition ORDER BY partition, "offset") - 1 AS BIGINT) AS target_offset, {_REPLAY_KEY} AS idempotency_key,
'{S.PREFIX}.replay.id=run-1;{S.PREFIX}.replay.source_id=' || id || ';{S.PREFIX}.replay.source_offset=' || "offset" || ';{S.PREFIX}.replay.source_partition=' || partition || ';{S.PREFIX}.replay.source_topic=events' AS headers FROM r"""))
def replay_copy(spark, sf_dir):
    """Every partition replayed, one after the other; numbered by stretches of the source."""
    rows = _replayed(event_log(spark, sf_dir)).withColumn("partition", partition_for(F.col("key"), 2))
    stretch = F.col("source_partition").cast("long") * (1 << 40) + F.floor(F.col("source_offset") / 100_000)
    rows = log.number_rows(rows, ["target", "partition"], ["source_partition", "source_offset"], "target_offset", stretch)
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("source_id", F.col("partition").alias("target_partition"), "target_offset", "idempotency_key", headers.alias("headers"))


@query(with_log(f""", n AS (SELECT partition, max("offset") + 1 AS n FROM log GROUP BY partition) SELECT id AS source_id, {_REPLAY_KEY} AS idempotency_key FROM log JOIN n USING (partition) WHERE "offset" * 2 >= n AND type = 'purchase'"""))
def replay_retry_dedup(spark, sf_dir):
    """A replay was cut off half-way through each partition; run again over all, it appends only what the first run didn't."""
    rows = event_log(spark, sf_dir)
    ends = F.broadcast(log.bounds(rows, partitions(spark)).select("partition", "next"))  # a row a partition
    known, again = _replayed(rows.join(ends, "partition").filter("offset * 2 < next").drop("next")), _replayed(rows)
    own = lambda df: df.withColumns({"workspace": F.lit("demo"), "topic": F.lit("copy")})
    return dedup.new_rows(own(again), own(known)).select("source_id", "idempotency_key")


# --- deduplication ------------------------------------------------------------------------------------------


def _keyed_inputs(spark, sf_dir, key):
    e = event_rows(spark, sf_dir)
    return e.select(F.lit("demo").alias("workspace"), F.lit("events").alias("topic"), key.alias("idempotency_key"), "id", "timestamp", F.concat("type", F.lit("|"), "data").alias("fingerprint"))


_DEDUP = """WITH RECURSIVE src AS MATERIALIZED (SELECT CAST(event_id AS VARCHAR) AS id, ts, CAST(user_id % 40 AS VARCHAR) || ':' || event_type AS k, event_type || '|' || props AS fp FROM events),
acc AS (SELECT k, min(ts) AS since FROM src GROUP BY k UNION ALL SELECT * FROM (SELECT a.k, (SELECT min(s.ts) FROM src s WHERE s.k = a.k AND s.ts >= a.since + INTERVAL 24 HOUR) AS since FROM acc a) WHERE since IS NOT NULL),
receipts AS (SELECT acc.k, acc.since, s.id AS rid, s.fp AS rfp FROM acc JOIN src s ON s.k = acc.k AND s.ts = acc.since),
v AS (SELECT s.id, s.k, r.rid, CASE WHEN s.id = r.rid THEN 'accepted' WHEN s.fp = r.rfp THEN 'deduplicated' ELSE 'conflict' END AS verdict FROM src s ASOF JOIN receipts r ON s.k = r.k AND s.ts >= r.since) """


def _dedup_key():
    return F.concat((F.col("user_id") % 40).cast("string"), F.lit(":"), F.col("type"))


@query(_DEDUP + "SELECT id, k AS idempotency_key, verdict, rid AS receipt_id FROM v")
def dedup_24h(spark, sf_dir):
    return dedup.by_window(_keyed_inputs(spark, sf_dir, _dedup_key())).select("id", "idempotency_key", "verdict", "receipt_id")


@query(_DEDUP + "SELECT verdict, count(*) AS n, count(DISTINCT k) AS keys FROM v GROUP BY verdict")
def dedup_conflicts(spark, sf_dir):
    return dedup.by_window(_keyed_inputs(spark, sf_dir, _dedup_key())).groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("idempotency_key").alias("keys"))


@query()
def dedup_capacity(spark, sf_dir):
    """Keys come again after 5,000 others, beyond the 4,096 receipts, and after 3,000, within them; tested by brute force."""
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a"), F.col("event_id") % 3000)).otherwise(F.concat(F.lit("b"), F.col("event_id") % 12000))
    return dedup.by_window_and_capacity(_keyed_inputs(spark, sf_dir, key), seconds=10**9).select("id", "verdict", "receipt_id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 4096")
def receipts_newest(spark, sf_dir):
    return dedup.newest_receipts(_keyed_inputs(spark, sf_dir, F.col("id"))).select("id")


# --- consumer groups ----------------------------------------------------------------------------------------

_BOUNDS = 'b AS (SELECT partition, CAST(max("offset") + 1 AS BIGINT) AS latest, CAST(max("offset") // 5 AS BIGINT) AS oldest FROM log GROUP BY partition)'


def _bounds(spark, sf_dir):
    found = log.bounds(event_log(spark, sf_dir), partitions(spark))
    return found.withColumn("oldest", F.floor((F.col("next") - 1) / 5).cast("long"))  # as if a fifth had been retained away


def _committed(bounds):
    rows = [F.struct(F.lit(g).alias("group"), F.floor(F.col("next") * x).cast("long").alias("committed")) for g, x in (("billing", 0.7), ("audit", 0.1))]
    return bounds.select("topic", "partition", F.explode(F.array(*rows)).alias("r")).select("topic", "partition", "r.group", "r.committed")


_LAGS = f"{_BOUNDS}, c AS (SELECT b.*, g.name AS \"group\", CAST(floor(latest * g.x) AS BIGINT) AS committed FROM b, (VALUES ('billing', 0.7::DOUBLE), ('audit', 0.1::DOUBLE)) g(name, x)), lags AS (SELECT *, latest - committed AS lag, greatest(oldest - committed, 0) AS unavailable FROM c)"


@query("""WITH m AS (SELECT 'group-' || n_regionkey AS "group", n_name AS member, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS rank, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), p AS (SELECT DISTINCT "group", n, CAST(r AS INTEGER) AS partition FROM m, range(16) t(r)) SELECT p."group", partition, member FROM p JOIN m ON m."group" = p."group" AND m.rank = p.partition % p.n""")
def group_assignment(spark, sf_dir):
    members = table(spark, sf_dir, "nation").select(F.concat(F.lit("group-"), F.col("n_regionkey")).alias("group"), F.col("n_name").alias("member"))
    slots = members.select("group").distinct().withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return groups.assignment(members, slots)


@query(with_log(f', {_LAGS} SELECT "group", partition, committed, latest, oldest, lag, unavailable FROM lags'))
def group_lag(spark, sf_dir):
    bounds = _bounds(spark, sf_dir)
    return groups.lag(_committed(bounds), bounds).select("group", "partition", "committed", "latest", "oldest", "lag", "unavailable")


@query(with_log(f', {_LAGS} SELECT "group", CAST(sum(lag) AS BIGINT) AS lag, CAST(sum(unavailable) AS BIGINT) AS unavailable FROM lags GROUP BY "group"'))
def lag_sum(spark, sf_dir):
    bounds = _bounds(spark, sf_dir)
    return groups.lag(_committed(bounds), bounds).groupBy("group").agg(F.sum("lag").alias("lag"), F.sum("unavailable").alias("unavailable"))


@query(with_log(f""", {_LAGS}, a AS (SELECT *, CASE WHEN partition % 2 = 0 THEN 'a' ELSE 'b' END AS member FROM lags) SELECT "group", member, string_agg(CAST(partition AS VARCHAR), ',' ORDER BY partition) AS partitions, CAST(sum(lag) AS BIGINT) AS lag FROM a GROUP BY "group", member"""))
def group_inspect(spark, sf_dir):
    bounds = _bounds(spark, sf_dir)
    lags = groups.lag(_committed(bounds), bounds)
    members = spark.createDataFrame([(g, m) for g in ("billing", "audit") for m in ("b", "a")], "group string, member string")
    found = groups.inspect(groups.assignment(members, lags.select("group", "partition")), lags)
    return found.withColumn("partitions", F.array_join(F.col("partitions").cast("array<string>"), ","))


@query(with_log(f""", {_LAGS} SELECT "group", partition, committed, latest, oldest, lag, unavailable, ("group" = 'billing' AND partition % 2 = 0) AS in_flight FROM lags"""))
def group_gauges(spark, sf_dir):
    """Two members a group, one of them expired; the living one of billing holds the even partitions."""
    bounds = _bounds(spark, sf_dir)
    committed = _committed(bounds)
    members = spark.createDataFrame([("events", g, m, until) for g in ("billing", "audit") for m, until in (("a", 50), ("b", 5))], "topic string, group string, member string, until long")
    leases = committed.select("topic", "group", "partition", F.when(F.col("partition") % 2 == 0, "a").otherwise("b").alias("member"), F.when(F.col("group") == "billing", 20).otherwise(9).cast("long").alias("until"))
    gauges, _ = groups.metrics(committed, bounds, members, leases, F.lit(10))
    return gauges.select("group", "partition", "committed", "latest", "oldest", "lag", "unavailable", "in_flight")


@query(with_log(f""", {_BOUNDS} SELECT partition, 'earliest' AS "group", 1::BIGINT AS epoch, oldest AS committed FROM b UNION ALL SELECT partition, 'latest', 1, latest FROM b"""))
def group_start(spark, sf_dir):
    bounds = _bounds(spark, sf_dir)
    return groups.start(bounds, "earliest", "earliest").unionByName(groups.start(bounds, "latest", "latest")).drop("topic")


def _commands(spark, sf_dir):
    """Commands of many groups, made from the events: who joins, pulls, acknowledges too late, and so on."""
    e = event_rows(spark, sf_dir)
    names = F.array(*[F.lit(x) for x in ("join", "pull", "ack", "pull", "commit", "nack", "pull", "ack", "leave", "join", "pull", "reset")])
    n = F.col("event_id")
    return e.select(
        F.concat(F.lit("group-"), F.col("user_id") % 10).alias("group"), n.alias("seq"), F.floor(n / 7).cast("long").alias("at"), F.get(names, (n % 12).cast("int")).alias("command"), F.concat(F.lit("m"), n % 3).alias("member"),
        F.when(n % 17 == 0, F.lit(1)).cast("long").alias("epoch"), F.when(~(n % 12).isin(0, 1, 3, 6, 8, 9, 10), n % 4).cast("int").alias("partition"), F.lit(None).cast("long").alias("token"), (n % 97).cast("long").alias("offset"), F.lit(10).alias("limit"), F.lit(1000).alias("end"),
    )


@query()
def group_commit_fold(spark, sf_dir):
    return groups.fold_commands(_commands(spark, sf_dir), 4, 200, 60)


@query()
def group_fencing(spark, sf_dir):
    folded = groups.fold_commands(_commands(spark, sf_dir), 4, 200, 60)
    return folded.groupBy("group", "command", "verdict").agg(F.count("*").alias("n"))


# --- metrics ------------------------------------------------------------------------------------------------


def _appends(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    return e.select(
        F.concat(F.lit("w"), F.col("user_id") % 3).alias("workspace"), F.when(F.col("event_id") % 50 == 0, "events.DLQ").otherwise("events").alias("topic"), F.when(F.col("event_id") % 100 == 0, S.FAILURE_TYPE).otherwise(F.col("type")).alias("type"),
        F.octet_length("data").alias("record_bytes"), ((F.col("event_id") % 1000) / F.lit(50_000.0)).alias("seconds"), (F.col("event_id") % 7 == 0).alias("deduplicated"), "timestamp",
    )


_APPENDS = f"""WITH a AS (SELECT 'w' || (user_id % 3) AS workspace, CASE WHEN event_id % 50 = 0 THEN 'events.DLQ' ELSE 'events' END AS topic, CASE WHEN event_id % 100 = 0 THEN '{S.FAILURE_TYPE}' ELSE event_type END AS type, strlen(props) AS record_bytes, (event_id % 1000) / 50000.0::DOUBLE AS seconds, event_id % 7 = 0 AS deduplicated, ts FROM events)"""


@query(_APPENDS + f""" SELECT workspace, topic, count(*) AS events, CAST(sum(record_bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE ends_with(topic, '.DLQ') AND type = '{S.FAILURE_TYPE}') AS dead_letters, round(sum(seconds), 6) AS seconds FROM a WHERE NOT deduplicated GROUP BY workspace, topic""")
def publish_counters(spark, sf_dir):
    return metrics.publish_counters(_appends(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


_BOUND_ROWS = ", ".join(f"('{b:g}', {b!r}::DOUBLE)" for b in S.LATENCY_BOUNDS)
_HISTOGRAM = _APPENDS + f""", b AS (SELECT * FROM (VALUES {_BOUND_ROWS}, ('+Inf', 'Infinity'::DOUBLE)) t(le, bound)), h AS (SELECT topic, le, bound, count(*) FILTER (WHERE seconds <= bound) AS bucket, round(sum(seconds), 6) AS sum, count(*) AS count FROM a, b GROUP BY topic, le, bound)"""


@query(_HISTOGRAM + " SELECT topic, le, bucket, sum, count FROM h")
def latency_histogram(spark, sf_dir):
    return metrics.latency_histogram(_appends(spark, sf_dir), ["topic"]).withColumn("sum", F.round("sum", 6))


@query(_HISTOGRAM + ", l AS (SELECT *, coalesce(lag(bucket) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0) AS start FROM h WINDOW w AS (PARTITION BY topic ORDER BY bound)) SELECT topic, round(min(CASE WHEN le = '+Inf' THEN start ELSE start + (bound - start) * (count * 0.95::DOUBLE - below) / greatest(bucket - below, 1) END), 9) AS quantile FROM l WHERE bucket >= count * 0.95::DOUBLE AND below < count * 0.95::DOUBLE GROUP BY topic")
def latency_p95(spark, sf_dir):
    histogram = metrics.latency_histogram(_appends(spark, sf_dir), ["topic"])
    return metrics.histogram_quantile(histogram, ["topic"], 0.95).withColumn("quantile", F.round("quantile", 9))


@query("WITH w AS (SELECT event_type AS type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) SELECT type, strftime(s, '%Y-%m-%dT%H:%M:%S.%fZ') AS window_start, count(*) AS events, round(count(*) / 43200.0::DOUBLE, 9) AS rate FROM w GROUP BY type, s")
def event_rates(spark, sf_dir):
    found = metrics.rates(event_rows(spark, sf_dir), ["type"], "12 hours", "6 hours")
    return found.select("type", iso(F.timestamp_seconds("window_start")).alias("window_start"), "events", F.round("rate", 9).alias("rate"))


@query(_APPENDS + f""", c AS (SELECT workspace, count(*) AS published, CAST(sum(record_bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE ends_with(topic, '.DLQ') AND type = '{S.FAILURE_TYPE}') AS dead_letters FROM a WHERE NOT deduplicated GROUP BY workspace) SELECT workspace, published, bytes, dead_letters, 2::BIGINT AS topics, 5::BIGINT AS partitions, CASE workspace WHEN 'w0' THEN 2 ELSE 0 END::BIGINT AS groups, CASE workspace WHEN 'w0' THEN 3 WHEN 'w1' THEN 1 ELSE 0 END::BIGINT AS consumers FROM c""")
def workspace_rollup(spark, sf_dir):
    counters = metrics.publish_counters(_appends(spark, sf_dir))
    own = spark.createDataFrame([(w, t) for w in ("w0", "w1", "w2") for t, n in (("events", 4), ("events.DLQ", 1)) for _ in range(n)], "workspace string, topic string")
    named = spark.createDataFrame([("w0", "billing"), ("w0", "audit")], "workspace string, group string")
    members = spark.createDataFrame([("w0", "a"), ("w0", "b"), ("w0", "a"), ("w1", "c")], "workspace string, member string")
    return metrics.workspace_rollup(counters, own, members, named)


_GAUGES = f""", {_LAGS}, n AS (SELECT l.partition, count(*) AS events, CAST(sum(record_bytes) AS BIGINT) AS bytes, any_value(b.oldest) AS oldest, any_value(b.latest) AS latest FROM log l JOIN b ON b.partition = l.partition GROUP BY l.partition),
g AS (SELECT 'broker_disk_bytes' AS metric, '{{partition="' || partition || '",topic="events"}}' AS labels, bytes AS value FROM n UNION ALL SELECT 'partition_oldest_offset', '{{partition="' || partition || '",topic="events"}}', oldest FROM n UNION ALL SELECT 'partition_next_offset', '{{partition="' || partition || '",topic="events"}}', latest FROM n UNION ALL SELECT 'partition_retained_events', '{{partition="' || partition || '",topic="events"}}', events FROM n
UNION ALL SELECT m, '{{group="' || "group" || '",partition="' || partition || '",topic="events"}}', v FROM (SELECT "group", partition, unnest(['consumer_lag', 'consumer_committed_offset', 'consumer_unavailable_events']) AS m, unnest([lag, committed, unavailable]) AS v FROM lags))"""


@query(with_log(_GAUGES + " SELECT metric, metric || labels || ' ' || value AS line FROM g"))
def metrics_exposition(spark, sf_dir):
    bounds = _bounds(spark, sf_dir)
    return metrics.exposition(metrics.long_gauges(bounds, groups.lag(_committed(bounds), bounds)))


@query("SELECT s_suppkey, CAST(CAST(floor(s_acctbal * 20000) AS BIGINT) - 67108864 < 2097152 AS INTEGER) AS pressure FROM supplier")
def storage_pressure(spark, sf_dir):
    disk = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.col("s_acctbal") * 20000).cast("long").alias("available_bytes"))
    return metrics.pressure(disk).drop("available_bytes")


# --- delivery -----------------------------------------------------------------------------------------------

#: The statuses of the delivery tests (fixed values).
HTTP_STATUSES = [200, 301, 400, 401, 403, 404, 408, 422, 425, 429, 500, 503]


def _attempts(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    n = F.col("event_id")
    return e.select(
        n, F.get(F.array(*[F.lit(x) for x in HTTP_STATUSES]), (n % 13).cast("int")).alias("http_status"), (n % 5 + 1).cast("int").alias("attempt"), F.lit(4).alias("max_attempts"), (n % 9 + 1).cast("int").alias("delay"),
        F.get(F.array(F.lit("60"), F.lit("9999999999"), F.lit("-1"), F.lit("garbage")), (n % 5).cast("int")).alias("retry_after"), F.col("timestamp").alias("completed_at"), "user_id",
    )


_ATTEMPTS = f"""WITH a AS (SELECT event_id, user_id, CAST({HTTP_STATUSES}[event_id % 13 + 1] AS INTEGER) AS http_status, CAST(event_id % 5 + 1 AS INTEGER) AS attempt, event_id % 9 + 1 AS delay, CASE event_id % 5 WHEN 0 THEN 60 WHEN 1 THEN 3600 ELSE 0 END AS wish FROM events),
c AS (SELECT *, CASE WHEN http_status BETWEEN 200 AND 299 THEN 'delivered' WHEN http_status IS NOT NULL AND http_status NOT IN (408, 425, 429) AND http_status < 500 THEN 'failed' WHEN attempt >= 4 THEN 'failed' ELSE 'retry' END AS status, CAST(least(delay * pow(2, attempt - 1), 3600) AS BIGINT) AS backoff FROM a)"""


@query(_ATTEMPTS + " SELECT event_id, http_status, attempt, status, CASE WHEN status = 'retry' THEN CASE WHEN http_status IN (429, 503) THEN greatest(backoff, wish) ELSE backoff END END AS next_delay FROM c")
def delivery_classify(spark, sf_dir):
    return delivery.classify(_attempts(spark, sf_dir)).select("event_id", "http_status", "attempt", "status", "next_delay")


@query("SELECT l_orderkey, l_linenumber, CAST(least(l_linenumber * pow(2, l_orderkey % 20), 3600) AS BIGINT) AS delay FROM lineitem")
def delivery_backoff(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", policy.retry_delay(F.col("l_linenumber"), F.col("l_orderkey") % 20 + 1).alias("delay"))


def _history(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in (*delivery.STATUSES, "bogus")])
    n = F.col("event_id")
    return event_rows(spark, sf_dir).select(F.concat(F.lit("sub-"), F.col("user_id") % 7).alias("subscription_id"), F.concat(F.lit("e"), n % 500).alias("event_id"), (n % 3).cast("int").alias("attempt"), F.get(names, (n % 7).cast("int")).alias("status"), n.alias("cursor"))


def _subscriptions(spark):
    return spark.range(7).select(F.concat(F.lit("sub-"), F.col("id")).alias("id"), F.concat(F.lit("w"), F.col("id") % 2).alias("workspace"), (F.col("id") % 3 == 0).alias("paused"))


_HISTORY = f"""WITH r AS (SELECT 'sub-' || (user_id % 7) AS subscription_id, 'e' || (event_id % 500) AS event_id, CAST(event_id % 3 AS INTEGER) AS attempt, {[*delivery.STATUSES, 'bogus']}[event_id % 7 + 1] AS status, event_id AS cursor FROM events), h AS (SELECT subscription_id, event_id, attempt, status, min(cursor) AS cursor FROM r WHERE status <> 'bogus' AND attempt >= 1 GROUP BY ALL)"""


def _first_history(spark, sf_dir):
    rows = _history(spark, sf_dir)
    return delivery.history(rows.groupBy(*delivery.KEY).agg(F.min("cursor").alias("cursor")))


@query(_HISTORY + " SELECT DISTINCT subscription_id, event_id, attempt, status FROM h")
def delivery_history(spark, sf_dir):
    return delivery.history(_history(spark, sf_dir)).select(*delivery.KEY)


@query(_HISTORY + " SELECT subscription_id, event_id, attempt, status, cursor FROM h QUALIFY row_number() OVER (PARTITION BY subscription_id, event_id ORDER BY cursor DESC) = 1")
def delivery_latest(spark, sf_dir):
    return delivery.latest(_first_history(spark, sf_dir))


_ROLLUP = " SELECT 'w' || (CAST(substr(subscription_id, 5) AS INTEGER) % 2) AS workspace, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(*) FILTER (WHERE status IN ('retry', 'failed')) AS failed, count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) FILTER (WHERE status = 'dlq') AS dead_letters FROM h GROUP BY 1"


@query(_HISTORY + _ROLLUP)
def delivery_rollup(spark, sf_dir):
    return delivery.rollup(delivery.history(_history(spark, sf_dir)), _subscriptions(spark))


@query(_HISTORY + _ROLLUP)
def delivery_rollup_increment(spark, sf_dir):
    """The rollup of the older half, then the increment by all records: equal to the whole."""
    rows, subs = _history(spark, sf_dir), _subscriptions(spark)
    seen = delivery.history(rows.filter("cursor % 2 = 0"))
    return delivery.rollup_increment(rows, seen, delivery.rollup(seen, subs), subs)


@query(_HISTORY + " SELECT subscription_id, event_id, attempt, status, cursor FROM h WHERE subscription_id = 'sub-3' AND cursor > 100 ORDER BY cursor LIMIT 50")
def history_keyset(spark, sf_dir):
    rows = _first_history(spark, sf_dir).filter("subscription_id = 'sub-3'")
    return delivery.keyset_page(rows, "cursor", 100, 50)[0]


@query(_HISTORY + ", p AS (SELECT cursor, row_number() OVER (ORDER BY cursor) AS n FROM (SELECT cursor FROM h WHERE subscription_id = 'sub-3' AND cursor > 100 ORDER BY cursor LIMIT 51)) SELECT CAST(coalesce(max(cursor) FILTER (WHERE n <= 50), 100) AS BIGINT) AS next_cursor, count(*) > 50 AS has_more FROM p")
def history_cursor(spark, sf_dir):
    rows = _first_history(spark, sf_dir).filter("subscription_id = 'sub-3'")
    return delivery.keyset_page(rows, "cursor", 100, 50)[1]


@query(_HISTORY + " SELECT subscription_id, event_id, attempt, status, cursor FROM h WHERE subscription_id = 'sub-3' AND cursor > 200 ORDER BY cursor LIMIT 70")
def history_of_workspace(spark, sf_dir):
    """sub-3 belongs to w1: the page is that of its workspace; another workspace's page of it is empty."""
    rows, subs = _first_history(spark, sf_dir), _subscriptions(spark)
    mine, other = (delivery.workspace_page(rows, subs, w, "sub-3", 200, 70)[0] for w in ("w1", "w0"))
    return mine.unionByName(other).select("subscription_id", "event_id", "attempt", "status", "cursor")


@query(_HISTORY + ", l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY subscription_id, event_id ORDER BY cursor DESC) = 1) SELECT subscription_id, event_id, attempt, status, cursor FROM l WHERE CAST(substr(subscription_id, 5) AS INTEGER) % 2 = 1 ORDER BY event_id, subscription_id LIMIT 100")
def delivery_logs(spark, sf_dir):
    return delivery.logs(delivery.latest(_first_history(spark, sf_dir)), _subscriptions(spark), "w1")


#: The attempt state machine by recursion, one step a tick of each subscription, with numbers for statuses (0 none, 1 sending,
#: 2 retry, 3 failed, 4 delivered, 5 dlq). A step keeps what it did; its notes are unfolded at the end.
_TICKS = _ATTEMPTS.replace("WITH a AS", "WITH RECURSIVE a AS", 1) + f""",
t AS MATERIALIZED (SELECT user_id % 7 AS sub, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id % 7) AS n, event_id AS tick, event_id * 2 AS tm, http_status AS code, event_id % 19 = 0 AS crash, delay, CASE WHEN http_status IN (429, 503) THEN wish ELSE 0 END AS wish FROM a),
s AS (SELECT DISTINCT CAST(sub AS BIGINT) AS sub, 0::BIGINT AS k, 0::BIGINT AS pos, 0 AS status, 0 AS attempt, 0::BIGINT AS nxt, 0::BIGINT AS o_pos, 0 AS o_status, 0 AS o_attempt, 0::BIGINT AS o_next, true AS over, false AS waits, false AS lost, false AS sends, false AS answers, 0 AS answer, 0 AS tried, 0 AS final, 0::BIGINT AS later, 0::BIGINT AS tick, 0::BIGINT AS tm FROM t
UNION ALL SELECT CAST(sub AS BIGINT), k, CASE WHEN final IN (4, 5) THEN pos + 1 ELSE pos END, CASE WHEN final IN (4, 5) THEN 0 ELSE final END, CASE WHEN final IN (4, 5) THEN 0 ELSE tried END, CASE WHEN final IN (4, 5) THEN 0 ELSE later END, pos, status, attempt, nxt, over, waits, lost, sends, answers, answer, tried, final, later, CAST(tick AS BIGINT), CAST(tm AS BIGINT)
 FROM (SELECT *, CASE WHEN over OR waits THEN status WHEN answers THEN CASE WHEN answer = 3 THEN 5 ELSE answer END WHEN sends THEN 1 ELSE 5 END AS final, CAST(CASE WHEN over OR waits THEN nxt WHEN answers THEN CASE WHEN answer = 2 THEN tm + greatest(CAST(least(delay * pow(2, tried - 1), {S.MAX_DELAY}) AS BIGINT), wish) ELSE tm END WHEN sends THEN tm + 30 ELSE nxt END AS BIGINT) AS later
 FROM (SELECT *, CASE WHEN code BETWEEN 200 AND 299 THEN 4 WHEN code IS NOT NULL AND code NOT IN (408, 425, 429) AND code < 500 OR tried >= 4 THEN 3 ELSE 2 END AS answer
 FROM (SELECT *, sends AND NOT crash AS answers, attempt + CAST(sends AS INTEGER) AS tried
 FROM (SELECT *, NOT over AND NOT waits AND status = 1 AS lost, NOT over AND NOT waits AND attempt < 4 AS sends
 FROM (SELECT t.*, s.pos, s.status, s.attempt, s.nxt, s.pos >= t.n AS over, s.pos < t.n AND t.tm < s.nxt AS waits FROM s JOIN t ON t.sub = s.sub AND t.k = s.k + 1)))))),
e AS (SELECT sub, tick, o_pos, 'wait' AS action, o_status AS status, o_attempt AS attempt, o_next AS next_at FROM s WHERE waits
UNION ALL SELECT sub, tick, o_pos, 'record', 6, o_attempt, o_next FROM s WHERE lost UNION ALL SELECT sub, tick, o_pos, 'send', 1, tried, tm + 30 FROM s WHERE sends
UNION ALL SELECT sub, tick, o_pos, 'answer', answer, tried, later FROM s WHERE answers UNION ALL SELECT sub, tick, o_pos, 'dead letter', 5, tried, later FROM s WHERE final = 5 AND NOT over AND NOT waits)
SELECT 'sub-' || e.sub AS subscription_id, e.tick, 'e' || q.tick AS event_id, e.action, ['', 'sending', 'retry', 'failed', 'delivered', 'dlq', 'unknown'][e.status + 1] AS status, CAST(e.attempt AS INTEGER) AS attempt, e.next_at FROM e JOIN t q ON q.sub = e.sub AND q.k = e.o_pos + 1"""


@query(_TICKS)
def delivery_ticks(spark, sf_dir):
    """The attempt state machine over answers made from the events; each subscription's log has as many events as ticks."""
    a, n = _attempts(spark, sf_dir), F.col("event_id")
    rows = a.select(F.concat(F.lit("sub-"), F.col("user_id") % 7).alias("subscription_id"), F.lit(0).alias("partition"), n.alias("tick"), (n * 2).alias("at"), "http_status", (n % 19 == 0).alias("crash"), "max_attempts", "delay", "retry_after")
    places = log.number_rows(rows, ["subscription_id"], ["tick"], "offset", F.floor(F.col("tick") / 100_000)).select("subscription_id", "offset", F.concat(F.lit("e"), "tick").alias("event_id"))
    ends = rows.groupBy("subscription_id").agg(F.count("*").alias("end"))
    found = delivery.run_ticks(rows.join(ends, "subscription_id"))
    return found.join(places, ["subscription_id", "offset"]).select("subscription_id", "tick", "event_id", "action", "status", "attempt", "next_at")


@query("""WITH RECURSIVE src AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq FROM events),
w AS (SELECT key, min(ts) AS since FROM src GROUP BY key UNION ALL SELECT * FROM (SELECT w.key, (SELECT min(s.ts) FROM src s WHERE s.key = w.key AND s.ts >= w.since + INTERVAL 6 HOUR) AS since FROM w) WHERE since IS NOT NULL)
SELECT src.key, seq, row_number() OVER (PARTITION BY src.key, w.since ORDER BY ts, seq) <= 2 AS allowed FROM src ASOF JOIN w ON src.key = w.key AND src.ts >= w.since""")
def rate_limit(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    return delivery.rate_limited(e.select("key", (F.unix_micros("timestamp") / 1e6).alias("at"), F.col("event_id").alias("seq")), 2, 6 * 3600.0)


# --- dead letters -------------------------------------------------------------------------------------------


def _failed(spark, sf_dir):
    """Every event of the log whose delivery failed; some records break a rule of the parser."""
    outcome = delivery.classify(_attempts(spark, sf_dir)).filter("status = 'failed'").select("event_id", "attempt")
    n = F.col("event_id")
    rows = event_log(spark, sf_dir).join(outcome, "event_id").withColumn("headers", F.lit(None).cast("map<string,string>"))
    return rows.withColumns({"subscription_id": F.when(n % 31 == 0, "").otherwise(F.concat(F.lit("sub-"), n % 7)), "attempts": F.when(n % 29 == 0, 0).otherwise(F.col("attempt")), "error": F.lit("http 500"), "failed_at": F.lit("2024-01-01T00:00:00Z")})


def _dead_letters(spark, sf_dir):
    """The dead-letter topic's one partition, numbered by event in stretches; some events are of another type or don't parse."""
    rows = deadletters.envelopes(_failed(spark, sf_dir)).withColumns({"workspace": F.lit("demo"), "id": F.concat(F.lit("d"), F.col("key")), "n": F.col("key").cast("long")})
    rows = log.number_rows(rows, ["workspace", "topic", "partition"], ["n"], "offset", F.floor(F.col("n") / 100_000))
    return rows.withColumns({"type": F.when(F.col("n") % 37 == 0, "other").otherwise(F.col("type")), "data": F.when(F.col("n") % 41 == 0, "{}").otherwise(F.col("data"))})


_FAILED = f""", o AS ({_ATTEMPTS} SELECT event_id, attempt FROM c WHERE status = 'failed'),
f AS (SELECT log.*, CASE WHEN event_id % 31 = 0 THEN '' ELSE 'sub-' || (event_id % 7) END AS sub, CASE WHEN event_id % 29 = 0 THEN 0 ELSE attempt END AS attempts, event_id % 29 = 0 OR event_id % 31 = 0 OR event_id % 37 = 0 OR event_id % 41 = 0 AS malformed FROM log JOIN o USING (event_id)),
d AS (SELECT *, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS place, CASE (row_number() OVER (ORDER BY event_id) - 1) % 4 WHEN 0 THEN 'retry' WHEN 1 THEN 'discard' END AS action, CASE (row_number() OVER (ORDER BY event_id) - 1) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'complete' END AS status FROM f)"""
_ENVELOPE = """'{"original_event":{"id":"' || id || '","topic":"events","partition":' || partition || ',"offset":' || "offset" || ',"type":"' || type || '","key":"' || key || '","headers":{},"data":' || to_json(data) || '},"original_topic":"events","original_partition":' || partition || ',"original_offset":' || "offset" || ',"subscription_id":"' || sub || '","attempts":' || attempts || ',"error":"http 500","failed_at":"2024-01-01T00:00:00Z"}'"""


@query(with_log(_FAILED + f" SELECT 'events.DLQ' AS topic, 0 AS partition, id AS key, '{S.FAILURE_TYPE}' AS type, {_ENVELOPE} AS data FROM f"))
def dlq_envelope(spark, sf_dir):
    return deadletters.envelopes(_failed(spark, sf_dir))


@query(with_log(_FAILED + " SELECT place AS \"offset\", malformed, CASE WHEN NOT malformed THEN id END AS original_id, CASE WHEN NOT malformed THEN \"offset\" END AS original_offset FROM d"))
def dlq_parse(spark, sf_dir):
    return deadletters.parse(_dead_letters(spark, sf_dir)).select("offset", "malformed", F.col("failure.original_event.id").alias("original_id"), F.col("failure.original_offset").alias("original_offset"))


def _decisions(events):
    k = F.col("offset") % 4
    return events.filter(k < 2).select(*deadletters.PLACE, F.when(k == 0, "retry").otherwise("discard").alias("action"), F.when(k == 0, "pending").otherwise("complete").alias("status"))


@query(with_log(_FAILED + ' SELECT place AS "offset", malformed, action, status FROM d'))
def dlq_with_decisions(spark, sf_dir):
    events = _dead_letters(spark, sf_dir)
    return deadletters.listed(events, _decisions(events)).select("offset", "malformed", "action", "status")


@query(with_log(_FAILED + """ SELECT place AS "offset", 'retry' AS action, CASE WHEN malformed THEN 'malformed' WHEN action = 'retry' THEN 'done before' WHEN action IS NOT NULL THEN 'conflict' ELSE 'pending' END AS verdict FROM d UNION ALL SELECT -1, 'retry', 'missing'"""))
def dlq_resolve(spark, sf_dir):
    events = _dead_letters(spark, sf_dir)
    wanted = events.select(*deadletters.PLACE).unionByName(spark.createDataFrame([("demo", "events.DLQ", 0, -1)], "workspace string, topic string, partition int, offset long"))
    return deadletters.resolve(events, _decisions(events), wanted.withColumn("action", F.lit("retry"))).select("offset", "action", "verdict")


@query(with_log(_FAILED + f""" SELECT 'events' AS target, 'd' || id AS id, type, key, data, '{S.PREFIX}.dlq.original_id=' || id || ';{S.PREFIX}.dlq.source_id=d' || id || ';{S.PREFIX}.dlq.source_offset=' || place || ';{S.PREFIX}.dlq.source_partition=0' AS headers FROM d WHERE NOT malformed"""))
def dlq_retry_headers(spark, sf_dir):
    rows = deadletters.retries(deadletters.parse(_dead_letters(spark, sf_dir)))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("target", "id", "type", "key", "data", headers.alias("headers"))


@query(with_log(_FAILED + " SELECT place AS \"offset\", action FROM d WHERE status = 'pending' ORDER BY place LIMIT 1"))
def dlq_next_pending(spark, sf_dir):
    return deadletters.next_pending(_decisions(_dead_letters(spark, sf_dir))).select("offset", "action")


@query(with_log(""", m AS (SELECT partition, max("offset") + 1 AS n FROM log GROUP BY partition), p AS (SELECT partition, CASE WHEN "offset" % 5 = 4 THEN n ELSE "offset" END AS o, n, CASE WHEN "offset" % 5 = 1 THEN 'other' ELSE id END AS id, CASE WHEN "offset" % 5 = 2 THEN 'other' ELSE type || '|' || data END AS fp FROM log JOIN m USING (partition))
SELECT p.partition, CAST(p.o AS BIGINT) AS "offset", p.id, CASE WHEN l.id IS NOT NULL THEN CASE WHEN l.id = p.id AND l.type || '|' || l.data = p.fp THEN 'complete' ELSE 'conflict' END WHEN p.o = p.n THEN 'append' ELSE 'conflict' END AS action FROM p LEFT JOIN log l ON l.partition = p.partition AND l."offset" = p.o"""))
def outbox_recover(spark, sf_dir):
    """Recovery over the whole log: of every five prepared appends two differ from what is there, one is still to be appended."""
    rows = event_log(spark, sf_dir).withColumn("fingerprint", F.concat("type", F.lit("|"), "data"))
    ends = F.broadcast(log.bounds(rows, partitions(spark)).select("partition", "next"))  # a row a partition
    o = F.col("offset")
    pending = rows.join(ends, "partition").select("topic", "partition", F.when(o % 5 == 4, F.col("next")).otherwise(o).alias("offset"), F.when(o % 5 == 1, "other").otherwise(F.col("id")).alias("id"), F.when(o % 5 == 2, "other").otherwise(F.col("fingerprint")).alias("fingerprint"), "next")
    return replay.recover(pending, rows).select("partition", "offset", "id", "action")


@query(with_log(""", p AS (SELECT *, CAST(row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS BIGINT) AS o FROM log), m AS (SELECT partition, max("offset") + 1 AS n FROM log GROUP BY partition) SELECT p.id, partition, CAST(n + o AS BIGINT) AS "offset" FROM p JOIN m USING (partition)"""))
def outbox_reserve(spark, sf_dir):
    """Places for a second copy of every event, behind the log's end."""
    rows = event_log(spark, sf_dir)
    return replay.reserve(rows.drop("offset"), log.bounds(rows, partitions(spark)), ["timestamp", "event_id"], F.to_date("timestamp")).select("id", "partition", "offset")


# --- metadata and policy predicates -------------------------------------------------------------------------

_ROLES = ["owner", "admin", "developer", "viewer", "key"]


@query(f"""WITH p AS (SELECT c_custkey, {_ROLES}[c_custkey % 5 + 1] AS role, CASE c_custkey % 4 WHEN 0 THEN ['topic:events:read'] WHEN 1 THEN ['topic:*:produce', 'metrics:read'] WHEN 2 THEN ['admin'] ELSE ['topic:orders:read'] END AS scopes, ['read', 'produce', 'admin'][c_custkey % 3 + 1] AS action FROM customer)
SELECT c_custkey, CASE WHEN role IN ('owner', 'admin') THEN true WHEN role = 'developer' THEN action <> 'admin' WHEN role = 'viewer' THEN action = 'read' ELSE list_has_any(scopes, ['admin', 'topic:events:' || action, 'topic:*:' || action]) END AS allowed, role <> 'key' OR list_has_any(scopes, ['admin', 'metrics:read']) AS metrics FROM p""")
def scope_allowed(spark, sf_dir):
    n = F.col("c_custkey")
    arrays = [F.array(*[F.lit(x) for x in s]) for s in (["topic:events:read"], ["topic:*:produce", "metrics:read"], ["admin"], ["topic:orders:read"])]
    c = table(spark, sf_dir, "customer").select(n, F.get(F.array(*[F.lit(r) for r in _ROLES]), (n % 5).cast("int")).alias("role"), F.when(n % 4 == 0, arrays[0]).when(n % 4 == 1, arrays[1]).when(n % 4 == 2, arrays[2]).otherwise(arrays[3]).alias("scopes"), F.get(F.array(F.lit("read"), F.lit("produce"), F.lit("admin")), (n % 3).cast("int")).alias("action"))
    return c.select("c_custkey", policy.allowed(F.col("role"), F.col("scopes"), F.lit("events"), F.col("action")).alias("allowed"), policy.metrics_allowed(F.col("role"), F.col("scopes")).alias("metrics"))


#: Ways that a page's URL is bent, so that every branch is met (see url_check).
_BENT = {2: "https://u:p@", 3: "https://10.0.0.1/", 4: "https://a.example:8443/", 5: "https://[::1]/", 6: "https://[2606:4700::1]:443/", 7: "https://8.8.8.8/", 8: "https://[::ffff:192.168.0.1]/", 9: "https://[fd00::1]:80/"}
_BENT_SQL = " ".join(f"WHEN {k} THEN '{v}'" for k, v in _BENT.items())


@query(f"""WITH u AS (SELECT page_id, page_id % 13 AS k, CASE page_id % 13 {_BENT_SQL} WHEN 10 THEN repeat('x', 3000) WHEN 11 THEN 'https:///' WHEN 12 THEN replace(url, 'http://', 'https://') ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN url IS NULL OR strlen(url) > 2048 THEN 'length' WHEN NOT starts_with(lower(url), 'https://') OR k = 11 THEN 'scheme' WHEN k = 2 THEN 'credentials' WHEN contains(url, '#') THEN 'fragment' WHEN k IN (4, 9) THEN 'port' WHEN k IN (3, 5, 8) THEN 'address' END AS error FROM u""")
def url_check(spark, sf_dir):
    """Delivery URLs of every kind: the pages' own and bent ones, by page."""
    k = (F.col("page_id") % 13).cast("int")
    bent = F.element_at(F.create_map(*[F.lit(x) for pair in _BENT.items() for x in pair]), k)
    url = F.when(k < 2, F.col("url")).when(k == 10, F.concat(F.repeat(F.lit("x"), F.lit(3000)), F.lit("x"))).when(k == 11, "https:///x").when(k == 12, F.replace("url", F.lit("http://"), F.lit("https://"))).otherwise(F.concat(bent, F.lit("x")))
    return table(spark, sf_dir, "pages").select("page_id", policy.url_error(url).alias("error"))


#: Delivery headers by customer, one kind for each rule (see header_check).
_HEADERS = ["map('X-A', '1')", "map('a b', '1')", "map('a', 'é')", "map('Host', 'x')", "map('a', '1', 'A', '2')", "map('a', repeat('x', 1025))", "map()", "map('X-Forwarded-For', 'y')", "map('a', concat('x', char(10)))"]
_HEADER_ERRORS = [None, "name", "value", "reserved", "duplicate", "size", None, "reserved", "value"]


def _headers(n):
    return F.expr("CASE " + " ".join(f"WHEN k = {k} THEN {h}" for k, h in enumerate(x if x != "map()" else "map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))" for x in _HEADERS)) + " END")


@query(f"SELECT c_custkey, {_HEADER_ERRORS}[c_custkey % 9 + 1] AS error FROM customer".replace("None", "NULL"))
def header_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % len(_HEADERS))
    return c.select("c_custkey", policy.headers_error(_headers(F.col("k"))).alias("error"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'url: scheme' WHEN strlen(c_name) * (c_custkey % 5) NOT BETWEEN 32 AND 1024 THEN 'secret' WHEN c_custkey % 25 NOT BETWEEN 1 AND 20 THEN 'max_attempts' WHEN c_custkey % 4000 NOT BETWEEN 1 AND 3600 THEN 'delay' END AS error FROM customer""")
def subscription_check(spark, sf_dir):
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(n, F.when(n % 3 == 1, "http://a.example").otherwise("https://a.example/x").alias("url"), F.repeat("c_name", (n % 5).cast("int")).alias("secret"), (n % 25).alias("max_attempts"), (n % 4000).alias("delay"), F.create_map(F.lit("X-A"), F.lit("1")).alias("headers"))
    return rows.select("c_custkey", delivery.subscription_error(rows).alias("error"))


_SOME_JSON = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props || ',' WHEN 2 THEN '[' || props || ', 1e3]' WHEN 3 THEN replace(props, ':', ';') ELSE '[true, null, -0.5]' END"


@query(f"SELECT event_id, json_valid({_SOME_JSON}) AS valid FROM events")
def json_valid(spark, sf_dir):
    from tidelog.functions import jsonsem

    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_SOME_JSON).alias("data"))
    return rows.select("event_id", jsonsem.is_valid_json(F.col("data")).alias("valid"))


@query(with_log(f"""SELECT partition, "offset", 'id: ' || "offset" || chr(10) || 'data: {{"id":"' || id || '","topic":"events","partition":' || partition || ',"offset":' || "offset" || ',"timestamp":"' || {ISO} || '","type":"' || type || '","key":"' || key || '","data":' || data || '}}' || chr(10) || chr(10) AS frame FROM log"""))
def tail_frames(spark, sf_dir):
    """What a tail from the log's start sends, frame by frame."""
    from tidelog.streaming import streams

    return streams.frames(event_log(spark, sf_dir))


def _denied_sql() -> str:
    import ipaddress

    return " OR ".join(f"n BETWEEN {int(x.network_address)} AND {int(x.broadcast_address)}" for x in map(ipaddress.ip_network, policy.DENIED) if x.version == 4)


@query(f"WITH i AS (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS n FROM customer) SELECT c_custkey, NOT ({_denied_sql()}) AS is_public FROM i")
def public_ip(spark, sf_dir):
    n = (F.col("c_custkey") * 2654435761) % (1 << 32)
    dotted = F.concat_ws(".", *[(F.floor(n / (1 << 8 * (3 - k))) % 256).cast("string") for k in range(4)])
    return table(spark, sf_dir, "customer").select("c_custkey", policy.public_ipv4(dotted).alias("is_public"))


_NAMES_OF = "CASE c_custkey % 7 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '.') WHEN 2 THEN '.' || c_name WHEN 3 THEN c_name || '/x' WHEN 4 THEN '..' WHEN 5 THEN repeat('n', CAST(c_custkey % 200 AS INTEGER)) ELSE 'é' || c_name END"


@query(f"WITH n AS (SELECT c_custkey, {_NAMES_OF} AS name FROM customer) SELECT c_custkey, name, regexp_full_match(name, '[a-zA-Z0-9][a-zA-Z0-9._-]{{0,127}}') AS valid, sha256(name) AS digest FROM n")
def name_check(spark, sf_dir):
    from tidelog.functions.hashing import digest

    name = F.expr(_NAMES_OF)
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).select("*", policy.valid_name(F.col("name")).alias("valid"), digest(F.col("name")).alias("digest"))


@query("""SELECT o_orderkey, o_custkey AS user_id, c_mktsegment AS workspace, CASE c_nationkey % 2 WHEN 0 THEN 'viewer' ELSE 'developer' END AS role FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate + INTERVAL 12 HOUR > (SELECT max(o_orderdate) - INTERVAL 200 DAY FROM orders)""")
def session_principals(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    now = o.agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0]
    memberships = c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("workspace"), F.when(F.col("c_nationkey") % 2 == 0, "viewer").otherwise("developer").alias("role"))
    sessions = o.select(F.col("o_orderkey").alias("token_hash"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("expires_at"))
    sessions = sessions.join(memberships.select("user_id", "workspace"), "user_id")
    return metadata.principals(sessions, memberships, F.lit(now) - F.expr("INTERVAL 200 DAYS")).withColumnRenamed("token_hash", "o_orderkey")


@query("SELECT s.c_custkey AS user_id, n_name AS workspace, c_mktsegment AS role FROM customer s JOIN nation ON n_regionkey = c_nationkey % 5 WHERE c_name = (SELECT min(c_name) FROM customer)")
def login_memberships(spark, sf_dir):
    """A user with a workspace for each nation of a region."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    who = c.agg(F.min("c_name")).first()[0]
    users = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.lit("").alias("password_hash"))
    memberships = c.join(n, F.col("n_regionkey") == F.col("c_nationkey") % 5).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("workspace"), F.col("c_mktsegment").alias("role"))
    return metadata.login(users, memberships, who).drop("password_hash")


@query("SELECT o_custkey AS id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    last = o.agg(F.max("version")).first()[0]
    old = o.filter(F.col("version") <= last // 2)
    return metadata.upsert(old, o.filter(F.col("version") > last // 2), ["id"], "version")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey % 3 = 1 ORDER BY s_suppkey LIMIT 1000")
def subscription_list(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 3).cast("string").alias("workspace"))
    return metadata.subscriptions(s, "1").drop("workspace")


@query(with_log(", t AS (SELECT 'events' AS name, count(*) AS events, CAST(sum(record_bytes) AS BIGINT) AS bytes FROM log) SELECT name, 4 AS partitions, events, bytes FROM t UNION ALL SELECT 'audit', 2, NULL, NULL"))
def topic_list(spark, sf_dir):
    config = spark.createDataFrame([("demo", "events", 4), ("demo", "audit", 2), ("other", "secret", 1)], "workspace string, name string, partitions int")
    return scan.topics(config, log.bounds(event_log(spark, sf_dir), partitions(spark)), "demo").select("name", "partitions", "events", "bytes")


@query(with_log("SELECT id, partition, 'left' AS side FROM log WHERE \"offset\" % 50 = 7"))
def copy_integrity(spark, sf_dir):
    rows = event_log(spark, sf_dir).select("id", "partition", "offset")
    return metadata.differs(rows, rows.filter("offset % 50 <> 7")).select("id", "partition", "side")
