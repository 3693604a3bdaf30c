"""Consumer groups: starts (G1), assignment (G2, O4, J10), lag (G8, J7, M5) and the command log's fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators.fold import ordered_fold


def start(bounds: DataFrame, group: str, at: str) -> DataFrame:
    """A new group's committed offsets at earliest or latest; epoch 1 (G1)."""
    if at not in ("earliest", "latest"):
        raise S.Invalid("start must be earliest or latest")
    return bounds.select("topic", "partition", F.lit(group).alias("group"), F.lit(1).cast("long").alias("epoch"), F.col("oldest" if at == "earliest" else "next").alias("committed"))


def assignment(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """Owner of every partition: members sorted by id, partition modulo their number.

    members: group, member. partitions: group, partition. A group has MAX_MEMBERS members at most, so its window is small.
    """
    w = Window.partitionBy("group").orderBy("member")
    ranked = members.withColumns({"rank": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("group"))})
    sizes = ranked.select("group", "n").distinct()
    return partitions.join(sizes, "group").withColumn("rank", F.col("partition") % F.col("n")).join(ranked.select("group", "rank", "member"), ["group", "rank"]).select("group", "partition", "member")


def live_members(members: DataFrame, now) -> DataFrame:
    """Members whose time isn't over: expired if until <= now."""
    return members.filter(F.col("until") > now)


def lag(committed: DataFrame, bounds: DataFrame) -> DataFrame:
    """committed, latest, oldest, lag and unavailable of every group's partition."""
    joined = committed.join(bounds.select("topic", "partition", "oldest", F.col("next").alias("latest")), ["topic", "partition"])
    return joined.withColumns({"lag": F.col("latest") - F.col("committed"), "unavailable": F.greatest(F.col("oldest") - F.col("committed"), F.lit(0).cast("long"))})


def metrics(committed: DataFrame, bounds: DataFrame, members: DataFrame, leases: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Gauges of every group's partition (with in_flight) and of every group (members), at an instant (M5).

    members: topic, group, member, until. leases: topic, group, partition, member, until. A lease counts while it and its
    member live. A committed offset beyond the log is an error, raised when the rows are read.
    """
    live = live_members(members, now)
    keys = ["topic", "group"]
    held = leases.filter(F.col("until") > now).join(live.select(*keys, "member"), [*keys, "member"], "left_semi").select(*keys, "partition").distinct()
    rows = lag(committed, bounds).join(held.withColumn("in_flight", F.lit(True)), [*keys, "partition"], "left").withColumn("in_flight", F.coalesce("in_flight", F.lit(False)))
    wrong = (F.col("committed") < 0) | (F.col("committed") > F.col("latest"))
    rows = rows.withColumn("committed", F.when(wrong, F.raise_error(F.lit("group committed offset is outside the log")).cast("long")).otherwise(F.col("committed")))
    count = live.groupBy(*keys).agg(F.count_distinct("member").alias("members"))
    return rows, committed.select(*keys).distinct().join(count, keys, "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))


def inspect(assigned: DataFrame, lags: DataFrame) -> DataFrame:
    """Per group and member: partitions and their lag."""
    rows = assigned.join(lags.select("group", "partition", "lag"), ["group", "partition"])
    return rows.groupBy("group", "member").agg(F.sort_array(F.collect_list("partition")).alias("partitions"), F.sum("lag").alias("lag"))


FOLDED = "group string, seq long, command string, member string, partition int, verdict string, epoch long, committed long, events long"


def fold_commands(commands: DataFrame, partitions: int, ttl: int, visibility: int, start: int = 0) -> DataFrame:
    """Runs a log of commands through the coordinator's state machine, group by group.

    commands: group, seq, at (seconds), command (join, leave, pull, ack, nack, commit, reset), member, epoch (null: the
    current one), partition, token (null: the partition's current one), offset, limit, end (the partition's high
    watermark, all partitions alike). Returns each command's verdict (ok, fenced or invalid), the epoch after it, the
    partition's committed offset and the number of events a pull returned.
    """

    def begin(row):
        return {"epoch": 1, "offsets": dict.fromkeys(range(partitions), start), "members": {}, "leases": {}, "tokens": 0}

    def bump(s):
        s["epoch"] += 1
        s["leases"] = {}

    def owner(s, p):
        ids = sorted(s["members"])
        return ids[p % len(ids)] if ids else None

    def step(s, row):
        now, what, who, p = row["at"], row["command"], row["member"], row["partition"]
        expired = [m for m, until in s["members"].items() if until <= now]
        for m in expired:
            del s["members"][m]
        if expired:
            bump(s)
        verdict, events = "ok", 0
        epoch = s["epoch"] if row["epoch"] is None else row["epoch"]
        if what == "join":
            if who not in s["members"] and len(s["members"]) >= S.MAX_MEMBERS:
                verdict = "invalid"
            else:
                if who not in s["members"]:
                    bump(s)
                s["members"][who] = now + ttl
        elif what == "leave":
            if s["members"].pop(who, None) is not None:
                bump(s)
        elif what == "reset":
            if s["members"]:
                verdict = "fenced"
            elif row["offset"] is None or not 0 <= row["offset"] <= row["end"]:
                verdict = "invalid"
            else:
                s["offsets"][p] = row["offset"]
                bump(s)
        elif what == "pull":
            if epoch != s["epoch"] or who not in s["members"]:
                verdict = "fenced"
            else:
                s["members"][who] = now + ttl
                taken = 0
                for q in range(partitions):
                    lease = s["leases"].get(q)
                    if owner(s, q) != who or lease and lease["until"] > now:
                        continue
                    n = min(row["limit"], row["end"] - s["offsets"][q])
                    if n <= 0:
                        continue
                    s["tokens"] += 1
                    s["leases"][q] = {"token": s["tokens"], "member": who, "next": s["offsets"][q] + n, "until": now + visibility}
                    events += n
                    taken += 1
                    if taken >= S.MAX_DELIVERIES:
                        break
        else:
            lease = s["leases"].get(p)
            token = row["token"] if row["token"] is not None else lease and lease["token"]
            if not lease or epoch != s["epoch"] or lease["member"] != who or lease["token"] != token or lease["until"] <= now or owner(s, p) != who:
                verdict = "fenced"
            elif what == "commit" and not s["offsets"][p] < row["offset"] <= lease["next"]:
                verdict = "invalid"
            else:
                if what != "nack":
                    s["offsets"][p] = row["offset"] if what == "commit" else lease["next"]
                del s["leases"][p]
        return [{"group": row["group"], "seq": row["seq"], "command": what, "member": who, "partition": p, "verdict": verdict, "epoch": s["epoch"], "committed": s["offsets"].get(p), "events": events}]

    return ordered_fold(commands, ["group"], ["seq"], begin, step, FOLDED)


def consumed(folded: DataFrame) -> DataFrame:
    """Events returned by pulls, redeliveries included (M9)."""
    return folded.groupBy("group").agg(F.sum("events").alias("consumed"))


def reload(state: DataFrame) -> DataFrame:
    """State after a restart: the next epoch, nobody joined."""
    return state.withColumn("epoch", F.col("epoch") + 1)
