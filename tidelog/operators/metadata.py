"""Relational statements over the service's metadata: logins and keys (J2, J3), subscriptions (O6), upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def login(users: DataFrame, memberships: DataFrame, email: str) -> DataFrame:
    """A user's memberships."""
    return users.filter(F.col("email") == email).join(memberships, users["id"] == memberships["user_id"]).select("user_id", "workspace", "role", "password_hash")


def principals(sessions: DataFrame, memberships: DataFrame, now: Column) -> DataFrame:
    """Live sessions with their roles."""
    return sessions.filter(F.col("expires_at") > now).join(memberships, ["user_id", "workspace"]).select("token_hash", "user_id", "workspace", "role")


def usable_keys(keys: DataFrame, now: Column) -> DataFrame:
    """API keys that are neither revoked nor expired, with the time of use (one UPDATE ... RETURNING in SQL)."""
    return keys.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now)).withColumn("last_used_at", now)


def subscriptions(rows: DataFrame, workspace: str, limit: int = 1000) -> DataFrame:
    return rows.filter(F.col("workspace") == workspace).orderBy("id").limit(limit)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row of each key; Parquet has no MERGE, so facts are appended and the newest wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(version))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def backfill(attempts: DataFrame, history: DataFrame) -> DataFrame:
    """History rows made from attempt documents (JSON) that have none yet."""
    a = F.col("attempt")
    rows = attempts.select("subscription_id", "event_id", F.get_json_object(a, "$.attempts").cast("int").alias("attempt"), F.get_json_object(a, "$.status").alias("status"))
    return rows.filter("attempt >= 1").join(history, ["subscription_id", "event_id", "attempt", "status"], "left_anti").dropDuplicates()


def differs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one table but not as often in the other: the integrity check of a copy."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
