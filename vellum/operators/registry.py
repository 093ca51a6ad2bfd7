"""Identities seen, and rows kept for a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identities(events: DataFrame) -> DataFrame:
    """Authenticated events with an email: ``key, email, name, ts``; the key is the oid, else the email."""
    email = F.lower(F.trim("email"))
    rows = events.where(F.col("authenticated") & (F.coalesce(email, F.lit("")) != ""))
    return rows.select(F.when(F.coalesce("oid", F.lit("")) != "", F.col("oid")).otherwise(email).alias("key"), email.alias("email"), F.nullif(F.trim("name"), F.lit("")).alias("name"), "ts")


def seen(rows: DataFrame) -> DataFrame:
    """First and last sight of each key, with its latest email and newest name that is not empty."""
    return rows.groupBy("key").agg(
        F.max_by("email", F.struct("ts", "email")).alias("email"),
        F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("ts", "name"))).alias("name"),
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"),
    )


def observed_users(events: DataFrame, merge_emails: bool = False) -> DataFrame:
    """One row an identity.  ``merge_emails`` joins keys whose latest email is the same, under the newest key."""
    found = seen(identities(events))
    if not merge_emails:
        return found
    last = F.struct("last_seen_at", "key")
    return found.groupBy("email").agg(
        F.max_by("key", last).alias("key"), F.max_by("name", F.when(F.col("name").isNotNull(), last)).alias("name"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    ).select("key", "email", "name", "first_seen_at", "last_seen_at")


def merge_users(users: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of identities with those that a stream has handed on since, one a key."""
    last = F.struct("last_seen_at", "email")
    return users.unionByName(changed).groupBy("key").agg(
        F.max_by("email", last).alias("email"), F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("last_seen_at", "name"))).alias("name"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )


def users_by_recency(users: DataFrame) -> DataFrame:
    return users.orderBy(F.desc("last_seen_at"), "key")


def search_users(users: DataFrame, query: str) -> DataFrame:
    return users.where(F.lower(F.concat_ws(" ", "name", "email")).contains(query.lower().strip()))


def retention_filter(rows: DataFrame, as_of: Column, minutes: int = 30, created: str = "created_at") -> DataFrame:
    """Rows not older than ``minutes`` at ``as_of``."""
    return rows.where(F.col(created) + F.make_dt_interval(mins=F.lit(minutes)) > as_of)


def scrub_expired(rows: DataFrame, as_of: Column, content: list[str], minutes: int = 30, created: str = "created_at") -> DataFrame:
    """All rows; the ``content`` columns of expired ones are null."""
    live = F.col(created) + F.make_dt_interval(mins=F.lit(minutes)) > as_of
    return rows.withColumns({c: F.when(live, F.col(c)) for c in content}).withColumn("expired", ~live)
