"""Table operations on users and refresh tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .upsert import insert_unique, patch

ROLES = ["user", "admin"]


def create_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with ``created``: false where the e-mail is taken, or is claimed by an earlier row."""
    new = insert_unique(users, incoming, ["email"], [F.col("created_at"), F.col("id")]).select("id", F.lit(True).alias("created"))
    return incoming.join(new, "id", "left").withColumn("created", F.coalesce("created", F.lit(False)))


def by_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.col("email") == email)


def update_users(users: DataFrame, changes: DataFrame, columns: list[str], as_of: Column, set_col: str | None = None) -> DataFrame:
    """Set columns (see :func:`patch`) replace the old ones, and ``updated_at`` moves for rows that were named."""
    named = changes.select("id", F.lit(True).alias("__named"))
    out = patch(users, changes, "id", columns, set_col).join(named, "id", "left")
    return out.withColumn("updated_at", F.when(F.col("__named"), as_of).otherwise(F.col("updated_at"))).select(*users.columns)


def set_role(users: DataFrame, user_id: object, role: str) -> DataFrame:
    if role not in ROLES:
        raise ValueError(f"a role is one of {ROLES}")
    return users.withColumn("role", F.when(F.col("id") == user_id, role).otherwise(F.col("role")))


def revoke(tokens: DataFrame, token: str) -> DataFrame:
    return tokens.withColumn("revoked", F.col("revoked") | F.coalesce(F.col("token") == token, F.lit(False)))
