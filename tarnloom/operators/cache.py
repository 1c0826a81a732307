"""The expiring answer cache: first writer wins, but an expired entry counts as none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .upsert import latest

TTL_SECONDS = 3600
KEY = "idempotency_key"


def live(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") > as_of)


def lookup(cache: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """``requests`` with the live answer, null where there is none, and ``cached``."""
    hit = live(cache, as_of).select(KEY, F.col("response_json").alias("cached_json"))
    return requests.join(hit, KEY, "left").withColumn("cached", F.col("cached_json").isNotNull())


def put(cache: DataFrame, answers: DataFrame, as_of: Column, order: list[Column]) -> DataFrame:
    """The cache with ``answers`` (same columns): of equal keys the first answer, unless a live entry is there."""
    alive = live(cache, as_of)
    new = latest(answers, order, [KEY]).join(alive.select(KEY), KEY, "left_anti")
    return cache.join(new.select(KEY), KEY, "left_anti").select(*cache.columns).unionByName(new.select(*cache.columns))


def invalidate(cache: DataFrame, users: DataFrame) -> DataFrame:
    """The cache without the entries of ``users(user_id)``: after an ingest or a metadata refresh."""
    return cache.join(users.select("user_id"), "user_id", "left_anti").select(*cache.columns)


def expiry(created: Column, seconds: int = TTL_SECONDS) -> Column:
    return created + F.make_dt_interval(secs=F.lit(seconds))
