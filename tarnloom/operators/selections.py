"""The application's small selections: filters, orders, pages. ``as_of`` is a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_JOBS = 100
STALE_SECONDS, STALE_LIMIT = 300, 50


def by_identity(documents: DataFrame, user_id: object, source: str) -> DataFrame:
    return documents.filter((F.col("user_id") == user_id) & (F.col("source") == source))


def by_id(rows: DataFrame, row_id: object, owner: object, owner_col: str = "user_id") -> DataFrame:
    """A row by id; the owner is always part of the condition."""
    return rows.filter((F.col("id") == row_id) & (F.col(owner_col) == owner))


def newest(rows: DataFrame, order: str, limit: int, tie: str = "id", most: int | None = None) -> DataFrame:
    return rows.orderBy(F.col(order).desc(), tie).limit(min(limit, most) if most else limit)


def page(rows: DataFrame, order: str, offset: int, limit: int, tie: str = "id") -> DataFrame:
    return rows.orderBy(F.col(order).desc(), tie).offset(offset).limit(limit)


def has_provenance(chunks: DataFrame, documents: DataFrame, document_col: str = "document_id", id_col: str = "id") -> DataFrame:
    """Documents with a chunk that knows its page or section."""
    known = chunks.filter(F.col("page").isNotNull() | F.col("section").isNotNull()).select(F.col(document_col).alias(id_col))
    return documents.join(known, id_col, "left_semi")


def stale_running(jobs: DataFrame, as_of: Column, seconds: int = STALE_SECONDS, limit: int = STALE_LIMIT) -> DataFrame:
    """Running jobs without a recent heartbeat, oldest first."""
    silent = F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < as_of - F.make_dt_interval(secs=F.lit(seconds)))
    return jobs.filter((F.col("status") == "running") & silent).orderBy("created_at", "id").limit(limit)


def failures_of(failures: DataFrame, owner: object, is_terminal: bool | None, limit: int) -> DataFrame:
    own = failures.filter(F.col("user_id") == owner)
    return newest(own if is_terminal is None else own.filter(F.col("is_terminal") == is_terminal), "created_at", limit)


def valid_tokens(tokens: DataFrame, token: str, as_of: Column) -> DataFrame:
    return tokens.filter((F.col("token") == token) & ~F.col("revoked") & (F.col("expires_at") > as_of))


def revoke_all(tokens: DataFrame, user_id: object) -> DataFrame:
    return tokens.withColumn("revoked", F.col("revoked") | F.coalesce(F.col("user_id") == user_id, F.lit(False)))


def job_accepted(jobs: DataFrame) -> DataFrame:
    """What a caller gets for a queued job."""
    return jobs.select(F.col("id").alias("job_id"), "status", "source")


def job_status(jobs: DataFrame) -> DataFrame:
    """What a caller polls."""
    return jobs.select(
        F.col("id").alias("job_id"), "status", "source", "processed_chunks", "total_chunks", progress(F.col("processed_chunks"), F.col("total_chunks")).alias("progress"),
        "document_id", "error", "failure_reason", "attempts", "created_at", "started_at", "finished_at",
    )


def failure_view(failures: DataFrame) -> DataFrame:
    """A dead letter as operators see it: all but its owner."""
    return failures.select(F.col("id").alias("failure_id"), *(c for c in ("job_id", "source", "filename", "content_type", "reason", "stage", "error", "attempt", "is_terminal", "diagnostics", "created_at") if c in failures.columns))


def document_view(documents: DataFrame) -> DataFrame:
    """A document as callers see it; without metadata the map is empty."""
    return documents.select("id", "title", "chunk_count", "created_at", "source", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def progress(processed: Column, total: Column) -> Column:
    """Share done, to four digits; null without a plan."""
    return F.when(total > 0, F.round(processed / total, 4))
