"""Ingestion jobs as folds of transition events; failures, retries, dead letters, the sweeper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ERROR_LENGTH

PENDING, RUNNING, SUCCEEDED, FAILED = "pending", "running", "succeeded", "failed"
STATUSES = [PENDING, RUNNING, SUCCEEDED, FAILED]
TERMINAL = [SUCCEEDED, FAILED]
#: The event of a retry: not a status, but what makes a job pending again.
REQUEUE = "requeue"
MOST_ATTEMPTS = 3

# Error classes in order of precedence, with reason, stage and whether a retry may help.
FAILURES = [
    ("LowTextYieldError", "low_text_yield", "quality_gate", False),
    ("InvalidSourceURIError", "invalid_source", "fetch", False),
    ("UnsupportedFileTypeError", "unsupported_type", "parse", False),
    ("FileTooLargeError", "too_large", "fetch", False),
    ("ConnectorNotConfiguredError", "ocr_not_configured", "ocr", False),
    ("SourceFetchError", "fetch_failed", "fetch", True),
    ("NotFoundError", "not_found", "persist", False),
    ("ValidationError", "parse_error", "parse", False),
    # ours: the reasons below are part of the taxonomy, and need a class to come from
    ("OcrFailedError", "ocr_failed", "ocr", True),
    ("EmbeddingError", "embedding_failed", "embed", True),
]
UNKNOWN = ("internal", "unknown", True)
# Errors of the OCR service, and the class that each becomes.
OCR_ERRORS = {
    "ResourceExhausted": "SourceFetchError", "ServiceUnavailable": "SourceFetchError", "DeadlineExceeded": "SourceFetchError", "InternalServerError": "SourceFetchError", "TooManyRequests": "SourceFetchError", "GatewayTimeout": "SourceFetchError",
    "PermissionDenied": "ConnectorNotConfiguredError", "Unauthenticated": "ConnectorNotConfiguredError", "NotFound": "ConnectorNotConfiguredError", "InvalidArgument": "ValidationError",
}


def classify(error_class: Column) -> Column:
    """``struct<reason, stage, retryable>``; an unknown class is internal and may be retried."""
    one = lambda r, s, t: F.struct(F.lit(r).alias("reason"), F.lit(s).alias("stage"), F.lit(t).alias("retryable"))
    table = F.create_map(*(x for name, *rest in FAILURES for x in (F.lit(name), one(*rest))))
    return F.coalesce(F.try_element_at(table, error_class), one(*UNKNOWN))


def ocr_error_class(error: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in OCR_ERRORS.items() for x in kv)), error), error)


def is_terminal(retryable: Column, attempt: Column, most: int = MOST_ATTEMPTS) -> Column:
    return ~retryable | (attempt >= most)


def fold_jobs(events: DataFrame, values: list[str], key: str = "job_id", seq: str = "seq", status: str = "status") -> DataFrame:
    """Current state of each job from its events: its status, the last value that is set of each column, and the number of attempts.

    A terminal status stays whatever comes later, but for a ``requeue``: the job is then
    pending, and its attempts begin anew. An aggregation with map-side combination; no event
    has to be sorted. What is gathered of a job is its terminal and requeue events, and the
    places of its attempts.
    """
    last = lambda c, known: F.max_by(F.when(known, F.col(c)), F.when(known, F.col(seq)))
    state = events.groupBy(key).agg(
        F.struct(
            F.max_by(F.struct(F.col(status).alias("status")), F.col(seq)).alias("last"),
            F.max(F.when(F.col(status) == REQUEUE, F.col(seq))).alias("requeued"),
            F.collect_list(F.when(F.col(status).isin(TERMINAL), F.struct(F.col(seq).alias("seq"), F.col(status).alias("status")))).alias("ends"),
            F.collect_list(F.when(F.col(status) == RUNNING, F.col(seq))).alias("runs"),
        ).alias("__s"),
        *(last(c, F.col(c).isNotNull()).alias(c) for c in values),
        F.max(seq).alias("last_seq"),
    )
    since = lambda x: F.col("__s.requeued").isNull() | (x > F.col("__s.requeued"))
    first_end = F.array_min(F.filter("__s.ends", lambda e: since(e["seq"])))["status"]
    now = F.coalesce(first_end, F.when(F.col("__s.last.status") == REQUEUE, PENDING).otherwise(F.col("__s.last.status")))
    return state.select(key, now.alias(status), *values, F.size(F.filter("__s.runs", since)).cast("long").alias("attempts"), "last_seq")


def dead_letters(failures: DataFrame, key: str = "job_id", order: str = "seq", error_class: str = "error_class", error: str = "error", most: int = MOST_ATTEMPTS) -> DataFrame:
    """``failures`` with ``attempt, reason, stage, is_terminal``, the error cut to 2,000 characters."""
    attempt = F.row_number().over(Window.partitionBy(key).orderBy(order))
    found = failures.withColumn("attempt", attempt).withColumn("__c", classify(F.col(error_class)))
    return found.select(
        *(c for c in failures.columns if c != error), F.substring(error, 1, ERROR_LENGTH).alias(error), "attempt", F.col("__c.reason").alias("reason"), F.col("__c.stage").alias("stage"),
        is_terminal(F.col("__c.retryable"), F.col("attempt"), most).alias("is_terminal"),
    )


def failures_by_reason(failures: DataFrame) -> DataFrame:
    return failures.groupBy("reason").agg(F.count("*").alias("n"))


def retry_decisions(failures: DataFrame, jobs: DataFrame, owner_col: str = "user_id") -> DataFrame:
    """For each failure what an operator's retry does: requeue, or why not.

    The job must be there, be the failure's owner's, have failed, and have a payload or a
    source that can be fetched again. A requeued job keeps its cursor; attempts begin anew.
    """
    job = jobs.select(F.col("id").alias("job_id"), F.col(owner_col).alias("__owner"), F.col("status").alias("__status"), F.col("payload").isNotNull().alias("__payload"), F.col("source").alias("__source"))
    fetchable = F.regexp_extract("__source", "^([a-z]+)://", 1).isin("http", "https", "gdrive")
    decision = (
        F.when(F.col("__owner").isNull(), "conflict: job is gone")
        .when(F.col("__owner") != F.col(owner_col), "not found")
        .when(F.col("__status") != FAILED, "conflict: job has not failed")
        .when(~F.col("__payload") & ~fetchable, "conflict: nothing to read again")
        .otherwise("requeue")
    )
    return failures.join(job, "job_id", "left").withColumn("decision", decision).select(*failures.columns, "decision")


def sweep(jobs: DataFrame, as_of: Column, seconds: int = 300, limit: int = 50, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Stale running jobs with ``action``: requeue, or fail once their attempts are used up."""
    from .selections import stale_running

    return stale_running(jobs, as_of, seconds, limit).withColumn("action", F.when(F.col("attempts") >= most, "fail").otherwise("requeue"))
