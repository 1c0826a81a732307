"""One pass of the ingestion worker over queued jobs: outcomes as events and dead letters.

Every row carries its own result or error, so one bad file stops nothing and the pass can
be run again: events are keyed by job and attempt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ERROR_LENGTH
from ..operators.jobs import FAILED, MOST_ATTEMPTS, RUNNING, SUCCEEDED, classify, is_terminal


@dataclass
class Pass:
    """Transitions to append to the jobs' log, dead letters to append, and the jobs to queue again."""

    events: DataFrame
    dead_letters: DataFrame
    again: DataFrame


def outcomes(jobs: DataFrame, results: DataFrame, as_of: Column, most: int = MOST_ATTEMPTS) -> Pass:
    """From ``jobs(job_id, user_id, source, attempts)`` and ``results(job_id, error_class, error)``, null errors meaning success.

    A job without a result is left as it runs, for the sweeper. A failure is terminal when a
    retry cannot help or the attempts are used up; only the others are queued again.
    """
    done = jobs.join(results, "job_id").withColumn("attempt", F.col("attempts") + 1).withColumn("__c", classify(F.col("error_class")))
    failed = F.col("error_class").isNotNull()
    final = F.when(failed, is_terminal(F.col("__c.retryable"), F.col("attempt"), most))
    judged = done.withColumn("is_terminal", final).withColumn("at", as_of)
    status = F.when(~failed, SUCCEEDED).when(F.col("is_terminal"), FAILED).otherwise(RUNNING)
    key = F.sha2(F.concat_ws("|", F.col("job_id").cast("string"), F.col("attempt").cast("string"), status), 256)
    events = judged.select(key.alias("event_id"), "job_id", "attempt", status.alias("status"), F.when(failed, F.col("__c.reason")).alias("failure_reason"), F.substring("error", 1, ERROR_LENGTH).alias("error"), "at")
    letters = judged.filter(failed).select("job_id", "user_id", "source", F.col("__c.reason").alias("reason"), F.col("__c.stage").alias("stage"), F.substring("error", 1, ERROR_LENGTH).alias("error"), "attempt", "is_terminal", F.col("at").alias("created_at"))
    return Pass(events, letters, judged.filter(failed & ~F.col("is_terminal")).select("job_id", F.col("attempt").alias("attempts")))


def finish(jobs: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Jobs after success: the staged payload and the extraction cache go, the document stays named."""
    ok = succeeded.select("id", F.col("document_id").alias("__document"), F.lit(True).alias("__ok"))
    out = jobs.join(ok, "id", "left")
    for c in ("payload", "extracted"):
        if c in jobs.columns:
            out = out.withColumn(c, F.when(F.col("__ok").isNull(), F.col(c)))
    out = out.withColumn("document_id", F.coalesce("__document", "document_id")).withColumn("status", F.when(F.col("__ok"), SUCCEEDED).otherwise(F.col("status")))
    return out.select(*jobs.columns)
