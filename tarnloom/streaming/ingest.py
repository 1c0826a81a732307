"""Streaming ingestion: job files in, chunks out, each micro-batch idempotent.

``foreachBatch`` may run a batch twice, so its output is keyed: chunks are put down by
dynamic overwrite of the documents' own partitions, and a second run writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Chunk partitions: documents are spread over so many folders by their id's hash.
BUCKETS = 64


def bucket_of(document_id: str, buckets: int = BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def write_chunks(chunks: DataFrame, path: str, batch_id: int) -> None:
    """Put ``chunks(document_id, ...)`` below ``path`` under (batch, bucket); the same batch overwrites itself."""
    placed = chunks.withColumn("batch_id", F.lit(batch_id)).withColumn("bucket", bucket_of("document_id"))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(path)


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Each document's chunks as its latest batch wrote them."""
    chunks = spark.read.parquet(path)
    last = chunks.groupBy("document_id").agg(F.max("batch_id").alias("batch_id"))
    return chunks.join(last, ["document_id", "batch_id"], "left_semi")


def start_ingest(spark: SparkSession, jobs_path: str, schema: str, to_chunks: Callable[[DataFrame], DataFrame], chunks_path: str, checkpoint: str, files_at_once: int = 100, available_now: bool = True) -> StreamingQuery:
    """Read job files as they appear and write their chunks; restarts go on at the checkpoint."""
    jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(jobs_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_chunks(to_chunks(batch), chunks_path, batch_id)

    writer = jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def enqueue(jobs: DataFrame, jobs_path: str) -> None:
    """Append jobs to the queue's folder. The consumer is idempotent, so a job may be queued twice."""
    jobs.write.mode("append").parquet(jobs_path)
