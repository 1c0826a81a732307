"""Whole paths through the operators: from files to documents and chunks, and back to old ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import EXTRACTOR_VERSION, metadata_map
from ..functions.text import NORMALIZER_VERSION, content_hash, fallback_title, nfkc_text, normalize_segments
from ..operators.chunking import CHUNKER_VERSION, body_of, build_chunks
from ..operators.language import LanguageModel, detect_language
from ..operators.upsert import gate, replace_chunks, upsert_documents
from ..storage import new_path, written

EMBED_BATCH = 100
#: Embedded batches of each document between two writes, and so what a crash costs at most.
BATCHES_A_WRITE = 20


@dataclass
class Ingested:
    """The new tables, what was done with each incoming row, and the rows that have no text."""

    documents: DataFrame
    chunks: DataFrame
    actions: DataFrame
    rejected: DataFrame


def normalised(files: DataFrame) -> DataFrame:
    """``files`` with normalised ``segments``: NFKC in Python, whole batches at once, the rest in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("segments")
            renewed = [None if x is None else [s | {"text": nfkc_text(s["text"])} for s in x] for x in batch.column(at).to_pylist()]
            columns = [*batch.columns]
            columns[at] = pa.array(renewed, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return files.mapInArrow(run, files.schema).withColumn("segments", normalize_segments(F.col("segments")))


def prepared(files: DataFrame, model: LanguageModel | None, embedding_model: str, method: str = "local") -> DataFrame:
    """Extracted ``files(user_id, source, filename, mime, segments, ...)`` as documents to be, with all that the gate compares."""
    body = normalised(files).withColumn("content", body_of(F.col("segments")))
    spoken = detect_language(body, model, "content") if model else body.withColumn("language", F.lit(None).cast("string"))
    mime = F.col("mime") if "mime" in files.columns else None
    return (
        spoken.withColumn("metadata", metadata_map(F.col("content"), F.col("language"), mime, F.lit(method)))
        .withColumn("content_hash", content_hash(F.col("content")))
        .withColumn("normalizer_version", F.lit(NORMALIZER_VERSION)).withColumn("chunker_version", F.lit(CHUNKER_VERSION))
        .withColumn("embedding_model", F.lit(embedding_model)).withColumn("metadata_version", F.lit(EXTRACTOR_VERSION))
        .withColumn("title", fallback_title(F.col("filename"), F.col("source")))
        .withColumn("id", F.sha2(F.concat_ws("|", "user_id", "source"), 256))
        .drop("language")
    )


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> DataFrame:
    """``chunks`` with ``embedding``: an injected function, called with up to ``batch`` texts at once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(df), batch):
                vectors += embed(df["content"].iloc[at : at + batch].tolist())
            yield df.assign(embedding=vectors)

    return chunks.mapInPandas(run, schema)


def embed_onwards(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], path: str, key: str = "document_id", batches: int = BATCHES_A_WRITE) -> DataFrame:
    """``embedded(chunks)`` below ``path``, written ``batches`` batches of each document at a time.

    What is written is the cursor: run again after a crash, only batches that are not there
    are embedded. ``chunks`` has the columns ``chunk_index`` and ``batch`` of ``build_chunks``.
    """
    spark = chunks.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", embedding array<float>"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    begun = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop_path)
    if begun:
        done = written(spark.read.schema(schema).parquet(path).select(key, "batch").distinct(), "cursor")
        chunks = chunks.join(done, [key, "batch"], "left_anti").select(*chunks.columns)
    last = chunks.agg(F.min("batch"), F.max("batch")).first()
    for first in range(last[0], last[1] + 1, batches) if last[0] is not None else ():
        embedded(chunks.filter(F.col("batch").between(first, first + batches - 1)), embed).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if begun or last[0] is not None else embedded(chunks, embed)


def cursors(embedded_chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """``processed_chunks`` of each document: those up to the first batch that is not there yet."""
    whole = embedded_chunks.groupBy(key, "batch").agg(F.count("*").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("batch", "n"))).alias("b"))
    upto = F.filter("b", lambda x, k: x["batch"] == k)
    return whole.select(key, F.aggregate(upto, F.lit(0).cast("long"), lambda n, x: n + x["n"]).cast("int").alias("processed_chunks"))


def ingest(files: DataFrame, documents: DataFrame, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], embedding_model: str, model: LanguageModel | None = None, as_of: str = "1970-01-01 00:00:00", chunks_path: str | None = None) -> Ingested:
    """Run extracted files into the stored tables; one row per (user_id, source).

    ``documents`` has the columns of the gate, ``metadata_version`` among them. Only new and
    replaced documents are chunked and embedded; refreshed ones get metadata, skipped ones nothing.
    What is extracted and normalised, and what is chunked, is written once and read by all that
    need it. Embedded chunks go below ``chunks_path``, where a second run of the same files
    goes on after a crash; by default that is a folder of this run alone.
    """
    ready = written(prepared(files, model, embedding_model), "prepared")
    rejected = ready.filter(F.size("segments") == 0)
    judged = gate(ready.filter(F.size("segments") > 0), documents)
    actions = judged.select("user_id", "source", "action")
    doc_id = F.coalesce("stored_id", "id")
    writes = judged.filter(F.col("action").isin("new", "replace")).withColumn("id", doc_id)
    made = build_chunks(writes.select(F.col("id").alias("document_id"), F.col("user_id").alias("owner_id"), F.col("title").alias("document_title"), "metadata", "segments"))
    made = written(made.withColumn("id", F.sha2(F.concat_ws("|", "document_id", "chunk_index"), 256)).withColumn("created_at", F.to_timestamp(F.lit(as_of))), "chunked")
    new_chunks = embed_onwards(made, embed, chunks_path or new_path(files.sparkSession, "embedded"))
    counts = made.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("chunk_count"))
    fresh = judged.filter(F.col("action") == "refresh").select(F.col("stored_id").alias("id"), "metadata", F.col("metadata_version").alias("__v"))
    new_documents = writes.join(counts, "id").withColumn("created_at", F.to_timestamp(F.lit(as_of)))
    stored = documents.join(fresh.withColumnRenamed("metadata", "__m"), "id", "left")
    stored = stored.withColumn("metadata", F.coalesce("__m", "metadata")).withColumn("metadata_version", F.coalesce("__v", "metadata_version")).select(*documents.columns)
    all_documents = upsert_documents(stored, new_documents.select(*documents.columns))
    carried = chunks.join(fresh.select(F.col("id").alias("document_id"), F.col("metadata").alias("__m")), "document_id", "left").withColumn("metadata", F.coalesce("__m", "metadata"))
    return Ingested(all_documents, replace_chunks(carried.select(*chunks.columns), new_chunks.select(*chunks.columns)), actions, rejected)
