"""Idempotent ingestion of documents: the gate, the upsert, and what follows from it.

A document's identity is (user_id, source). Tables are values: each function takes the
stored table and returns the new one, so a retry recomputes the same result. Writers put
it down by dynamic partition overwrite or in a new folder that a pointer is moved to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["user_id", "source"]
VERSIONS = ["content_hash", "normalizer_version", "chunker_version", "embedding_model"]


def latest(incoming: DataFrame, order: list[Column], key: list[str] | None = None) -> DataFrame:
    """One row per key: the first in ``order``."""
    return incoming.withColumn("__nth", F.row_number().over(Window.partitionBy(*(key or KEY)).orderBy(*order))).filter("__nth = 1").drop("__nth")


def gate(incoming: DataFrame, stored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``incoming`` with ``action``: new, skip, refresh or replace, and the stored ``id`` as ``stored_id``.

    Skip: hash, versions and metadata version are as stored. Refresh: only the metadata's
    version differs. ``resuming`` rows (if there is such a column) are never skipped.
    """
    key = key or KEY
    old = stored.select(*key, F.col("id").alias("stored_id"), *(F.col(c).alias(f"stored_{c}") for c in VERSIONS), F.col("metadata_version").alias("stored_metadata_version"))
    same = F.lit(True)
    for c in VERSIONS:
        same = same & F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    resuming = F.coalesce(F.col("resuming"), F.lit(False)) if "resuming" in incoming.columns else F.lit(False)
    action = (
        F.when(F.col("stored_id").isNull(), "new")
        .when(resuming | ~same, "replace")
        .when(~F.col("metadata_version").eqNullSafe(F.col("stored_metadata_version")), "refresh")
        .otherwise("skip")
    )
    return incoming.join(old, key, "left").withColumn("action", action).select(*incoming.columns, "stored_id", "action")


def upsert_documents(stored: DataFrame, incoming: DataFrame, key: list[str] | None = None, kept: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """``stored`` with ``incoming`` (one row per key): replaced rows keep ``kept``, new ones come as they are."""
    key = key or KEY
    old = stored.select(*key, *(F.col(c).alias(f"__{c}") for c in kept), F.lit(True).alias("__known"))
    new = incoming.join(old, key, "left")
    for c in kept:
        new = new.withColumn(c, F.when(F.col("__known"), F.col(f"__{c}")).otherwise(F.col(c)))
    return stored.join(incoming.select(*key), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def without_chunks_of(chunks: DataFrame, documents: DataFrame, document_col: str = "document_id", id_col: str = "id") -> DataFrame:
    """``chunks`` but those of ``documents``."""
    return chunks.join(documents.select(F.col(id_col).alias(document_col)), document_col, "left_anti")


def replace_chunks(chunks: DataFrame, new_chunks: DataFrame, document_col: str = "document_id") -> DataFrame:
    """All chunks of the documents in ``new_chunks`` make way for the new ones."""
    return chunks.join(new_chunks.select(document_col).distinct(), document_col, "left_anti").select(*chunks.columns).unionByName(new_chunks.select(*chunks.columns))


def refresh_metadata(rows: DataFrame, fresh: DataFrame, id_col: str) -> DataFrame:
    """``metadata`` of ``fresh(id_col, metadata)`` put on matching rows; the others stay. For documents and their chunks alike."""
    new = fresh.select(F.col(id_col), F.col("metadata").alias("__new"), F.lit(True).alias("__fresh"))
    return rows.join(new, id_col, "left").withColumn("metadata", F.when(F.col("__fresh"), F.col("__new")).otherwise(F.col("metadata"))).select(*rows.columns)


def cascade(children: DataFrame, deleted: DataFrame, foreign_key: str, id_col: str = "id") -> DataFrame:
    """ON DELETE CASCADE: children of deleted parents go."""
    return children.join(deleted.select(F.col(id_col).alias(foreign_key)), foreign_key, "left_anti").select(*children.columns)


def set_null(children: DataFrame, deleted: DataFrame, foreign_key: str, id_col: str = "id") -> DataFrame:
    """ON DELETE SET NULL: children of deleted parents lose the reference."""
    gone = deleted.select(F.col(id_col).alias(foreign_key), F.lit(True).alias("__gone")).distinct()
    return children.join(gone, foreign_key, "left").withColumn(foreign_key, F.when(F.col("__gone").isNull(), F.col(foreign_key))).select(*children.columns)


def backfill(children: DataFrame, parents: DataFrame, foreign_key: str, values: dict[str, str], id_col: str = "id") -> DataFrame:
    """UPDATE … FROM: columns of the parent (name there to name here) copied onto its children; others keep theirs."""
    old = parents.select(F.col(id_col).alias(foreign_key), *(F.col(a).alias(f"__{b}") for a, b in values.items()), F.lit(True).alias("__parent"))
    out = children.join(old, foreign_key, "left")
    for b in values.values():
        out = out.withColumn(b, F.when(F.col("__parent"), F.col(f"__{b}")).otherwise(F.col(b) if b in children.columns else F.lit(None)))
    return out.select(*dict.fromkeys([*children.columns, *values.values()]))


def patch(stored: DataFrame, changes: DataFrame, key: str, columns: list[str], set_col: str | None = None) -> DataFrame:
    """PATCH: columns that were set replace the stored ones.

    ``set_col`` names an array of the names of the columns that a row sets, to null too;
    without it those that are not null are set.
    """
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns), *([F.col(set_col).alias("__set")] if set_col else []))
    out = stored.join(new, key, "left")
    for c in columns:
        is_set = F.coalesce(F.array_contains("__set", c), F.lit(False)) if set_col else F.col(f"__{c}").isNotNull()
        out = out.withColumn(c, F.when(is_set, F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(*stored.columns)


def insert_unique(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``incoming`` rows that a unique key lets in: the first of each key, if none is stored (else a conflict)."""
    return latest(incoming, order, key).join(stored.select(*key), key, "left_anti")


def resume_cursor(processed: Column, same_versions: Column) -> Column:
    """Where a job goes on: at its cursor, or from the start if what it would be joined to has changed."""
    return F.when(F.coalesce(same_versions, F.lit(False)), processed).otherwise(F.lit(0))


def stale_documents(documents: DataFrame, normalizer: str, chunker: str, model: str, limit: int = 500) -> DataFrame:
    """Documents made under other versions, oldest first: what a reindex enqueues."""
    stale = (F.col("normalizer_version") != normalizer) | (F.col("chunker_version") != chunker) | (F.col("embedding_model") != model)
    return documents.filter(stale).orderBy("created_at", "id").limit(limit)


def reindex_jobs(documents: DataFrame, normalizer: str, chunker: str, model: str, limit: int = 500) -> DataFrame:
    """One pending job per stale document."""
    stale = stale_documents(documents, normalizer, chunker, model, limit)
    return stale.select(F.sha2(F.concat_ws("|", F.lit("reindex"), "id", F.lit(normalizer), F.lit(chunker), F.lit(model)), 256).alias("id"), "user_id", F.lit("pending").alias("status"), "source", "title")
