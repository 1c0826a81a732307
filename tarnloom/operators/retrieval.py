"""Filtered vector top-k: exact, tenant-scoped, one plan per call."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import contains, validate_filter
from ..functions.text import context_of, preview
from ..functions.vector import cosine_distance, literal
from .nearest import nearest

DEFAULT_K, MOST_K = 5, 20
QUESTION_LENGTH = 2000


def topk(chunks: DataFrame, query: list[float], k: int, owner: object | None = None, filters: dict | None = None, owner_col: str = "owner_id", id_col: str = "id", vector_col: str = "embedding", metadata_col: str = "metadata", norm_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The ``k`` nearest rows: the asked columns (default: id) with ``distance, similarity, rank``.

    The filters stand below the limit, so k counts matching rows. The query is a literal:
    no join. Ties go by id; rows whose vector has another dimension or no direction are left
    out. Each task keeps its own k best rows, so what is merged is k rows a task.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    scoped = chunks if owner is None else chunks.filter(F.col(owner_col) == owner)
    if validate_filter(filters):
        scoped = scoped.filter(contains(F.col(metadata_col), filters))
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    distance = cosine_distance(F.col(vector_col), literal(query), None if norm_col is None else F.col(norm_col), F.lit(length))
    kept = [id_col, *(c for c in columns or [] if c != id_col)]
    best = scoped.select(*kept, distance.alias("distance")).filter("distance is not null").orderBy("distance", id_col).limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))  # k rows
    return ranked.withColumn("similarity", 1 - F.col("distance"))


def topk_of_many(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", query_id_col: str = "query_id", query_vector_col: str = "vector", queries_at_once: int = 64) -> DataFrame:
    """``query_id, id, distance, rank`` for a stated set of queries, compared in blocks of ``queries_at_once``.

    Every query is compared with every row, as matrices; each task keeps the k best of each
    query among its rows before anything is shuffled.
    """
    return nearest(chunks.select(id_col, vector_col), queries.select(query_id_col, query_vector_col), k, queries_at_once)


def source_rows(ranked: DataFrame) -> DataFrame:
    """What an answer shows of each chunk: title, preview, score to four digits."""
    return ranked.select("rank", "document_title", preview(F.col("content")).alias("preview"), F.round("similarity", 4).alias("score"))


def context(ranked: DataFrame) -> DataFrame:
    """One row: the prompt's context of a top-k result (k rows at most)."""
    return ranked.agg(context_of(F.collect_list(F.struct("rank", F.col("document_title").alias("title"), "content"))).alias("context"))


def retrieve(chunks: DataFrame, question: str, embed: Callable[[str], list[float]], k: int = DEFAULT_K, owner: object | None = None, filters: dict | None = None, normalize: Callable[[str], str] = str.strip, **names: str) -> DataFrame:
    """Normalise the question by the corpus's rules, embed it, and search. A blank question is refused."""
    text = normalize(question)
    if not text or len(question) > QUESTION_LENGTH or not 1 <= k <= MOST_K:
        raise ValueError(f"a question has 1 to {QUESTION_LENGTH} characters, and k is 1 to {MOST_K}")
    return topk(chunks, embed(text), k, owner, filters, columns=["document_title", "content"], **names)


def normalised_question(question: str) -> str:
    """The corpus's normalisation for one string, on the driver."""
    import re
    import unicodedata

    s = re.sub("\r\n?", "\n", unicodedata.normalize("NFKC", question))
    s = "".join(c for c in s if c in "\n\t" or unicodedata.category(c) not in ("Cc", "Cf"))
    s = re.sub(r"[^\S\n]*\n[^\S\n]*", "\n", re.sub(r"[^\S\n]+", " ", s))
    return re.sub("\n{3,}", "\n\n", s).strip()


def lsh_topk_of_many(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", query_id_col: str = "query_id", query_vector_col: str = "vector", tables: int = 32, projections: int = 4, width: float = 2.4, widen: int = 0, queries_at_once: int = 64, seed: int = 11) -> DataFrame:
    """Approximate :func:`topk_of_many`: ``query_id, id, distance, rank`` of rows that share a bucket with a query.

    A bucket of a table is a cell of ``projections`` random projections, cut into steps of
    ``width`` standard deviations. ``widen`` takes in cells that are so many steps away, for
    queries whose filters leave too few rows. Every row is hashed; nothing is trained or
    sampled. The test tables' vectors have no structure: there these defaults find 96 to 100
    of 100 neighbours by ranking four rows in five, which is no gain over the exact search.
    Vectors in clusters need narrower cells.
    """
    return nearest(chunks.select(id_col, vector_col), queries.select(query_id_col, query_vector_col), k, queries_at_once, (tables, projections, width, widen, seed))
