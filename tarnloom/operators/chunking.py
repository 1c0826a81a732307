"""Chunks of normalised segments, with exact character offsets.

The splitter cuts at the coarsest separator present, splits what is still too long at
finer ones, and packs pieces greedily up to the chunk size, carrying the last pieces as
overlap. It works on spans of the segment, not on copies, so offsets are exact by
construction, and each segment is split on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

CHUNKER_VERSION = "span-pack-1"
CHUNK_SIZE = 1000
OVERLAP = 200
SEPARATORS = ("\n\n", "\n", ". ", " ")
JOIN = "\n\n"
BATCH_CHUNKS = 100
_SPANS = StructType([StructField("__spans", ArrayType(StructType([StructField(c, IntegerType()) for c in ("segment", "start", "end")])))])


def _pieces(text: str, begin: int, end: int, size: int, level: int) -> Iterator[tuple[int, int]]:
    """Consecutive spans of at most ``size`` characters that cover [begin, end), cut after the coarsest separators that do."""
    if end - begin <= size:
        yield begin, end
        return
    while level < len(SEPARATORS) and text.find(SEPARATORS[level], begin, end) < 0:
        level += 1
    if level == len(SEPARATORS):
        for at in range(begin, end, size):
            yield at, min(at + size, end)
        return
    separator, at = SEPARATORS[level], begin
    while at < end:
        cut = text.find(separator, at, end)
        stop = end if cut < 0 else cut + len(separator)
        yield from _pieces(text, at, stop, size, level + 1)
        at = stop


def split_spans(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of the chunks of a text, stripped, in order; none is empty or longer than ``size``."""
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []

    def emit() -> None:
        begin, end = held[0][0], held[-1][1]
        while begin < end and text[begin].isspace():
            begin += 1
        while end > begin and text[end - 1].isspace():
            end -= 1
        if begin < end and (not out or (begin, end) != out[-1]) and not (out and end <= out[-1][1]):
            out.append((begin, end))

    for begin, end in _pieces(text, 0, len(text), size, 0):
        if held and end - held[0][0] > size:
            emit()
            while held and (held[-1][1] - held[0][0] > overlap or end - held[0][0] > size):
                held.pop(0)
        held.append((begin, end))
    if held:
        emit()
    return out


def body_of(segments: Column) -> Column:
    """The whole text of a document: its segments joined by a blank line."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), JOIN)


def with_spans(docs: DataFrame, segments_col: str = "segments", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``__spans``, ``array<struct<segment, start, end>>``: each segment's chunks, in its own offsets."""
    kind = pa.list_(pa.struct([("segment", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(segments_col)).to_pylist()
            spans = [[{"segment": k, "start": b, "end": e} for k, s in enumerate(x or []) for b, e in split_spans(s["text"], size, overlap)] for x in rows]
            yield batch.append_column("__spans", pa.array(spans, kind))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *_SPANS.fields]))


def build_chunks(docs: DataFrame, segments_col: str = "segments", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk: the document's other columns and ``chunk_index, content, char_start, char_end, page, section, token_count, batch``.

    Segments are ``array<struct<text, page, section>>``, already normalised. Offsets count
    characters of :func:`body_of`. Documents without chunks give no row (see
    :func:`without_chunks`). Only spans leave Python; the content is cut in the JVM.
    """
    others = [c for c in docs.columns if c != segments_col]
    segments = F.col(segments_col)
    # where each segment begins in the body: a running sum of lengths and joints
    bases = F.aggregate(segments, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct((s["at"] + F.length(x["text"]) + len(JOIN)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])
    spans = with_spans(docs, segments_col, size, overlap).withColumn("__bases", bases)
    rows = spans.select(*others, segments_col, "__bases", F.posexplode("__spans").alias("chunk_index", "__span"))
    segment = F.get(F.col(segments_col), F.col("__span.segment"))
    start = F.get(F.col("__bases"), F.col("__span.segment")) + F.col("__span.start")
    content = F.substring(segment["text"], F.col("__span.start") + 1, F.col("__span.end") - F.col("__span.start"))
    return rows.select(
        *others, "chunk_index", content.alias("content"), start.alias("char_start"), (start + F.col("__span.end") - F.col("__span.start")).alias("char_end"),
        segment["page"].alias("page"), segment["section"].alias("section"), F.floor(F.length(content) / 4).cast("int").alias("token_count"), F.floor(F.col("chunk_index") / BATCH_CHUNKS).cast("int").alias("batch"),
    )


def without_chunks(docs: DataFrame, segments_col: str = "segments") -> DataFrame:
    """Documents that have nothing to chunk, with the error that they end in."""
    empty = ~F.exists(F.coalesce(F.col(segments_col), F.array().cast("array<struct<text:string,page:int,section:string>>")), lambda s: F.regexp_replace(s["text"], "(?U)\\s+", "") != "")
    return docs.filter(empty).withColumn("error", F.lit("No extractable text found."))


def chunk_batches(total: Column, done: Column, batch: int = BATCH_CHUNKS) -> Column:
    """Batches still to embed, ``array<struct<first, last>>`` (last exclusive), from the cursor on."""
    starts = F.when(done < total, F.sequence(done, total - 1, F.lit(batch).cast(("int"))))
    return F.coalesce(F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + batch, total).alias("last"))), F.array().cast("array<struct<first:int,last:int>>"))
