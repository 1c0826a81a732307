"""Files to segments, all formats in one pass: each parser is given the content of its own rows only, null for all others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mime
from ..functions.text import strip
from ..operators.headings import heading_segments
from .html import html_to_markdown
from .office import docx_segments, pdf_segments, segments_udf

SEGMENT_TYPE = "array<struct<text:string,page:int,section:string>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``content, filename, content_type, source`` of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content", F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), F.col("path").alias("source"))


def _decoded(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def _plain(content: Column) -> Column:
    text = strip(_decoded(content))
    one = F.struct(text.alias("text"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"))
    return F.when(text != "", F.array(one)).otherwise(F.array().cast(SEGMENT_TYPE))


def _read(segments: Column, error: Column | None = None) -> Column:
    return F.struct(segments.cast(SEGMENT_TYPE).alias("segments"), (F.lit(None) if error is None else error).cast("string").alias("error"))


#: MIME type to a column function from content to ``struct<segments, error>``. Register more here.
LOADERS: dict[str, Callable[[Column], Column]] = {
    mime.PLAIN: lambda content: _read(_plain(content)),
    mime.MARKDOWN: lambda content: _read(heading_segments(_decoded(content))),
    mime.HTML: lambda content: _read(heading_segments(html_to_markdown(_decoded(content)))),
    mime.DOCX: lambda content: segments_udf(docx_segments)(content),
    mime.PDF: lambda content: segments_udf(pdf_segments)(content),
}


def extract_local(files: DataFrame) -> DataFrame:
    """``files(content, filename, content_type, ...)`` with ``mime, segments, error``; the input is read once.

    No segments is a measurement, not an error; a format without a loader is one.
    """
    typed = files.withColumn("mime", mime.resolve_mime(F.col("filename"), F.col("content_type")))
    found = _read(F.array().cast(SEGMENT_TYPE), mime.unsupported_message(F.col("filename"), False))
    for kind, load in LOADERS.items():
        own = F.col("mime") == kind
        found = F.when(own, load(F.when(own, F.col("content")))).otherwise(found)
    read = typed.withColumn("__read", found)
    return read.withColumn("segments", F.filter(F.col("__read.segments"), lambda s: strip(s["text"]) != "")).withColumn("error", F.col("__read.error")).drop("__read")


def load_strict(files: DataFrame) -> DataFrame:
    """:func:`extract_local`, but no segments is an error too."""
    return extract_local(files).withColumn("error", F.coalesce("error", F.when(F.size("segments") == 0, "No extractable text found in the uploaded file.")))


def read_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """Crawled pages (``url, html``) as files, with their columns ``keep``: the offline stand-in for fetching."""
    return pages.select(F.col("html").cast("binary").alias("content"), F.lit("page.html").alias("filename"), F.lit(mime.HTML).alias("content_type"), F.col("url").alias("source"), *keep)


def cached_segments(extracted: Column) -> Column:
    """Segments of a stored extraction (JSON of method and segments); anything malformed is null, which means extract again."""
    parsed = F.from_json(extracted, f"struct<method:string,segments:{SEGMENT_TYPE}>", {"mode": "PERMISSIVE"})
    whole = parsed["method"].isNotNull() & parsed["segments"].isNotNull() & ~F.exists(parsed["segments"], lambda s: s.isNull() | s["text"].isNull())
    return F.when(whole, parsed)


def choose_source(jobs: DataFrame, fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """For each job its content: the staged payload, else what was fetched, else the stored body; with ``source_kind``.

    ``fetched(source, fetched)`` has one row per source and ``stored(user_id, source, body)``
    one per owner and source; text stored before has lost pages and sections.
    """
    joined = jobs.join(fetched, "source", "left").join(stored, ["user_id", "source"], "left")
    content = F.coalesce(F.col("payload"), F.col("fetched"), F.col("body").cast("binary"))
    kind = F.when(F.col("payload").isNotNull(), "payload").when(F.col("fetched").isNotNull(), "fetched").when(F.col("body").isNotNull(), "stored-body")
    return joined.withColumn("content", content).withColumn("source_kind", kind).drop("fetched", "body")
