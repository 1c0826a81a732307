"""Quality gate: characters per page of the source, and what to say of a document that fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_CHARS_PER_PAGE = 50
# What to do about a rejected document.
REMEDY_TRIED = "Document AI OCR was applied and still produced too little text."
REMEDY_DISABLED = "OCR is disabled on this deployment — set OCR_ENABLED=true to ingest scanned documents."
REMEDY_UNCONFIGURED = "OCR is enabled but not configured — set DOCUMENTAI_PROJECT_ID and DOCUMENTAI_PROCESSOR_ID to ingest scanned documents."


def remedy(ocr_tried: bool, ocr_enabled: bool) -> str:
    return REMEDY_TRIED if ocr_tried else REMEDY_UNCONFIGURED if ocr_enabled else REMEDY_DISABLED


def density(chars: Column, pages: Column) -> Column:
    """Characters per page of the source; null without pages."""
    return chars / F.nullif(pages, F.lit(0))


def assess(segments: Column, page_count: Column) -> Column:
    """``struct<char_count, segment_count, page_count, pages_with_text, chars_per_page>``; page figures only where the format has pages."""
    chars = F.aggregate(segments, F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"]))
    with_text = F.size(F.array_distinct(F.filter(F.transform(segments, lambda s: s["page"]), lambda p: p.isNotNull())))
    return F.struct(chars.alias("char_count"), F.size(segments).alias("segment_count"), page_count.alias("page_count"), F.when(page_count.isNotNull(), with_text).alias("pages_with_text"), density(chars, page_count).alias("chars_per_page"))


def passes(report: Column, least: int = LEAST_CHARS_PER_PAGE) -> Column:
    """Dense enough, or of a format without pages."""
    return report["chars_per_page"].isNull() | (report["chars_per_page"] >= least)


def rejection(report: Column, least: int = LEAST_CHARS_PER_PAGE, advice: str = "") -> Column:
    coverage = F.when(report["page_count"] > 0, F.format_string(" Only %d of %d pages produced any text.", report["pages_with_text"], report["page_count"])).otherwise("")
    tail = F.lit(f" {advice}" if advice else "")
    return F.concat(
        F.format_string("This document yielded %.0f characters per page across %s pages, below the minimum of " + str(least) + ".", F.coalesce(report["chars_per_page"], F.lit(0.0)), F.coalesce(report["page_count"].cast("string"), F.lit("None"))),
        coverage, F.lit(" It appears to be scanned or image-only."), tail,
    )


def diagnostics(report: Column, method: Column) -> Column:
    """The report as a map of JSON scalars, for a dead letter."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.create_map(
        F.lit("extraction_method"), F.concat(F.lit('"'), method, F.lit('"')), F.lit("char_count"), text(report["char_count"]), F.lit("segment_count"), text(report["segment_count"]),
        F.lit("page_count"), text(report["page_count"]), F.lit("pages_with_text"), text(report["pages_with_text"]), F.lit("chars_per_page"), text(F.round(report["chars_per_page"], 2)),
    )
