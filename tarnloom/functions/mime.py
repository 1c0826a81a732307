"""File formats: from names and declared types to MIME types, and what can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename, extension

# MIME types, the extensions that name them, and the formats listed in messages.
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
XLSM = "application/vnd.ms-excel.sheet.macroenabled.12"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
HTML, PLAIN, MARKDOWN = "text/html", "text/plain", "text/markdown"
BY_EXTENSION = {
    ".pdf": PDF, ".docx": DOCX, ".html": HTML, ".htm": HTML, ".txt": PLAIN, ".md": MARKDOWN, ".markdown": MARKDOWN,
    ".xlsx": XLSX, ".xlsm": XLSM, ".pptx": PPTX,
}
LOCAL = [PDF, DOCX, HTML, PLAIN, MARKDOWN]
OCR_ONLY = [XLSX, XLSM, PPTX]
OCR_CAPABLE = [*OCR_ONLY, PDF, DOCX, HTML]
SUPPORTED_FORMATS = "PDF, DOCX, HTML, TXT, Markdown"
OCR_ONLY_FORMATS = "XLSX, XLSM, PPTX"


def resolve_mime(filename: Column, content_type: Column) -> Column:
    """By extension first, then the declared type without parameters; null if neither says."""
    table = F.create_map(*(F.lit(x) for kv in BY_EXTENSION.items() for x in kv))
    declared = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.coalesce(F.element_at(table, extension(basename(F.coalesce(filename, F.lit(""))))), F.when(content_type != "", declared))


def has_loader(mime: Column) -> Column:
    return F.coalesce(mime.isin(LOCAL), F.lit(False))


def is_ingestible(mime: Column, ocr_available: Column | bool) -> Column:
    """There is a loader, or OCR is available and reads the format."""
    ocr = ocr_available if isinstance(ocr_available, Column) else F.lit(ocr_available)
    return has_loader(mime) | (ocr & F.coalesce(mime.isin(OCR_ONLY), F.lit(False)))


def unsupported_message(filename: Column, ocr_available: bool) -> Column:
    base = F.concat(F.lit("Unsupported file type for '"), F.coalesce(filename, F.lit("None")), F.lit(f"'. Supported: {SUPPORTED_FORMATS}"))
    more = f", {OCR_ONLY_FORMATS}." if ocr_available else f". {OCR_ONLY_FORMATS} require Document AI OCR — set OCR_ENABLED=true and DOCUMENTAI_PROCESSOR_ID to enable them."
    return F.concat(base, F.lit(more))
