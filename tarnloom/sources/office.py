"""DOCX and PDF files to segments: DOCX from its XML, PDF by a library where one is installed."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators.headings import SECTION_LENGTH

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SEGMENTS = "array<struct<text:string,page:int,section:string>>"


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style name, text) of the body's paragraphs; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = "" if name is None else name.get(f"{_W}val", "")
    out = []
    for p in [] if body is None else body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        style_id = "" if style is None else style.get(f"{_W}val", "")
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
        out.append((names.get(style_id, style_id), "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)))
    return out


def docx_segments(content: bytes) -> list[dict]:
    """Paragraphs grouped under headings and titles; a heading is part of its group."""
    groups: list[tuple[str | None, list[str]]] = [(None, [])]
    for style, text in docx_paragraphs(content):
        if style.lower().startswith("heading") or style.lower() == "title":
            groups.append((text.strip()[:SECTION_LENGTH] or None, []))
        if text.strip():
            groups[-1][1].append(text)
    bodies = ((section, "\n".join(lines).strip()) for section, lines in groups)
    return [{"text": body, "page": None, "section": section} for section, body in bodies if body]


def pdf_pages(content: bytes) -> list[str]:
    """Text of each page. Needs ``pypdf``, which is optional."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional package pypdf") from e
    return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages]


def pdf_segments(content: bytes) -> list[dict]:
    """One segment per page with text; pages count from 1."""
    return [{"text": t.strip(), "page": k, "section": None} for k, t in enumerate(pdf_pages(content), 1) if t.strip()]


def pdf_page_count(content: bytes) -> int | None:
    """Null for what cannot be read as a PDF, or not here."""
    try:
        import pypdf

        return len(pypdf.PdfReader(io.BytesIO(content)).pages)
    except Exception:  # noqa: BLE001  the reader of the text says what is wrong
        return None


def pdf_cut(content: bytes, first: int, pages: int) -> bytes:
    """A PDF of some pages of another. Needs ``pypdf``, which is optional."""
    import pypdf

    reader, writer, out = pypdf.PdfReader(io.BytesIO(content)), pypdf.PdfWriter(), io.BytesIO()
    for page in reader.pages[first : first + pages]:
        writer.add_page(page)
    writer.write(out)
    return out.getvalue()


def segments_udf(read):
    """Pandas UDF from bytes to ``struct<segments, error>``: a file that cannot be read is a row with its error."""

    def one(content: bytes | None) -> dict:
        try:
            return {"segments": [] if content is None else read(bytes(content)), "error": None}
        except Exception as e:  # noqa: BLE001  any parser's error belongs to its file
            return {"segments": [], "error": f"{type(e).__name__}: {e}"[:2000]}

    @F.pandas_udf(f"struct<segments:{SEGMENTS},error:string>")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in content], columns=["segments", "error"])

    return run
