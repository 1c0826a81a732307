"""OCR layout trees to segments, page shards, and the escalation from local parsing to OCR."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import mime
from ..operators.headings import SECTION_LENGTH
from ..operators.quality_gate import assess, passes, rejection, remedy
from ..storage import written
from .office import SEGMENTS, pdf_cut

OCR_METHOD = "docai-layout-v1"
SHARD_PAGES = 15
SHARD_BYTES = 20_000_000
MOST_PAGES = 500
# Types of blocks that open a section.
HEADINGS = re.compile("^(heading|title|subtitle)", re.IGNORECASE)


def shards(pages: Column) -> Column:
    """``array<struct<offset, pages>>``: runs of 15 pages; one run for what has no pages."""
    starts = F.sequence(F.lit(0), F.greatest(pages, F.lit(1)) - 1, F.lit(SHARD_PAGES))
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.least(F.lit(SHARD_PAGES), F.greatest(pages, F.lit(1)) - s).alias("pages")))


def halved(offset: int, page_bytes: list[int], most: int = SHARD_BYTES) -> list[tuple[int, int]]:
    """(offset, pages) of a shard's parts, halved until each fits or is one page."""
    if sum(page_bytes) <= most or len(page_bytes) <= 1:
        return [(offset, len(page_bytes))]
    half = len(page_bytes) // 2
    return halved(offset, page_bytes[:half], most) + halved(offset + half, page_bytes[half:], most)


def cut(content: bytes, kind: str, pages: int | None, cutter: Callable[[bytes, int, int], bytes] = pdf_cut, most: int = SHARD_BYTES) -> Iterator[tuple[int, bytes]]:
    """(page offset, content) of the parts that one call of the extractor takes: 15 pages and ``most`` bytes, or one page.

    Only a PDF of known length can be cut; all else is one part.
    """
    if kind != mime.PDF or not pages or (pages <= SHARD_PAGES and len(content) <= most):
        yield 0, content
        return
    todo = [(at, min(SHARD_PAGES, pages - at)) for at in range(0, pages, SHARD_PAGES)][::-1]
    while todo:
        first, n = todo.pop()
        part = cutter(content, first, n)
        if len(part) <= most or n == 1:
            yield first, part
        else:
            todo += [(first + n // 2, n - n // 2), (first, n // 2)]


def over_budget(pages: Column) -> Column:
    return F.coalesce(pages > MOST_PAGES, F.lit(False))


def one_line(blocks: list[dict]) -> str:
    return " ".join(" ".join(b["text"] for b in blocks if b.get("text")).split())


def table_markdown(table: dict) -> str:
    row = lambda cells: "| " + " | ".join(one_line(c.get("blocks", [])) for c in cells) + " |"
    header = [r for r in table.get("header", []) if r]
    lines = [row(r) for r in header]
    if header:
        lines.append("| " + " | ".join(["---"] * max(map(len, header))) + " |")
    lines += [row(r) for r in table.get("rows", []) if r]
    caption = (table.get("caption") or "").strip()
    return "\n".join([caption, *lines] if caption else lines)


def list_markdown(entries: list[dict]) -> str:
    return "\n".join(f"- {b['text'].strip()}" for e in entries for b in e.get("blocks", []) if b.get("text"))


def tree_segments(tree: dict, offset: int = 0) -> list[dict]:
    """Segments of a layout tree ``{"blocks": [...]}``.

    A block has ``page`` and one of ``text`` (with ``type`` and nested ``blocks``), ``table``
    (``header``, ``rows``, ``caption``) or ``list`` (``entries``). A heading begins a segment
    and is part of it; a new page begins one too, in the same section.
    """
    out: list[dict] = []
    now: dict = {"parts": [], "page": None, "section": None}

    def close() -> None:
        body = "\n\n".join(p for p in now["parts"] if p.strip()).strip()
        if body:
            out.append({"text": body, "page": now["page"], "section": now["section"]})
        now["parts"] = []

    stack = [*reversed(tree.get("blocks", []))]
    while stack:
        block = stack.pop()
        page = block["page"] + offset if block.get("page") else None
        if page is not None and now["page"] not in (None, page):
            close()
        now["page"] = page if page is not None else now["page"]
        if block.get("text"):
            if HEADINGS.match(block.get("type") or ""):
                close()
                now["section"], now["page"] = block["text"].strip()[:SECTION_LENGTH] or None, page
            now["parts"].append(block["text"])
        for rendered in (table_markdown(block["table"]) if block.get("table") else "", list_markdown(block["list"].get("entries", [])) if block.get("list") else ""):
            if rendered:
                now["parts"].append(rendered)
        stack.extend(reversed(block.get("blocks", [])))
    close()
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("section", T.StringType())])))
def layout_segments(tree: pd.Series, offset: pd.Series) -> pd.Series:
    """Segments of a layout tree in JSON, page numbers moved by the shard's offset."""
    return pd.Series([[] if t is None else tree_segments(json.loads(t), int(o or 0)) for t, o in zip(tree, offset, strict=True)])


class Staging(Protocol):
    """A bucket that the batch extractor reads from and writes to."""

    def put(self, name: str, content: bytes, kind: str) -> None: ...

    def names(self, prefix: str) -> list[str]: ...

    def get(self, name: str) -> bytes: ...

    def delete(self, name: str) -> None: ...


def batch_client(bucket: Staging, start: Callable[[str, str, str], Callable[[], None]], prefix: str = "ocr") -> Callable[[bytes, str], dict]:
    """A client that stages a file, runs a batch operation over it, and joins the JSON shards that it leaves.

    ``start`` is given the input's name, its MIME type and the output's prefix, and returns
    what waits for the end. Shards are joined in the order of their names. Whatever happens,
    everything staged is deleted.
    """

    def run(content: bytes, kind: str) -> dict:
        root = f"{prefix}/{uuid.uuid4().hex}"
        try:
            bucket.put(f"{root}/input/document", content, kind)
            start(f"{root}/input/document", kind, f"{root}/output/")()
            found = [json.loads(bucket.get(name)) for name in sorted(bucket.names(f"{root}/output/")) if name.endswith(".json")]
            if not found:
                raise RuntimeError("the batch operation left no output")
            return {"blocks": [block for tree in found for block in tree.get("blocks", [])]}
        finally:
            for name in bucket.names(f"{root}/"):
                bucket.delete(name)

    return run


def ocr_stage(files: DataFrame, client: Callable[[bytes, str], dict], concurrency: int = 4, batch: Callable[[bytes, str], dict] | None = None, batch_pages: int = 30, cutter: Callable[[bytes, int, int], bytes] = pdf_cut) -> DataFrame:
    """``segments`` by a remote extractor, an injected function from bytes and MIME type to a layout tree.

    A long PDF is cut into parts whose page numbers are moved back to the whole document, or
    goes to ``batch`` whole if that is given and it has more than ``batch_pages`` pages. As
    many files are worked on at once as there are partitions, and four parts of each. An
    error of the client is the row's error.
    """
    fields = [f for f in files.schema.fields if f.name not in ("segments", "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", segments {SEGMENTS}, error string"

    def read(content: bytes, kind: str, pages: int | None) -> list[dict]:
        if batch and (pages or 0) > batch_pages:
            return tree_segments(batch(content, kind))
        with ThreadPoolExecutor(4) as pool:
            parts = pool.map(lambda part: tree_segments(client(part[1], kind), part[0]), cut(content, kind, pages, cutter))
            return [s for part in parts for s in part]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows[[f.name for f in fields]].copy()
            found, errors = [], []
            lengths = rows["page_count"] if "page_count" in rows else [None] * len(rows)
            for content, kind, pages in zip(rows["content"], rows["mime"], lengths, strict=True):
                try:
                    found.append(read(bytes(content), kind, None if pages is None or pd.isna(pages) else int(pages)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    found.append([])
                    errors.append(f"{type(e).__name__}: {e}"[:2000])
            yield out.assign(segments=found, error=errors)

    return files.select(*(f.name for f in fields)).repartition(concurrency).mapInPandas(run, schema)


def extract_with_escalation(local: DataFrame, client: Callable[[bytes, str], dict] | None, ocr_enabled: bool, least: int = 50, **ocr) -> DataFrame:
    """From :func:`tarnloom.sources.files.extract_local` with ``page_count``: local text, else OCR, else an error.

    The local extraction is written once, as both branches read it. Only rows that fail the
    gate reach the client: they are a branch of their own, as a filter next to a Python
    function would not promise that it is not called. ``ocr`` goes to :func:`ocr_stage`.
    """
    judged = local.withColumn("method", F.lit("local")).withColumn("report", assess(F.col("segments"), F.col("page_count")))
    if client is None:
        return _gated(judged, least, remedy(False, ocr_enabled))
    wanted = F.col("mime").isin(mime.OCR_ONLY) | (F.col("mime").isin(mime.OCR_CAPABLE) & F.col("error").isNull() & ((F.size("segments") == 0) | ~passes(F.col("report"), least)))
    judged = written(judged.withColumn("__wanted", F.coalesce(wanted & ~over_budget(F.col("page_count")), F.lit(False))), "judged")
    kept = _gated(judged.filter("not __wanted").drop("__wanted"), least, remedy(False, ocr_enabled))
    done = ocr_stage(judged.filter("__wanted").drop("report", "__wanted"), client, **ocr).withColumn("method", F.lit(OCR_METHOD))
    return kept.unionByName(_gated(done.withColumn("report", assess(F.col("segments"), F.col("page_count"))), least, remedy(True, ocr_enabled)))


def _gated(df: DataFrame, least: int, advice: str) -> DataFrame:
    empty = F.size("segments") == 0
    message = F.when(F.col("error").isNotNull(), F.col("error")).when(over_budget(F.col("page_count")) & (empty | ~passes(F.col("report"), least)), F.lit(f"more than {MOST_PAGES} pages")).when(empty, F.concat(F.lit("No extractable text found. "), F.lit(advice))).when(~passes(F.col("report"), least), rejection(F.col("report"), least, advice))
    return df.withColumn("error", message)
