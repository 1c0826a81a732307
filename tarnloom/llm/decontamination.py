"""Benchmark decontamination: a broadcast set of test n-grams against every training window.

The set holds a 64-bit hash of each window of the benchmark, and where the window's words
are in one packed buffer of the items' words. Its size is checked: beyond
``WINDOWS_AT_ONCE`` windows the benchmark is cut into blocks, each within the bound. Blocks
are scanned one after the other, each scan's hits written before the next begins, so that
no worker ever holds two. A window whose hash is in the set is compared word by word, so
hash collisions cannot mark a clean document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize
from .wordscan import ALPHANUMERIC, U64, Words, passes, slices

#: Words of a window; items with fewer words are one window of their own length.
WINDOW_WORDS = 13
#: Windows of the benchmark that are broadcast at once (each costs about 24 bytes and those of one word).
WINDOWS_AT_ONCE = 2_000_000
#: A document is contaminated when at least one word in this many is hit.
WORDS_PER_HIT = 20
_PRESENT_BITS = 20
_FOUND = "n_words long, hits array<struct<begin:long,end:long>>, items array<string>"
_HITS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


class Windows:
    """The windows of one length: sorted hashes, and for each its item's number and where its words are in the buffer."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        hashes, item, begin, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.begin, self.size = hashes[order], item[order], begin[order], size[order]
        self.present = np.zeros(1 << _PRESENT_BITS, dtype=bool)
        self.present[(self.hashes >> U64(64 - _PRESENT_BITS)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where in ``hashes`` one of these windows may be."""
        at = np.flatnonzero(self.present[(hashes >> U64(64 - _PRESENT_BITS)).astype(np.int64)])
        first = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        return at[self.hashes[first] == hashes[at]]


class WindowSet:
    """The windows of some benchmark items, in flat arrays."""

    def __init__(self, length: int):
        self.length, self.n, self.items = length, 0, []
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.pieces, self.filled = [], 0

    def add(self, item_id, text: str | None) -> None:
        words = Words([(text or "").encode()], ALPHANUMERIC)
        n = len(words.hashes)
        if not n:
            return
        length = min(n, self.length)
        ends = np.cumsum(words.ends - words.starts + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n_windows = n - length + 1
        self.parts.setdefault(length, []).append((
            words.windows(length), np.full(n_windows, len(self.items), dtype=np.int32),
            starts[:n_windows] + self.filled, (ends[length - 1 :] - starts[:n_windows]).astype(np.int32),
        ))
        self.items.append(None if item_id is None else str(item_id))
        self.pieces.append(words.word_bytes(0, n))
        self.filled += len(self.pieces[-1])
        self.n += n_windows

    def frozen(self) -> WindowSet:
        """Ready to be scanned for."""
        self.by_length = {length: Windows(parts) for length, parts in self.parts.items()}
        self.buffer = b"".join(self.pieces)
        self.parts, self.pieces = {}, []
        return self

    def hits(self, words: Words) -> dict[int, list[tuple[int, int, set[int]]]]:
        """By text: (first word, words, items) of each verified window."""
        found: dict[int, list[tuple[int, int, set[int]]]] = {}
        for length, windows in self.by_length.items():
            hashes = words.windows(length)
            at = windows.places(hashes)
            text = np.searchsorted(words.first, at, side="right") - 1
            inside = at + length <= words.first[text + 1]
            at, text = at[inside], text[inside]
            low, high = (np.searchsorted(windows.hashes, hashes[at], side=side) for side in ("left", "right"))
            for k, d, a, b in zip(at.tolist(), text.tolist(), low.tolist(), high.tolist(), strict=True):
                exact = words.word_bytes(k, length)
                begins, sizes = windows.begin[a:b].tolist(), windows.size[a:b].tolist()
                items = {i for i, s, n in zip(windows.item[a:b].tolist(), begins, sizes, strict=True) if self.buffer[s : s + n] == exact}
                if items:
                    found.setdefault(d, []).append((k - int(words.first[d]), length, items))
        return found


def window_sets(benchmark: DataFrame, item_col: str, text_col: str, length: int, at_once: int) -> Iterator[WindowSet]:
    """The benchmark as window sets of at most ``at_once`` windows each, and those of one more item, read row by row; one at least."""
    held = WindowSet(length)
    for row in benchmark.select(item_col, text_col).toLocalIterator(prefetchPartitions=False):
        if held.n >= at_once:
            yield held.frozen()
            held = WindowSet(length)
        held.add(row[0], row[1])
    yield held.frozen()


def _scan(shared):
    """A column function of the texts and, but for the first block, of what the blocks before have found."""

    @F.arrow_udf(_FOUND)
    def scan(texts: pa.Array, *before: pa.Array) -> pa.Array:
        windows = shared.value
        n_words, all_hits, all_items = [], [], []
        for batch, run in slices(pa.RecordBatch.from_arrays([texts, *before], ["text", "hits", "items"][: 1 + len(before)]), 0):
            known = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True) if before else (([], []) for _ in run)
            for _, part in passes(run):
                words = Words(part, ALPHANUMERIC)
                found = windows.hits(words)
                n_words.append(np.diff(words.first))
                for d in range(len(part)):
                    old, items = next(known)
                    own = found.get(d, ())
                    named = {windows.items[i] for _, _, of in own for i in of} - {None}
                    all_items.append(sorted(named.union(items)))
                    all_hits.append([{"begin": s, "end": e} for s, e in merged([*((s, s + n) for s, n, _ in own), *((x["begin"], x["end"]) for x in old)])])
        return pa.StructArray.from_arrays([pa.array(np.concatenate([*n_words, np.empty(0)]).astype(np.int64)), pa.array(all_hits, _HITS), pa.array(all_items, pa.list_(pa.string()))], names=["n_words", "hits", "items"])

    return scan.asNondeterministic()  # so that a filter on its result is not moved below it, with a scan of its own


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [begin, end) as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = WINDOW_WORDS, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n_words, hits, items``.

    ``hits`` are disjoint spans [begin, end) of word positions covered by benchmark
    windows, ``items`` the ids (as strings, sorted) of the items whose windows occur. Texts
    are compared as words of ASCII digits, letters (A-Z lower-cased) and non-ASCII
    characters. Null and empty texts have no words. A benchmark item without words has no
    window; one without an id hits, but is not listed; repeated items count once. An empty
    benchmark hits nothing. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    before, last = [], None
    for windows in window_sets(benchmark, item_col, item_text_col, length, at_once):
        if last is not None:
            out = materialize(out, "hits")
            last.unpersist()
            before = [F.col("hits"), F.col("items")]
        last = spark.sparkContext.broadcast(windows)
        out = out.select("doc_id", "text", _scan(last)("text", *before).alias("found")).select("doc_id", "text", "found.*")
    return out


def n_hit() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])


def is_contaminated() -> F.Column:
    return (n_hit() > 0) & (n_hit() * WORDS_PER_HIT >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated documents. Their rows pass through one scan, so nothing is joined."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), F.col(text_col).alias("text"))
    return contamination(whole, benchmark).filter(~is_contaminated()).select("doc_id.*")


def without_spans(text: str | None, hits: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``hits`` and what stands between the words of one hit."""
    if not text or not hits:
        return text
    raw = text.encode()
    words = Words([raw], ALPHANUMERIC)
    out, at = [], 0
    for begin, end in hits:
        out.append(raw[at : words.starts[begin]])
        at = int(words.ends[end - 1])
    return b"".join([*out, raw[at:]]).decode(errors="replace")


def remove_spans(found: DataFrame) -> DataFrame:
    """The result of :func:`contamination` as ``doc_id, text`` with every hit cut out of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_spans(t, [(x["begin"], x["end"]) for x in hits]) for t, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return found.select("doc_id", "text", "hits").mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, text string")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
