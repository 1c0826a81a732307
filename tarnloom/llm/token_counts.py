"""Token counts by a linear longest-match automaton, without building the pieces.

The vocabulary is a trie over bytes. Each node has a failure link and the number of tokens
that are complete when the link is taken, so greedy longest match reads every byte once
and follows no more links than there are bytes (Song et al., "Fast WordPiece
Tokenization", 2021). Single bytes are always tokens, so every text has a count.

A text is read in chunks: a word with the one space before it, or a run of other white
space. Equal chunks of a batch are counted once; a bounded table keeps recent counts.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordscan import SPACE_SEPARATED, Words, passes, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Chunks whose counts a task remembers (about 100 bytes each).
REMEMBERED = 400_000


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """The automaton. Node 0 is the root; ``step`` maps node * 256 + byte to a node."""

    def __init__(self, vocabulary: list[bytes]):
        step: dict[int, int] = {}
        whole = [False]
        for token in [*(bytes([b]) for b in range(256)), *vocabulary]:
            node = 0
            for byte in token:
                nxt = step.get(node << 8 | byte)
                if nxt is None:
                    nxt = step[node << 8 | byte] = len(whole)
                    whole.append(False)
                node = nxt
            whole[node] = bool(token) or whole[node]
        below: dict[int, list[tuple[int, int]]] = {}
        for edge, node in step.items():
            below.setdefault(edge >> 8, []).append((edge & 255, node))
        link, popped = [0] * len(whole), [0] * len(whole)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in below.get(parent, ()):
                if whole[node]:
                    link[node], popped[node] = 0, 1
                else:
                    at, n = link[parent], popped[parent]
                    while (nxt := step.get(at << 8 | byte)) is None:
                        n += popped[at]
                        at = link[at]
                    link[node], popped[node] = nxt, n
                queue.append(node)
        self.step, self.link, self.popped = step, link, popped

    def count(self, chunk: bytes) -> int:
        step, link, popped = self.step.get, self.link, self.popped
        node = n = 0
        for byte in chunk:
            while (nxt := step(node << 8 | byte)) is None:
                n += popped[node]
                node = link[node]
            node = nxt
        while node:
            n += popped[node]
            node = link[node]
        return n


def chunks(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the chunks of a run of texts, and the text of each."""
    words = Words(texts, SPACE_SEPARATED, lower=False)
    n = len(words.raw)
    begins = np.zeros(n + 1, dtype=bool)
    begins[words.ends] = True
    begins[words.text_starts] = True
    joints = words.text_starts[1:] - 1
    begins[joints] = True
    spaced = np.zeros(len(words.starts), dtype=bool)
    after = words.starts > 0
    spaced[after] = words.raw[words.starts[after] - 1] == 0x20
    begins[words.starts - spaced] = True
    starts = np.flatnonzero(begins[:n])
    ends = np.append(starts[1:], n)
    joint = np.zeros(n + 1, dtype=bool)
    joint[joints] = True
    real = ~joint[starts]
    starts, ends = starts[real], ends[real]
    return words, starts, ends, np.searchsorted(words.text_starts, starts, side="right") - 1


def _counts(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = automaton.value.count, {}
        for batch in batches:
            for rows, texts in slices(batch, 1):
                totals = np.zeros(len(texts), dtype=np.int64)
                for begin, texts_of in passes(texts):
                    words, starts, ends, text_of = chunks(texts_of)
                    distinct, first, which = np.unique(words.span_hashes(starts, ends), return_index=True, return_inverse=True)
                    each = np.empty(len(distinct), dtype=np.int64)
                    raw = words.raw.tobytes()
                    for k, (h, s, e) in enumerate(zip(distinct.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
                        n = known.get(h)
                        if n is None:
                            n = known[h] = count(raw[s:e])
                        each[k] = n
                    if len(known) > REMEMBERED:
                        known.clear()
                    totals[begin : begin + len(texts_of)] = np.bincount(text_of, weights=each[which], minlength=len(texts_of))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(totals)], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens``.

    The automaton is broadcast; its size is that of the vocabulary. Null and empty texts
    have no tokens. Ids may be null or repeated. Other columns are ignored.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(LongestMatch(read_vocabulary(vocabulary)))
    doc = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return doc.mapInArrow(_counts(automaton), f"doc_id {doc.schema['doc_id'].dataType.simpleString()}, n_tokens long")
