"""Vectorised word and window hashing over batches of whole texts (NumPy, no per-word loop).

A batch of texts is joined into one byte array. A word's hash is a polynomial over
its bytes, read from one running sum, so the cost is a few passes over the bytes
whatever the words are. Hashes have 64 bits; two different words or windows of one
corpus of n distinct ones share a hash with probability about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that one pass holds at most (a longer single text is a pass of its own).
PASS_BYTES = 1 << 18
#: Bytes of text that are taken out of a batch at once (a longer single text alone).
SLICE_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_WORD_STEP = 0xD6E8FEB86659FD93

_bytes = np.arange(256)
#: ASCII white space, the only separator of plain words.
SPACE_SEPARATED = ~np.isin(_bytes, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Digits, lower-case letters and every byte of a non-ASCII code point.
ALPHANUMERIC = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
_LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)


def powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006  the cache is meant to stay
    """base**0 .. base**(n-1) modulo 2**64."""
    known = cache.get(base)
    if known is None or len(known) < n:
        size = 1 << max(10, (n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 2 * PASS_BYTES:
            cache[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that every bit is usable."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Words:
    """The words of a batch: ``hashes``, byte bounds, and ``first[d]:first[d+1]`` of text d."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: bool = True):
        joined = b"\n".join([*texts, b""])
        self.raw = np.frombuffer(joined, dtype=np.uint8)
        if lower:
            self.raw = _LOWER[self.raw]
        inside = np.empty(len(self.raw) + 1, dtype=bool)
        inside[0] = False
        np.take(is_word, self.raw, out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self._total = np.empty(len(self.raw) + 1, dtype=np.uint64)
        self._total[0] = 0
        np.cumsum(_BYTE_VALUE[self.raw] * powers(_STEP, len(self.raw)), out=self._total[1:])
        self.hashes = self.span_hashes(self.starts, self.ends)
        text_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.text_starts = text_starts
        self.first = np.searchsorted(self.starts, text_starts)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, end), for each pair."""
        return mix((self._total[ends] - self._total[starts]) * powers(_STEP_INVERSE, len(self.raw) + 1)[starts])

    def windows(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each word on; the last ``length - 1`` are left out."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        step = powers(_WORD_STEP, length)
        out = self.hashes[:n] * step[0]
        for k in range(1, length):
            out += self.hashes[k : k + n] * step[k]
        return mix(out + U64(length))

    def word_bytes(self, first: int, length: int) -> bytes:
        """The words themselves, joined by one space: exact, for verification."""
        return b" ".join(self.raw[s:e].tobytes() for s, e in zip(self.starts[first : first + length], self.ends[first : first + length], strict=True))


def stretches(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of about ``SLICE_BYTES`` of its text column ``at``, so that a worker's Python copies stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    nth = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = np.flatnonzero(nth[1:] != nth[:-1]) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if end > begin:
            yield batch.slice(begin, end - begin)


def slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The stretches of a batch, each with its texts as bytes; a null is empty."""
    for run in stretches(batch, at):
        yield run, [b"" if x is None else x for x in run.column(at).cast(pa.large_binary()).to_pylist()]


def passes(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch into runs of about ``PASS_BYTES``: position of the first text, texts."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > PASS_BYTES:
            yield begin, texts[begin:k]
            begin, held = k, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, texts[begin:]


def shingle_sets(texts: list[bytes], length: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's ``length``-word shingles.

    A text with fewer words, but not none, has its whole word sequence as its only
    shingle; a text without words has the empty set.
    """
    for _, run in passes(texts):
        words = Words(run, SPACE_SEPARATED)
        hashes = words.windows(length)
        for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            n = end - begin
            if n >= length:
                one = np.sort(hashes[begin : end - length + 1])
                yield one[np.concatenate(([True], one[1:] != one[:-1]))]
            elif n:
                yield mix((words.hashes[begin:end] * powers(_WORD_STEP, n)).sum(dtype=np.uint64, keepdims=True) + U64(n))
            else:
                yield np.empty(0, dtype=np.uint64)
