"""Language of a text by naive Bayes over character trigrams, trained on labelled texts."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metadata import can_detect_language, sample

GRAM = 3
#: Most frequent grams of each language that the model keeps: its size does not grow with the corpus.
GRAMS_KEPT = 1500
#: Texts of each language that it is trained on: the smallest by a hash of the text.
TEXTS_PER_LANGUAGE = 400
LEAST_PROBABILITY = 0.90
#: Grams of a text that are weighed as evidence at most, so that a long one is not certain of everything.
EVIDENCE = 200
#: Texts that are weighed together.
TEXTS_AT_ONCE = 256


class LanguageModel:
    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        known = {g for c in counts.values() for g in c}
        self.logs = {}
        totals = {k: sum(c.values()) + len(known) for k, c in counts.items()}
        for g in known:
            self.logs[g] = [math.log((counts[k].get(g, 0) + 1) / totals[k]) for k in self.languages]
        ordered = sorted(self.logs)
        self.keys = self._keys(np.array([[ord(c) for c in g] for g in ordered], dtype=np.uint64).reshape(-1, GRAM).T)
        self.weights = np.array([self.logs[g] for g in ordered]).reshape(len(ordered), len(self.languages))

    @staticmethod
    def _keys(points: list | np.ndarray) -> np.ndarray:
        """One number for each gram, from the code points of its first, second and last characters."""
        return (points[0] << np.uint64(42)) | (points[1] << np.uint64(21)) | points[2]

    @staticmethod
    def grams(text: str) -> list[str]:
        padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]

    def detect(self, text: str) -> str | None:
        """The most probable language, null below the least probability."""
        found = [self.logs[g] for g in self.grams(text) if g in self.logs]
        if not found or not self.languages:
            return None
        weight = min(1.0, EVIDENCE / len(found))
        sums = [weight * sum(x[k] for x in found) for k in range(len(self.languages))]
        best = max(range(len(sums)), key=lambda k: (sums[k], -k))
        probability = 1 / sum(math.exp(s - sums[best]) for s in sums)
        return self.languages[best] if probability >= LEAST_PROBABILITY else None


    @classmethod
    def gram_keys(cls, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The grams of many texts as numbers, in a few passes over one array, and the text of each (-1 between two texts)."""
        lowered = [(t or "").lower() for t in texts]
        # each text between two separators, which are its outer spaces
        points = np.frombuffer("".join(f"\n{t}\n" for t in lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) + 2 for t in lowered], dtype=np.int64)
        of, leads = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
        distinct, which = np.unique(points, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in distinct.tolist()], dtype=bool)[which]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[leads] = True
        points, of = np.where(letter, points, 32)[kept].astype(np.uint64), of[kept]
        return cls._keys([points[:-2], points[1:-1], points[2:]]), np.where(of[:-2] == of[2:], of[:-2], -1)

    def detect_all(self, texts: list[str | None]) -> list[str | None]:
        """:meth:`detect` for many texts."""
        grams, of = self.gram_keys(texts)
        at = np.minimum(np.searchsorted(self.keys, grams), max(len(self.keys) - 1, 0))
        known = (self.keys[at] == grams) & (of >= 0) if len(self.keys) else np.zeros(len(grams), dtype=bool)
        at, of = at[known], of[known]
        n = np.bincount(of, minlength=len(texts))
        if not n.any():
            return [None] * len(texts)
        sums = np.stack([np.bincount(of, weights=self.weights[at, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        sums *= np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
        best = sums.argmax(axis=1)
        probability = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if m and p >= LEAST_PROBABILITY else None for b, m, p in zip(best.tolist(), n.tolist(), probability.tolist(), strict=True)]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """From a bounded sample of labelled texts (``TEXTS_PER_LANGUAGE`` each, 4,000 characters of each)."""
    labelled = docs.select(F.col(lang_col).alias("lang"), sample(F.col(text_col)).alias("text")).dropna().filter(can_detect_language(F.col("text")))
    # Spark keeps the first rows of each language per task before the shuffle (window group limit)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    chosen = labelled.withColumn("nth", nth).filter(F.col("nth") <= TEXTS_PER_LANGUAGE)
    texts: dict[str, list[str]] = {}
    for lang, text in chosen.select("lang", "text").collect():
        texts.setdefault(lang, []).append(text)
    return LanguageModel({lang: most_frequent(own) for lang, own in texts.items()})


def most_frequent(texts: list[str]) -> dict[str, int]:
    """The ``GRAMS_KEPT`` most frequent grams with their counts, the first in order of characters on a tie."""
    counts: Counter = Counter()
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        keys, of = LanguageModel.gram_keys(texts[at : at + TEXTS_AT_ONCE])
        for key, n in zip(*(x.tolist() for x in np.unique(keys[of >= 0], return_counts=True)), strict=True):
            counts[key] += n
    chosen = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:GRAMS_KEPT]
    return {"".join(chr(key >> shift & 0x1FFFFF) for shift in (42, 21, 0)): n for key, n in chosen}


def detector(model: LanguageModel):
    """Arrow UDF from text to language; apply :func:`detect_language` for the guards."""

    @F.arrow_udf(T.StringType())
    def detect(text: pa.Array) -> pa.Array:
        found: list[str | None] = []
        for at in range(0, len(text), TEXTS_AT_ONCE):
            found += model.detect_all(text.slice(at, TEXTS_AT_ONCE).to_pylist())
        return pa.array(found, pa.string())

    return detect


def detect_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the language, null where the text is short, is mostly no letters, or is not clear.

    The sample is nulled before it goes to Python, so texts that fail a guard are not sent.
    """
    guarded = F.when(can_detect_language(F.col(text_col)), sample(F.col(text_col)))
    return docs.withColumn(out, detector(model)(guarded))
