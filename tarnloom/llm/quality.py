"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

1. Each text becomes a few statistics (byte classes, words, lines, repetition). Nothing
   but the text enters.
2. cos(W x + b) with Gaussian W approximates a Gaussian kernel. Each partition sums its
   part of the normal equations over all labelled rows; the sums meet in one small matrix
   whose size depends on ``FEATURES`` alone, and a ridge solve gives the scores.
3. Labelled rows kept out of the fit are counted by score bin; pool-adjacent-violators
   over the bins makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .wordscan import SPACE_SEPARATED, U64, Words, mix, passes, slices

#: Random features; the normal equations have FEATURES + 1 rows.
FEATURES = 192
#: Width of the kernel, in standard deviations of the statistics.
KERNEL_WIDTH = 4.0
RIDGE = 1e-3
BINS = 2048
THRESHOLD = 0.7
SEED = 7

_b = np.arange(256)
_CLASSES = {
    "upper": (_b >= 65) & (_b <= 90),
    "lower": (_b >= 97) & (_b <= 122),
    "digit": (_b >= 48) & (_b <= 57),
    "non_ascii": _b >= 0x80,
    "blank": np.isin(_b, [9, 11, 12, 13, 32]),
    "newline": _b == 10,
    "sentence": np.isin(_b, [ord(c) for c in ".,;:?"]),
    "exclaim": _b == ord("!"),
    "bracket": np.isin(_b, [ord(c) for c in "()[]{}<>|/\\=\"'"]),
    "symbol": np.isin(_b, [ord(c) for c in "#$%&*+@^_`~-"]),
    "control": (_b < 9) | ((_b > 13) & (_b < 32)) | (_b == 127),
}
NAMES = ["log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "most_frequent_word", "distinct_pairs", "distinct_lines", "line_words", "entropy", "ends_in_symbol", *_CLASSES]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``len(NAMES)`` numbers per text; all are 0 for an empty one."""
    out = np.zeros((len(texts), len(NAMES)), dtype=np.float32)
    class_of = np.stack(list(_CLASSES.values())).astype(np.float64)
    symbol = _CLASSES["symbol"] | _CLASSES["exclaim"]
    for begin, run in passes(texts):
        words = Words(run, SPACE_SEPARATED)
        last_byte = words.raw[words.ends - 1] if len(words.ends) else words.raw[:0]
        lengths = (words.ends - words.starts).astype(np.float64)
        pairs = mix(words.hashes[:-1] * U64(3) + words.hashes[1:]) if len(words.hashes) > 1 else words.hashes[:0]
        for k, text in enumerate(run):
            if not text:
                continue
            row = out[begin + k]
            counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(np.float64)
            n_bytes = len(text)
            share = counts[counts > 0] / n_bytes
            row[9] = -(share * np.log(share)).sum()
            row[11:] = class_of @ counts / n_bytes
            row[0] = np.log1p(n_bytes)
            a, b = int(words.first[k]), int(words.first[k + 1])
            n = b - a
            if n:
                _, often = np.unique(words.hashes[a:b], return_counts=True)
                row[1:6] = np.log1p(n), lengths[a:b].mean(), np.log1p(lengths[a:b].max()), len(often) / n, often.max() / n
                row[6] = len(np.unique(pairs[a : b - 1])) / (n - 1) if n > 1 else 1
                row[10] = symbol[last_byte[a:b]].mean()
            lines = [x for x in text.split(b"\n") if x.strip()]
            row[7] = len(set(lines)) / len(lines) if lines else 1
            row[8] = np.log1p(n / max(len(lines), 1))
    return out


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, texts in slices(batch, 1):
            rows = statistics(texts)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1), pa.float32()), len(NAMES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([run.column(0), flat], ["doc_id", "stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` of every row; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    doc = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return doc.mapInArrow(_statistics_of, f"doc_id {kind}, stats array<float>")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (a null id is in fold 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4, F.lit(0))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    @staticmethod
    def expanded(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(SEED))
        w = rng.normal(size=(stats.shape[1], FEATURES)) / KERNEL_WIDTH
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats.astype(np.float64) - mean) / scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expanded(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, with a slight slope that keeps the ridge order inside a flat step; a step at the threshold itself is so split by that order."""
        raw = self.raw(stats)
        step = np.interp(raw, self.knots, self.values)
        return np.clip(np.round(step * (1 - 1e-6) + 1e-6 / (1 + np.exp(-np.clip(raw, -30, 30))), 12), 0.0, 1.0)


def _rows(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.asarray(batch.column(at).flatten(), dtype=np.float32).reshape(-1, len(NAMES))


def _equations(mean: np.ndarray, scale: np.ndarray):
    """Each partition's sums, upper triangle of [Z y]' [Z y]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((FEATURES + 2, FEATURES + 2)), 0
        for batch in batches:
            if batch.num_rows:
                z = Model.expanded(_rows(batch, 0), mean, scale)
                zy = np.hstack([z, np.asarray(batch.column(1), dtype=np.float64)[:, None]])
                total += zy.T @ zy
                n += batch.num_rows
        if n:
            cell = np.flatnonzero(np.triu(np.ones_like(total)).reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.reshape(-1)[cell])], ["cell", "value"])

    return run


def pooled(bins: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ``(score, rows, positives)`` in order to knots and values that never fall."""
    blocks: list[list[float]] = []
    for at, n, positive in bins:
        blocks.append([at * n, n, positive])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(labelled: DataFrame) -> Model:
    """Fit on ``labelled(stats, label, fold)``: folds 0 and 1 for the ridge, 3 for calibration.

    All labelled rows enter; what reaches the driver is bounded by FEATURES and BINS. Without
    labels, or with one class only, every score is that class's share (0.5 without any).
    """
    train = labelled.filter("fold in (0, 1)")
    each = [F.struct(F.avg(F.col("stats")[i].cast("double")).alias("m"), F.stddev_pop(F.col("stats")[i].cast("double")).alias("s")) for i in range(len(NAMES))]
    found = train.agg(F.count("*").alias("n"), F.avg("label").alias("share"), F.array(*each).alias("x")).first()
    if not found["n"] or found["share"] in (0.0, 1.0):
        share = 0.5 if not found["n"] else float(found["share"])
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(FEATURES + 1), np.array([0.0]), np.array([share]))
    mean = np.array([x["m"] for x in found["x"]])
    scale = np.maximum(np.array([x["s"] for x in found["x"]]), 1e-6)
    sums = np.zeros((FEATURES + 2) ** 2)
    cells = train.select("stats", F.col("label").cast("double")).mapInArrow(_equations(mean, scale), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    for cell, value in cells.collect():
        sums[cell] = value
    full = sums.reshape(FEATURES + 2, FEATURES + 2)
    full = full + np.triu(full, 1).T
    gram, right = full[:-1, :-1], full[:-1, -1]
    model = Model(mean, scale, np.linalg.solve(gram + RIDGE * found["n"] * np.diag([1.0] * FEATURES + [0.0]) + 1e-9 * np.eye(FEATURES + 1), right), np.array([0.0]), np.array([0.5]))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.clip(np.round(model.raw(_rows(batch, 0)) * BINS / 2), -BINS, BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "label"])

    by_bin = labelled.filter("fold = 3").select("stats", "label").mapInArrow(raw, "bin long, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("positive"))
    bins = sorted((r["bin"] * 2 / BINS, r["n"], r["positive"]) for r in by_bin.collect())
    model.knots, model.values = pooled(bins) if bins else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Labels are learnt only from rows whose id is not held out (fold 2). Null and empty
    texts are scored like others, from statistics that are all 0. Labels without an id, a
    value or a document are left out, and repeated ones count each. Without usable labels
    every score is 0.5. Other columns are ignored.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    model = _fitted(stats, labels, label_id_col, label_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_rows(batch, 1)))], ["doc_id", "score"])

    out = stats.mapInArrow(scored, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _fitted(stats: DataFrame, labels: DataFrame, label_id_col: str, label_col: str) -> Model:
    known = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().filter("label in (0, 1)")
    known = known.withColumn("fold", fold()).filter("fold <> 2")
    return fit(materialize(stats.join(known, "doc_id").select("stats", "label", "fold"), "labelled"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without what the classifier rejects. Scores are made where the rows are, so no text is shuffled, and nothing but texts goes to Python."""
    model = _fitted(document_statistics(docs, id_col, text_col), labels, label_id_col, label_col)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(statistics(run)) for _, run in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0)]
        return pa.array(np.concatenate([*parts, np.empty(0)]))

    return docs.filter(score(F.col(text_col).cast("string")) >= threshold)
