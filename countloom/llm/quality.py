"""Compression classifier for text quality.

Two zstandard dictionaries are trained, from good and from bad labelled texts.  A text is compressed whole with each; the one
feature is the difference of the sizes, normalised by the square root of the text's length (its noise grows like that).  A
logistic calibration with a slope that is never negative, fitted on labelled texts that no dictionary saw and weighted to the
shares of the labels in the whole table, turns it into the score.

The fit uses at most ``FIT_ROWS`` labelled ids per class (those with the smallest hash), one text of each (of several the one with the smallest
hash) and of that at most the first ``FIT_CHARS`` characters; scoring reads every text whole.

Defined results: a null or empty text has no difference, so its score is that of the difference 0; labels without a text, with
a null id or a null label are not learned from; without rows of both classes every score is 0.5; where there is too little text
to train a dictionary from, the texts themselves are the dictionary; equal texts score alike;
an empty table gives an empty result; extra columns are ignored by ``score`` (it returns id and score) and kept by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batches, give_back, held_out, read

FIT_ROWS = 1500
FIT_CHARS = 20_000
DICTIONARY = 64 << 10
LEVEL = 15
SAMPLE = 2000  # bytes of one training sample of a dictionary


@dataclass(frozen=True)
class Model:
    """Dictionaries of the good and the bad class and the calibration's weights; ``good`` is empty if there was nothing to learn from."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # at difference 0, and for each unit of it

    def scorer(self):
        if not self.good:
            return lambda text: 0.5
        a, b = _compressor(self.good), _compressor(self.bad)
        zero, slope = self.weights
        return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, zero + slope * difference(text, a, b)))))


def _compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    return zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [t[i : i + SAMPLE] for t in texts for i in range(0, len(t), SAMPLE)]
    try:
        return zstd.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstd.ZstdError:  # too little to train from: the texts themselves serve as the dictionary
        return b"".join(samples)[-DICTIONARY:] or b" " * 8


def difference(text: bytes, good: zstd.ZstdCompressor, bad: zstd.ZstdCompressor) -> float:
    """How many bytes shorter the text is with the good dictionary, over the square root of its length."""
    return (len(bad.compress(text)) - len(good.compress(text))) / math.sqrt(max(1, len(text)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Weighted logistic regression on one feature; its slope is at least 0."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(2), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return (float(w[0]), float(w[1])) if w[1] >= 0 else (0.0, 0.0)


def train(rows: list[tuple[bytes, int]], counts: tuple[int, int] | None = None) -> Model:
    """From (text, label) rows: even rows make the dictionaries, odd rows calibrate.  ``counts`` are the labels 1 and 0 of the whole table."""
    good, bad = ([t for t, y in rows if y == label and t] for label in (1, 0))
    if not good or not bad:
        return Model(b"", b"", ())
    first, rest = [x[::2] for x in (good, bad)], [x[1::2] or x for x in (good, bad)]
    dictionaries = [_dictionary(x) for x in first]
    a, b = map(_compressor, dictionaries)
    sizes = [len(x) for x in rest]
    shares = [c / sum(counts) * sum(sizes) / n for c, n in zip(counts, sizes)] if counts else [1.0, 1.0]
    x = np.array([difference(t, a, b) for side in rest for t in side])
    y, weight = np.repeat([1.0, 0.0], sizes), np.repeat(shares, sizes)
    return Model(*dictionaries, _logistic(x, y, weight))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fits on labelled rows whose crc32(id) mod 3 is not 1: one text for an id and label, however often the tables repeat them."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id"), 3, 1) & F.col("y").isin(0, 1))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    counts = marked.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    chosen = [marked.where(F.col("y") == y).distinct().orderBy(*order).limit(FIT_ROWS) for y in (0, 1)]
    found = docs.select("doc_id", F.substring("text", 1, FIT_CHARS).alias("text")).where("text <> ''")
    # numbers first, so that no task or driver holds the texts of copies
    keys = found.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "y").agg(F.min(F.xxhash64("text")).alias("key"))  # at most 2 * FIT_ROWS ids
    texts = found.join(F.broadcast(keys), "doc_id").where(F.xxhash64("text") == F.col("key")).select(order[0].alias("turn"), "doc_id", "y", "text").distinct()
    rows = sorted(texts.collect(), key=lambda r: (r["turn"], r["doc_id"], r["y"], r["text"]))
    return train([(r["text"].encode("utf-8", "replace"), r["y"]) for r in rows], tuple(counts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores = [of(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array([of(t or b"") >= least for t in texts], pa.bool_()))
        of = batch = part = texts = None
        give_back()

    return by_batches(docs, run, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
