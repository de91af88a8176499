"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one cell per hash position and in each cell one bit per language (as many words of ``WORD`` bits
as the languages need), so the AND of an n-gram's cells is the set of all languages that contain it.  Over a text's n-grams the bits are counted by language; the counts are
corrected for each language's false-positive rate, and the largest decides.

The filter holds the ``PROFILE`` most frequent n-grams of each language, learned from at most ``FIT_ROWS`` labelled rows a
language (smallest id hash) of at most ``FIT_CHARS`` characters.  Texts are read whole.

Defined results: ``und`` with score 0 where the text is null or has no letter; where no n-gram of a text is known, the
language with the most sampled rows, score 0; ties go to the first language in order; rows with a null language, text or id
are not learned from; without any to learn from every result is ``und``; equal texts get equal results; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_batches, held_out, read

FIT_ROWS = 800
FIT_CHARS = 20_000
PROFILE = 3000
#: Languages in a word of a cell.
WORD = 64
CELLS = 1 << 18
HASHES = 3
SIZES = (2, 3, 4)
#: Code points that are worked on at once.
BLOCK = 1 << 17

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Mask of eight languages -> which of them it has.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else a space."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and spaces of all texts, each between spaces, and where each begins."""
    raw = " ".join(texts).join("  ").encode("utf-32-le", "surrogatepass")
    codes = _letters()[np.frombuffer(raw, "<u4")]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return codes, starts


def _grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams without a space inside (at the ends they may have one), and where they begin."""
    if len(codes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(codes) - n + 1
    c = codes.astype(np.uint64)
    letter = codes != 32
    good = letter[: m] | letter[n - 1 :]
    for k in range(1, n - 1):
        good &= letter[k : k + m]
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = (h ^ c[k : k + m]) * _ODD[k]
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(good)
    return h[at], at


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    fallback: int
    cells: np.ndarray  # uint64 masks, a row for each ``WORD`` languages
    false_rate: np.ndarray

    def masks(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """Which languages of a word have each hash."""
        first, *rest = _positions(hashes)
        out = self.cells[word][first]
        for p in rest:
            out &= self.cells[word][p]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        codes, starts = _codes(texts)
        found, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        # the space before a text belongs to it, the last one to the last text
        text_of = np.append(np.repeat(np.arange(len(texts)), np.diff(starts)), len(texts) - 1)
        for n in SIZES:
            hashes, at = _grams(codes, n)
            own = text_of[at]
            for k in range(0, len(self.languages), 8):  # eight languages at once: texts by combination of bits
                masks = masks if k % WORD else self.masks(hashes, k // WORD)
                some = ((masks >> np.uint64(k % WORD)) & np.uint64(255)).astype(np.int64)
                by = np.bincount(own * 256 + some, minlength=256 * len(texts)).reshape(-1, 256)
                found[:, k : k + 8] += (by @ _BITS)[:, : len(self.languages) - k]
                total += by.sum(1) if not k else 0
        real = np.maximum(0, (found - total[:, None] * self.false_rate) / (1 - self.false_rate))
        best, sums = real.argmax(1), real.sum(1)
        none = real.max(1) <= 0
        score = np.where(none, 0.0, real.max(1) / np.where(sums > 0, sums, 1))
        letters = np.add.reduceat(np.append(codes != 32, False).astype(np.int64), starts[:-1]) if texts else np.empty(0)
        return (
            ["und" if not a else self.languages[self.fallback if e else b] for a, b, e in zip(letters, best, none)],
            [float(s) if a else 0.0 for a, s in zip(letters, score)],
        )


def _positions(hashes: np.ndarray) -> list[np.ndarray]:
    """Cells of each hash: double hashing with the two halves."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * high) & np.uint64(CELLS - 1)).astype(np.int64) for k in range(HASHES)]


def profile(texts: list[str]) -> list[int]:
    """The ``PROFILE`` n-grams that most of a language's texts have."""
    counted: dict[int, int] = {}
    for at in range(0, len(texts), 64):
        codes, starts = _codes(texts[at : at + 64])
        for n in SIZES:
            hashes, where = _grams(codes, n)
            own = np.searchsorted(starts, where, "right")
            # documents that have the n-gram: a text that repeats itself weighs no more than others
            order = np.lexsort((hashes, own))
            hashes, own = hashes[order], own[order]
            hashes = hashes[np.append(True, (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1]))[: len(hashes)]]
            for h, c in zip(*(x.tolist() for x in np.unique(hashes, return_counts=True))):
                counted[h] = counted.get(h, 0) + c
    return sorted(counted, key=lambda h: (-counted[h], h))[:PROFILE]


def build(profiles: list[tuple[str, int, np.ndarray]]) -> Model:
    """From (language, texts, n-grams), in the order of languages."""
    cells = np.zeros((max(1, -(-len(profiles) // WORD)), CELLS), np.uint64)
    fill = np.zeros(len(profiles))
    for k, (_, _, top) in enumerate(profiles):
        word, bit = cells[k // WORD], np.uint64(k % WORD)
        for p in _positions(top):
            np.bitwise_or.at(word, p, np.uint64(1) << bit)
        fill[k] = ((word >> bit) & np.uint64(1)).mean()
    counts = [n for _, n, _ in profiles]
    return Model(tuple(lang for lang, _, _ in profiles), int(np.argmax(counts)) if counts else 0, cells, fill**HASHES)


def train(rows: list[tuple[str, str]]) -> Model:
    """From (text, language) rows."""
    by: dict[str, list[str]] = {}
    for text, lang in rows:
        by.setdefault(lang, []).append(text)
    return build([(lang, len(by[lang]), np.array(profile(by[lang]), np.uint64)) for lang in sorted(by)])


def fit(docs: DataFrame) -> Model:
    """Fits on rows with a language whose crc32(id) mod 4 is not 2."""
    marked = docs.where(F.col("lang").isNotNull() & (F.length("text") <= FIT_CHARS) & ~held_out(F.col("doc_id"), 4, 2))
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("tie")
    ids = marked.select("doc_id", "lang", F.xxhash64("text").alias("tie"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"))
    for within in (["lang", "part"], ["lang"]):  # the first rows of each part of a language, then of the language
        turn = F.row_number().over(W.partitionBy(*within).orderBy(*order))
        ids = ids.withColumn("turn", turn).where(F.col("turn") <= FIT_ROWS)
    chosen = ids.select("doc_id", "lang").distinct()  # at most FIT_ROWS ids a language
    rows = marked.join(F.broadcast(chosen), ["doc_id", "lang"]).select("text", "lang")

    def profiled(table: pa.Table) -> pa.Table:  # one language, at most FIT_ROWS texts but for repeated ids
        texts = table.column("text").to_pylist()
        top = np.array(profile(texts), np.uint64).tobytes()
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()], pa.string()), "n": pa.array([len(texts)], pa.int64()), "top": pa.array([top], pa.binary())})

    found = rows.groupBy("lang").applyInArrow(profiled, "lang string, n long, top binary").collect()  # PROFILE hashes a language
    return build(sorted(((r["lang"], r["n"], np.frombuffer(r["top"], np.uint64)) for r in found), key=lambda x: x[0]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS masks: 2 MB for each WORD languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                block, size = [], 0
                while at + len(block) < len(texts) and (not block or size < BLOCK):
                    block.append(texts[at + len(block)] or "")
                    size += len(block[-1])
                names, scores = model.predict(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )
                at += len(block)

    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
