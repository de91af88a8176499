"""Document fingerprints by winnowing.

Rolling hashes of every ``GRAM`` code points; of each window of ``WINDOW`` consecutive hashes the least is chosen, the
rightmost where several are least; chosen hashes are kept with their positions.  So any passage of at least
``GRAM + WINDOW - 1`` code points that two texts share puts a common hash into both fingerprints.

Defined results: a null text is the empty text, whose fingerprint is empty; a text of fewer than ``GRAM`` code points has
the hash of the whole text; one with fewer hashes than a window has the least of them; the likeness of two empty
fingerprints is 1; documents follow each other by descending id (null ids last, equal ids by text), after the last comes the
first, and a document that is alone is its own next; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batches, read

GRAM = 8
WINDOW = 12
#: Expected rows of one range of ids, of which there are at most so many (beyond that they have more rows, which a task sorts with spills).
RANGE_ROWS, MOST_RANGES = 4000, 50_000
FINGERPRINT = "array<struct<hash: long, position: long>>"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of every ``gram`` code points; of the whole if there are fewer."""
    gram = min(gram, len(codes))
    if not gram:
        return np.empty(0, np.uint64)
    m = len(codes) - gram + 1
    c = codes.astype(np.uint64)
    # powers of two steps: the hash of 2 k code points from those of k
    h, have, weight = c + np.uint64(1), 1, _BASE
    out, covered, scale = None, 0, np.uint64(1)
    rest = gram
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = h[covered : covered + m]
                out = part * scale if out is None else out + part * scale
                covered += have
                scale *= weight
            rest >>= 1
            if rest:
                h = h[: len(h) - have] + h[have:] * weight
                have, weight = 2 * have, weight * weight
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out >> np.uint64(32)


def winnow(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, by position."""
    hashes = _hashes(codes, gram)
    n = len(hashes)
    if not n:
        return hashes, np.empty(0, np.int64)
    window = min(window, n)
    # the position counts from the right in the low bits, so the least key is the rightmost least hash
    key = (hashes << np.uint64(32)) | np.arange(n - 1, -1, -1).astype(np.uint64)
    least, have = key, 1
    while have < window:
        step = min(have, window - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    chosen = least[np.flatnonzero(np.append(True, least[1:] != least[:-1]))]
    return chosen >> np.uint64(32), (n - 1 - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the sets of chosen hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """The chosen hashes in order and the steps between their positions (the first from 0, each of at most a window) as text; see ``read_digest``."""
    steps = np.diff(positions, prepend=0)
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode() + "." + base64.b64encode(steps.astype("<u2").tobytes()).decode()


def read_digest(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a ``digest``."""
    hashes, steps = (base64.b64decode(x) for x in text.split("."))
    return np.frombuffer(hashes, "<u4").astype(np.uint64), np.cumsum(np.frombuffer(steps, "<u2").astype(np.int64))


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprint) with the chosen hashes and positions of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [winnow(codes_of(t or ""), gram, window) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0] + [len(h) for h, _ in found]).astype(np.int32)
                whole = [np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.empty(0, np.int64) for k in (0, 1)]
                structs = pa.StructArray.from_arrays([pa.array(x) for x in whole], ["hash", "position"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, structs)], ["doc_id", "fingerprint"])

    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, fingerprint {FINGERPRINT}")


def _below(bounds: list[int], key: Column) -> Column:
    """How many of the sorted ``bounds`` are less than the key (binary search in a constant array)."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        less = F.get(array, middle) < key
        return F.when(s["low"] >= s["high"], s).otherwise(
            F.struct(F.when(less, middle + 1).otherwise(s["low"]).alias("low"), F.when(less, s["high"]).otherwise(middle).alias("high"))
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["low"])


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (place, last, doc_id, text), a partition for each place: sorted by descending id each row's next is the following row of its place.

    Places are ranges of ids, cut from the ids alone; an id with the rows of several ranges, and the rows without an id, are cut by their
    texts' hashes.  A place's rows end with ``last``, a copy of the first row of the place that follows (of the first place, for the
    last one).  So every text is moved once and no place needs another.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    points = [i / ranges for i in range(1, ranges)]
    cuts = (ids.select(F.percentile_approx("doc_id", points, min(1_000_000, 100 * ranges))).first()[0] or []) if points else []
    often = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    bounds = sorted(set(cuts) | {i - 1 for i in often if i > -(1 << 63)})
    # range 0 has the highest ids; a null id comes after all others
    key = F.col("doc_id")
    at = F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(len(bounds) - _below(bounds, key)).cast("int")
    counts = {r["at"]: r["n"] for r in ids.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()}  # a number a range
    whole = {len(bounds) + 1, *(sum(b >= i for b in bounds) for i in often)}
    parts = [-(-counts.get(r, 0) // RANGE_ROWS) if r in whole else 1 for r in range(len(bounds) + 2)]
    firsts = np.cumsum([0, *(max(1, k) for k in parts)])
    of = lambda values, r: F.get(F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<int>"), r)
    tie = F.xxhash64("text")
    turn = F.floor((2.0**63 - tie.cast("double")) / 2.0**64 * of(parts, F.col("at")))  # rises as the hash falls
    turn = F.least(turn, of(parts, F.col("at")) - 1).cast("int")
    place = of(firsts, F.col("at")) + F.when(of(parts, F.col("at")) > 1, turn).otherwise(0)
    placed = docs.select("doc_id", "text", at.alias("at")).select("doc_id", "text", place.cast("int").alias("place"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), tie.alias("tie"))
    # the first row of each place: three numbers a place
    heads = [(r["place"], r["m"]["doc_id"], r["m"]["tie"]) for r in placed.groupBy("place").agg(F.max(order).alias("m")).orderBy("place").collect()]
    columns = ["place", "last", "doc_id", "text"]
    rows = placed.withColumn("last", F.lit(False)).select(*columns)
    if not heads:
        return rows
    before = [(head[0], heads[i - 1][0], head[1], head[2]) for i, head in enumerate(heads)]
    heads_df = docs.sparkSession.createDataFrame(before, "place int, to_place int, head_id long, head_tie long")
    same = (placed["place"] == heads_df["place"]) & (order["doc_id"] == heads_df["head_id"]) & (order["tie"] == heads_df["head_tie"])
    copies = placed.join(F.broadcast(heads_df), same).select(F.col("to_place").alias("place"), F.lit(True).alias("last"), "doc_id", "text")
    copies = copies.groupBy("place", "last").agg(F.first(F.struct("doc_id", "text")).alias("x")).select("place", "last", "x.doc_id", "x.text")
    return rows.unionByName(copies).repartitionById(int(firsts[-1]), F.col("place"))


def edited(text: str, following: str) -> str:
    """The last half replaced by the beginning of ``following``."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


EDITS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def compare_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints (hashes and positions, see ``digest``) of every text, of its edited text, and the likenesses (see ``EDITS``)."""
    rows = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (place, id, text, chosen hashes and positions) of the row whose next is still to come
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for place, last, doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    chosen = winnow(codes_of(text), gram, window)
                    if held is not None and held[0] == place:
                        other = edited(held[2], text)
                        new = winnow(codes_of(other), gram, window)
                        sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((held[1], len(held[2]), sha, digest(*held[3]), digest(*new), likeness(held[3][0], new[0]), likeness(held[3][0], chosen[0])))
                    held = None if last else (place, doc_id, text, chosen)
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    names = [x.split()[0] for x in EDITS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    placed = rows.sortWithinPartitions(F.col("place"), F.col("last"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc(), "text")
    return by_batches(placed.select("place", "last", "doc_id", "text"), run, EDITS)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(read(spark, sf_dir, "documents", "doc_id", "text"))
