"""Best-fit packing of token sequences, planned on the histogram of lengths.

1. Documents are tokenized once (Arrow batches), an end id is added, documents over the capacity are cut into pieces.
2. Best-fit decreasing runs over the counts of lengths, not over documents: at most ``capacity`` lengths, and sequences
   with the same room left are handled as ranges, so the plan's size depends on the capacity alone.
3. Pieces get a rank within their length (bucket counts give each bucket its first rank, so no length meets in one task)
   and take the slot that the plan has for that rank.

Defined results: a null or empty text is the end id alone; very long texts become many pieces; repeated rows are packed
each for itself (equal rows are interchangeable); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_batches, cut, give_back, read

CAPACITY = 2048
END = b"\x00\x00\x00\x00"
BUCKET_ROWS = 5000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker remembers (about 100 bytes each); the table is emptied when full.  Results do not depend on it.
REMEMBERED = 1_000_000
#: ASCII punctuation that may follow a word; its ids don't depend on the word.
MARKS = b""".,;:!?*#$%&|<>()[]{}/=+-_~^@\\\""""

_TOKENIZERS: dict[tuple[str, int], Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids as little-endian 32-bit bytes.

    The tokenizer lower-cases, drops white space and never looks across it, so a text's ids are those of its white space
    separated words in turn.  Each distinct word is encoded once; words of letters go to the tokenizer many to a line,
    and the tokens that end a word tell them apart again.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered

    @classmethod
    def of(cls, path: str, remembered: int = REMEMBERED) -> Encoder:
        if (path, remembered) not in _TOKENIZERS:
            _TOKENIZERS[path, remembered] = cls(path, remembered)
        return _TOKENIZERS[path, remembered]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        for word, ids in zip(words, self._ids([w.decode("utf-8", "replace") for w in words])):
            self.known[word] = ids.tobytes()

    def _learn_letters(self, words: list[bytes]) -> None:
        lines = [words[i : i + 64] for i in range(0, len(words), 64)]
        for line, ids in zip(lines, self._ids([b" ".join(x).decode() for x in lines])):
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(line):
                self._learn(line)
                continue
            raw, start = ids.tobytes(), 0
            for word, stop in zip(line, (4 * stops).tolist()):
                self.known[word], start = raw[start:stop], stop

    def learn(self, new: set[bytes]) -> None:
        """Adds words; one that ends in punctuation is that of its letters and that of the punctuation."""
        parts = {w: (base, w[len(base) :]) for w in new if len(base := w.rstrip(MARKS)) < len(w) and base and _letters(base)}
        more = new.difference(parts).union(*parts.values()).difference(self.known)
        letters = [w for w in more if _letters(w)]
        self._learn_letters(letters)
        rest = list(more.difference(letters))
        for at in range(0, len(rest), 4096):
            self._learn(rest[at : at + 4096])
        known = self.known
        for word, (base, marks) in parts.items():
            known[word] = known[base] + known[marks]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]  # special tokens are case-sensitive
        new = set().union(*split).difference(self.known)
        if len(self.known) + 2 * len(new) > self.remembered:
            self.known.clear()
            new = set().union(*split)
        self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _letters(word: bytes) -> bool:
    """Letters of the first Unicode blocks alone: one pre-token (U+0130 is none in lower case)."""
    return word.isalpha() or (text := word.decode("utf-8", "replace")).isalpha() and max(text) < "\u0250" and "\u0130" not in text


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, remembered: int = REMEMBERED, forget: bool = False) -> DataFrame:
    """One row per piece of every document.  With ``forget`` a worker's words and their memory go when its task ends."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, remembered)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                out: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    ids += END
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc_id, k, start, len(own) // 4, zlib.crc32(own)))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if forget:
            encoder.known.clear()
            give_back()

    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots as rows (length, first_rank, n, each, first_sequence, offset).

    Ranks first_rank .. first_rank + n - 1 of a length go to sequences from first_sequence on, ``each`` to one, from
    ``offset``.  Lengths are placed in falling order, each into the sequences with the least room that holds it.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, n)
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, n: int, free: int, each: int) -> None:
            nonlocal rank, left
            rows.append((length, rank, n * each, each, first, capacity - free))  # noqa: B023
            rank, left = rank + n * each, left - n * each
            if free > each * length:  # noqa: B023
                room.setdefault(free - each * length, []).append((first, n))  # noqa: B023

        while left:
            free = min((r for r in room if r >= length), default=0)
            if free:
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
            else:
                free = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            each = free // length
            whole = min(n, left // each)
            if whole:
                put(first, whole, free, each)
            if left and whole < n:
                put(first + whole, 1, free, left)
                whole += 1
            if whole < n:
                room.setdefault(free, []).append((first + whole, n - whole))
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.  Reads ``parts`` several times: hand over a stored table."""
    spark = parts.sparkSession
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 20))
    keyed = parts.withColumn("spread", spread)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if not counts:
        return parts.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    sizes = spark.createDataFrame([(k, -(-n // BUCKET_ROWS)) for k, n in counts.items()], "length long, buckets long")
    keyed = keyed.join(F.broadcast(sizes), "length").withColumn("bucket", F.floor(F.col("spread") * F.col("buckets") / (1 << 20)))
    firsts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    turn = F.row_number().over(W.partitionBy("length", "bucket").orderBy("spread", "doc_id", "piece", "ids_crc32"))
    ranked = keyed.withColumn("turn", turn).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("turn") - 1)
    slots = spark.createDataFrame(plan(counts, capacity), "slot_length long, first_rank long, n long, each long, first_sequence long, at long")
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    placed = ranked.join(F.broadcast(slots), fits)  # slots: a few thousand rows at any input size
    k = F.col("rank") - F.col("first_rank")
    return placed.select(
        *parts.columns,
        (F.col("first_sequence") + F.floor(k / F.col("each"))).alias("sequence_id"),
        (F.col("at") + k % F.col("each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, remembered: int = REMEMBERED, forget: bool = False) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer, capacity, remembered, forget), "pieces"), capacity)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
