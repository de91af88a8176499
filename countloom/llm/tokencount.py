"""Token counts under a unigram piece vocabulary by a trie-shared dynamic program.

A text's pre-tokens are its white space separated words, each with the word-start mark before it.  A pre-token's best
segmentation maximises the sum of its pieces' scores.  The best score of a prefix does not depend on what follows, so distinct
pre-tokens go into a trie and the forward step is made once per trie node: a node holds the best score and the token count
of its prefix, and the node a pre-token ends at is its terminal count.  No text is segmented twice and nothing is shuffled.

Pieces and their order come from a public sentencepiece vocabulary; the score of the piece of rank r (ids in order, specials
left out) is ``-ln(r + 2)``, Zipf's law, unless scores are given.  A code point that no piece covers costs ``UNKNOWN`` and
counts as its UTF-8 bytes (byte fallback).  Between segmentations of equal score the one with fewer tokens wins.

Defined results: a null, empty or wordless text has 0 tokens; very long texts and words are counted whole; repeated rows each
get their count; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batches, read

MARK = "▁"
UNKNOWN = -30.0
#: A worker's trie is begun anew beyond so many nodes, which changes no count.
NODES = 1_200_000

_TRIES: dict[str, Trie] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def scores_of(path: str) -> dict[str, float]:
    """Piece -> score from a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(pieces)}


class Trie:
    """Nodes are numbers; node 0 is the word-start mark.  ``forward`` and ``tokens`` belong to the node's whole prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        # pieces by last character and then by the characters before it, so that a node asks only for pieces that can end there
        self.longest: dict[str, list[int]] = {}
        for p in scores:
            self.longest.setdefault(p[-1], []).append(len(p))
        self.longest = {c: sorted(set(n)) for c, n in self.longest.items()}
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int] | None] = [{}]
        score = self.scores.get(MARK)
        self.forward = [UNKNOWN if score is None else score]
        self.tokens = [len(MARK.encode()) if score is None else 1]
        self.terminals: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """Inserts a pre-token; its terminal count."""
        children, node, depth = self.children, 0, 0
        path = [0]
        for c in word:
            below = children[node]
            nxt = None if below is None else below.get(c)
            if nxt is None:
                break
            path.append(nxt)
            node, depth = nxt, depth + 1
        if depth < len(word):
            self._extend(word, path)
            node = path[-1]
        return self.tokens[node]

    def _extend(self, word: str, path: list[int]) -> None:
        children, forward, tokens, scores = self.children, self.forward, self.tokens, self.scores
        marked = MARK + word
        for end in range(len(path) + 1, len(marked) + 1):  # the new node's prefix is marked[:end]
            c = marked[end - 1]
            best, fewest = forward[path[end - 2]] + UNKNOWN, tokens[path[end - 2]] + len(c.encode("utf-8", "surrogatepass"))
            for n in self.longest.get(c, ()):
                if n > end:
                    break
                s = scores.get(marked[end - n : end])
                if s is not None:
                    if n < end:
                        before = path[end - n - 1]
                        s, k = s + forward[before], tokens[before] + 1
                    else:
                        k = 1
                    if s > best or s == best and k < fewest:
                        best, fewest = s, k
            node = len(children)
            children.append(None)
            forward.append(best)
            tokens.append(fewest)
            parent = path[-1]
            if children[parent] is None:
                children[parent] = {}
            children[parent][c] = node
            path.append(node)

    def totals(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """The words and the tokens of each text."""
        split = [t.split() for t in texts]
        known = self.terminals
        new = set().union(*split).difference(known) if split else ()
        if len(self.children) > NODES:
            self.clear()
            known = self.terminals
            new = set().union(*split)
        for word in sorted(new):  # neighbours share their path
            known[word] = self.count(word.decode("utf-8", "replace"))
        get = known.__getitem__
        return [len(words) for words in split], [sum(map(get, words)) for words in split]


def token_counts(docs: DataFrame, vocabulary: str | None = None, scores: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every text; ``scores`` (piece -> score) takes the place of ``vocabulary``."""
    path = vocabulary or (None if scores else default_vocabulary())
    shared = None if scores is None else docs.sparkSession.sparkContext.broadcast(scores)  # a vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is not None:
            trie = Trie(shared.value)
        elif path not in _TRIES:
            trie = _TRIES[path] = Trie(scores_of(path))
        else:
            trie = _TRIES[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                words, tokens = trie.totals(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_tokens long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_tokens).  No public unigram model is at hand: the pieces are those of a public vocabulary and their scores Zipf's law by
    rank, so the counts are those of that model, not of the vocabulary's own encoder (``token_counts`` takes other scores)."""
    return token_counts(read(spark, sf_dir, "documents", "doc_id", "text"))
