"""Token counts by a unigram model, computed along a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.textops import slices

#: The sign of a word's begin.
BEGIN = "▁"
_LONGEST, _NODES = 64, 400_000


@cache
def piece_scores(path: str) -> dict[str, float]:
    """Log probabilities of the normal pieces of a sentencepiece file.

    The file ranks its pieces and has no probabilities, so the piece of rank r (from 0) gets the Zipf share of
    1 / (r + 2), over all ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return {p: -math.log(r + 2) - total for r, p in enumerate(pieces)}


class PreTokenTrie:
    """A trie of pre-tokens whose nodes hold the best unigram score of their prefix and its number of tokens.

    A node's forward score is the best, over the pieces that end there, of the score where the piece begins plus the
    piece's own; among equals, fewer tokens. A character that is no piece is its UTF-8 bytes, each a token that
    scores 10 less than the rarest piece. Every node is computed once, however many pre-tokens share it.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.tails = {p[i:] for p in scores for i in range(len(p))}  # what a piece can end with
        self.byte = min(scores.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def forward(self, word: str, at: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """The score and tokens of word[:at + 1], from those of all shorter prefixes."""
        n = len(word[at].encode("utf-8", "surrogatepass"))
        top = (best[at] + n * self.byte, -(count[at] + n))
        scores, tails = self.scores, self.tails
        for start in range(at, -1, -1):
            piece = word[start : at + 1]
            if piece not in tails:
                break
            if piece in scores:
                top = max(top, (best[start] + scores[piece], -(count[start] + 1)))
        return top[0], -top[1]

    def insert(self, word: str) -> tuple[float, int]:
        """The score and number of tokens at the word's terminal node."""
        best, count, node, known = [0.0], [0], 0, len(word) <= _LONGEST
        for at, char in enumerate(word):
            child = self.children.get((node, char)) if known else None
            if child is None:
                b, c = self.forward(word, at, best, count)
                if known:
                    child = self.children[node, char] = len(self.best)
                    self.best.append(b)
                    self.count.append(c)
            else:
                b, c = self.best[child], self.count[child]
            best.append(b)
            count.append(c)
            node = child if known else node
        return best[-1], count[-1]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens, score): pre-tokens, tokens and the unigram log score of every whole text.

    Pre-tokens are runs of characters without white space, each with the sign of a word's begin before it; their
    best segmentations add up. Counting needs no shuffle: each task keeps a trie of the distinct pre-tokens that it
    has met, emptied at 400,000 nodes, and pre-tokens of more than 64 characters are computed outside it. Null and
    empty texts have no tokens; null ids and repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rows = PreTokenTrie(piece_scores(model)), {}
        scores, counts = np.zeros(0), np.zeros(0, dtype=np.int64)
        for batch in slices(batches, "text"):
            words = [t.split() for t in batch.column("text").fill_null("").to_pylist()]
            if len(trie.best) > _NODES:
                trie.clear()
                rows, scores, counts = {}, np.zeros(0), np.zeros(0, dtype=np.int64)
            new = sorted({w for own in words for w in own if w not in rows})
            got = [trie.insert(BEGIN + w) for w in new]
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            scores = np.concatenate([scores, [s for s, _ in got]])
            counts = np.concatenate([counts, np.array([c for _, c in got], dtype=np.int64)])
            at = [np.fromiter(map(rows.__getitem__, own), dtype=np.int64, count=len(own)) for own in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(own) for own in words], pa.int64()), pa.array([int(counts[i].sum()) for i in at], pa.int64()), pa.array([float(scores[i].sum()) for i in at], pa.float64())],
                names=["id", "n_pretokens", "n_tokens", "score"],
            )

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_pretokens long, n_tokens long, score double").withColumnRenamed("id", id_col)
