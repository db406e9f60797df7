"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from labels of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.storage import materialize
from flowgraph.llm.textops import LOWER, mix, slices, span_hashes, spans, text_bytes

#: A feature's weight is found by this many bits of its hash.
FEATURE_BITS = 20
#: The features of a word are the word and its first so many bytes, for words that take endings.
STEMS = (4, 5, 6, 7)

_WORD = np.zeros(256, dtype=bool)
_WORD[97:123] = _WORD[128:] = True
_END = np.zeros(256, dtype=bool)
_END[list(b".!?\n")] = True


class Sentences:
    """The sentences of a batch of texts, ended by . ! ? or a line's end, that have a word; their words' features.

    start and end of a sentence are those of its words in the text's UTF-8 bytes.
    """

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        starts, ends, bounds = spans(_WORD[data], offsets)
        hashes = [span_hashes(data, starts, ends)]
        for n in STEMS:
            stem = span_hashes(data, starts, np.minimum(starts + n, ends))
            hashes.append(np.where(ends - starts >= n, mix(stem + np.uint64(n)), np.uint64(0)))
        self.features = (np.stack(hashes, axis=1) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        before = np.concatenate([[0], np.cumsum(_END[data])])
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (before[starts[1:]] != before[starts[:-1]]) | (owner[1:] != owner[:-1])
        self.first = np.flatnonzero(new)  # first word of each sentence
        self.doc = owner[self.first]
        last = np.append(self.first[1:], len(starts)) - 1 if len(starts) else self.first
        self.start, self.end = starts[self.first] - offsets[self.doc], ends[last] - offsets[self.doc]

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """The probability of each sentence to be toxic."""
        if not len(self.first):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(bias + np.add.reduceat(weights[self.features].sum(axis=1), self.first), -30, 30)))


def noisy_or(scores: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The probability that some sentence of a document is toxic; 0 without sentences."""
    return -np.expm1(np.bincount(doc, weights=np.log1p(-np.minimum(scores, 1 - 1e-12)), minlength=n))


def fit(features: np.ndarray, first: np.ndarray, doc: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4, least_z: float = 4.0) -> tuple[np.ndarray, float]:
    """Feature weights and a bias that make the noisy-or of the sentences fit the documents' labels (full-batch Adagrad).

    features has a row for each word; first is the first word of each sentence. Only features whose share of
    positive documents is least_z standard deviations from that of all documents get a weight, which keeps out words
    that meet a label by chance; feature 0, which stands for a missing stem, gets none.
    """
    size, n = 1 << FEATURE_BITS, len(labels)
    weights, bias, total, bias_total = np.zeros(size), -4.0, np.full(size, 1e-8), 1e-8
    if not n or not len(first):
        return weights, bias
    sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(features))))
    there, positive = np.zeros(size), np.zeros(size)
    for column in features.T:
        pairs = np.unique(doc[sentence] * size + column)
        there += np.bincount(pairs % size, minlength=size)
        positive += np.bincount(pairs % size, weights=labels[pairs // size], minlength=size)
    base = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    used = np.abs(positive - base * there) >= least_z * np.sqrt(np.maximum(there, 1) * base * (1 - base))
    used[0] = False
    word, column = np.nonzero(used[features])
    at, kept = sentence[word], features[word, column]
    for _ in range(rounds):
        z = np.clip(bias + np.bincount(at, weights=weights[kept], minlength=len(first)), -30, 30)
        q = 1 / (1 + np.exp(-z))
        p = np.clip(noisy_or(q, doc, n), 1e-6, 1 - 1e-6)
        push = np.where(labels[doc] == 1, q * (1 - p[doc]) / p[doc], -q)  # gradient of the log likelihood by z
        g = np.bincount(kept, weights=push[at], minlength=size) / n - decay * weights
        total += g * g
        weights += rate * g / np.sqrt(total)
        b = push.sum() / n
        bias_total += b * b
        bias += rate * b / np.sqrt(bias_total)
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 8_000) -> tuple[np.ndarray, float]:
    """Weights of words and the bias, learned in one task from about sample_docs labelled documents (chosen by a hash of the id).

    The sample is joined and written first, so that the one task reads nothing else, however large the tables are.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, sample_docs / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))
    chosen = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), id_col)
    chosen = materialize(chosen.select("text", "label"), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, first, doc, marks, words, n = [], [], [], [], 0, 0
        for batch in slices(batches, "text"):
            s = Sentences(batch.column("text"))
            features.append(s.features)
            first.append(s.first + words)
            doc.append(s.doc + n)
            marks.append(batch.column("label").to_numpy(zero_copy_only=False))
            words, n = words + len(s.features), n + batch.num_rows
        if n:
            weights, bias = fit(*map(np.concatenate, (features, first, doc, marks)))
            there = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(weights[there], bias))], names=["feature", "weight"])

    got = chosen.coalesce(1).mapInArrow(run, "feature long, weight double").toArrow()
    weights, bias = np.zeros(1 << FEATURE_BITS), -4.0
    at, value = got.column("feature").to_numpy(), got.column("weight").to_numpy()
    if len(at):
        weights[at[at >= 0]] = value[at >= 0]
        bias = float(value[at < 0][0])
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", located: float = 0.5) -> DataFrame:
    """(id, score, sentences): the noisy-or of each whole text's sentences, and those of at least `located`.

    sentences: (start, end, score) of offending sentences, in UTF-8 bytes of the text. A null text and one without a
    word score 0. Null ids stay; repeated rows are scored each; other columns are ignored. Without any training row
    every word weighs 0 and all sentences score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in slices(batches, "text"):
            s = Sentences(batch.column("text"))
            q = s.scores(weights, bias)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(q >= located):
                found[s.doc[i]].append({"start": int(s.start[i]), "end": int(s.end[i]), "score": float(q[i])})
            p = np.clip(noisy_or(q, s.doc, batch.num_rows), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array(found, kind)], names=["id", "score", "sentences"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = read.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double, sentences array<struct<start: long, end: long, score: double>>")
    return out.withColumnRenamed("id", id_col)
