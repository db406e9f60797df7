"""Language identification: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.llm.textops import HashIndex, mix, ranges, slices, span_hashes, spans

#: Longest and shortest n-grams of unseen words.
GRAMS = (4, 3, 2, 1)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case where that is one code point."""
    size = 0x110000
    letters = np.fromiter((chr(i).isalpha() for i in range(size)), dtype=bool, count=size)
    return letters, np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(size)), dtype=np.uint32, count=size)


@dataclass
class LanguageModel:
    """Log frequencies per language of words and of n-grams, by hash. Its size is bounded when it is trained."""

    languages: list[str]
    word_keys: np.ndarray
    word_logs: np.ndarray
    gram_keys: np.ndarray
    gram_logs: np.ndarray


class _Words:
    """Words (runs of letters, lower-cased) of a batch of texts as spans of code points."""

    def __init__(self, texts: list[str | None]):
        letter, lower = _letters()
        points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
        data = np.concatenate(points) if points else np.zeros(0, dtype=np.uint32)
        self.data = lower[data]
        self.starts, self.ends, self.bounds = spans(letter[data], offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def grams(self, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams of the words of that index, and the place in `of` of each one's word."""
        counts = np.maximum(self.ends[of] - self.starts[of] - n + 1, 0)
        at = ranges(self.starts[of], counts)
        hashes = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            hashes = mix(hashes + self.data[at + j])
        return hashes, np.repeat(np.arange(len(of)), counts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 4_000, max_words: int = 200_000, max_grams: int = 100_000) -> LanguageModel:
    """A model of the rows with a language, learned from about docs_per_language documents of each (chosen by a hash of the id).

    It holds at most max_words words seen twice or more and max_grams n-grams, an equal share for each language's most
    frequent ones, so it stays small whatever the table, and no language loses its words to a larger one; the counting
    itself is a Spark aggregation.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = {r[0]: min(1.0, docs_per_language / r[1]) for r in known.groupBy(lang_col).count().collect()}
    languages = sorted(share)
    if not languages:
        none = np.zeros(0, dtype=np.uint64)
        return LanguageModel([], none, np.zeros((0, 0)), none, np.zeros((0, 0)))
    index = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    level = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(int(share[lang] * (1 << 20))))])
    chosen = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < level[F.col(lang_col)])
    chosen = chosen.select(index[F.col(lang_col)].alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = _Words(batch.column("text").to_pylist())
            lang = np.repeat(batch.column("lang").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(words.bounds))
            parts = [(0, words.hashes, lang)]
            for n in GRAMS:
                hashes, owner = words.grams(np.arange(len(lang)), n)
                parts.append((1, hashes, lang[owner]))
            for kind, hashes, langs in parts:
                for one in np.unique(langs):
                    keys, n = np.unique(hashes[langs == one], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind)), pa.array(keys.view(np.int64)), pa.array(np.full(len(n), one)), pa.array(n)], names=["kind", "key", "lang", "n"])

    counts = chosen.mapInArrow(count, "kind long, key long, lang long, n long")
    rows = counts.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("kind", "key")
    rows = rows.withColumn("all", F.sum("n").over(whole)).where("kind = 1 or all > 1")
    share_of = F.when(F.col("kind") == 0, max(1, max_words // len(languages))).otherwise(max(1, max_grams // len(languages)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "key")))
    rows = rows.withColumn("kept", F.max(F.col("place") <= share_of).over(whole)).where("kept")
    got = rows.select("kind", "key", "lang", "n").orderBy("kind", "key", "lang").toArrow()
    kinds, keys, langs, n = (got.column(c).to_numpy() for c in ("kind", "key", "lang", "n"))
    tables = []
    for kind in (0, 1):
        own, at = np.unique(keys[kinds == kind], return_inverse=True)
        table = np.zeros((len(own), len(languages)))
        table[at, langs[kinds == kind]] = n[kinds == kind]
        logs = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * max(len(table), 1)))
        tables += [own.view(np.uint64), logs]
    return LanguageModel(languages, *tables)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language of each whole text, and its share of the likelihood (0 to 1).

    A known word adds its log frequency in each language. An unseen word adds the mean log frequency of its 4-grams
    that are known, or if none is, of its 3-grams, and so on; a word without any known letter adds nothing. Equal
    languages: the first in alphabetic order. A null text and one without a letter give `und` and 0, and so does any
    text if nothing was learned. Null ids stay; repeated rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known, grams, names = HashIndex(m.word_keys), HashIndex(m.gram_keys), np.array([*m.languages, "und"], dtype=object)
        for batch in slices(batches, "text"):
            words = _Words(batch.column("text").to_pylist())
            sums = np.zeros((batch.num_rows, len(m.languages)))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(words.bounds))
            row = known.find(words.hashes)
            seen = row >= 0
            _add(sums, owner[seen], m.word_logs, row[seen])
            todo = np.flatnonzero(~seen)
            for n in GRAMS:
                hashes, of = words.grams(todo, n)
                row = grams.find(hashes)
                seen = row >= 0
                number = np.bincount(of[seen], minlength=len(todo))
                _add(sums, owner[todo[of[seen]]], m.gram_logs, row[seen], 1 / number[of[seen]])
                todo = todo[number == 0]
            best, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            lettered = np.diff(words.bounds) > 0
            if m.languages and lettered.any():
                best[lettered] = sums[lettered].argmax(axis=1)
                score[lettered] = 1 / np.exp(sums[lettered] - sums[lettered].max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[best], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def _add(sums: np.ndarray, owner: np.ndarray, logs: np.ndarray, rows: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
    for i in range(sums.shape[1]):
        sums[:, i] += np.bincount(owner, weights=logs[rows, i] * weight, minlength=len(sums))


def keep_identified(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with at least min_score; rows without a letter go. Rows with a null id stay.

    Rows that repeat an id are one document: if one of them is rejected, all go.
    """
    rejected = predict(docs, model, id_col, text_col).where((F.col("lang_pred") == "und") | (F.col("score") < min_score)).select(id_col)
    return docs.join(rejected, id_col, "left_anti")
