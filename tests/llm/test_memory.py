"""What Python workers hold."""

import tracemalloc

import pyarrow as pa

from flowgraph.llm import langid, packing
from flowgraph.llm.queries import tokenizer_path
from flowgraph.llm.tokens import encoder


def test_workers_hold_no_words_after_packing(spark):
    """Workers are used again; all that packing taught them would stay beside later stages."""
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, f"word{i} other{i} common") for i in range(400)], "doc_id long, text string").repartition(4)
    assert packing.pack(docs, path).count() >= 400

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encoder(path, False).pieces)])], names=["n"])

    assert spark.range(8, numPartitions=8).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0


def test_letter_tables_are_built_without_lists_of_all_characters():
    """Every worker builds them; as lists they took 212 MB for a moment."""
    langid._letters.cache_clear()
    tracemalloc.start()
    letter, lower = langid._letters()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    assert letter[ord("a")] and not letter[ord("1")] and lower[ord("Ä")] == ord("ä") and lower[0x130] == 0x130
