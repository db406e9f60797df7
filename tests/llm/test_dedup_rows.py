"""Line dedup and the near-copy stage row by row: repeated ids, clashing names, hot groups, confirmed chains."""

import random

import pytest
from pyspark.sql import functions as F

from flowgraph.llm import linededup, simhash, verified
from tests.llm.test_minhash import groups_of, texts


def test_repeated_ids_lose_no_unique_text(spark):
    run = " ".join(f"r{i}" for i in range(60))
    rows = [(1, run), (2, run), (2, "keep me, unique line\nsecond unique"), (2, f"{run}\nmore"), (None, run)]
    got = linededup.delete_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id is None, r.text, r.n_deleted) for r in got) == sorted([(False, run, 0), (False, "", 1), (False, rows[2][1], 0), (False, "more", 1), (True, run, 0)])


def test_line_dedup_with_clashing_names(spark):
    run = " ".join(f"r{i}" for i in range(60))
    names = ["n_lines", "text", "n_deleted", "runs", "hash", "id", "c0", "__linededup_id", "key"]
    rows = spark.createDataFrame([("x", run, 1.5, 1, 2, 3, 4, 5, 1), ("y", f"own\n{run}", 2.5, 6, 7, 8, 9, 10, 2)], names)
    got = linededup.delete_repeated_runs(rows, "key")
    assert got.columns == ["text", "runs", "hash", "id", "c0", "__linededup_id", "key", "n_lines", "n_deleted"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[6]) == [(run, 1, 2, 3, 4, 5, 1, 1, 0), ("own", 6, 7, 8, 9, 10, 2, 2, 1)]


def test_winnowing_selects_the_same_line_of_equal_windows():
    rng = random.Random(4)
    values = [rng.randrange(100) for _ in range(200)]
    windows = [(i, i + rng.randrange(1, 6)) for i in range(190)]
    for (lo, hi), at in zip(windows, linededup.minima(values, windows)):
        assert lo <= at < hi and values[at] == min(values[lo:hi]) and values[at] not in values[lo:at]


@pytest.mark.parametrize("seed", [6, 7])
def test_near_copies_are_confirmed(spark, monkeypatch, seed):
    """Nothing is joined that no chain of similar pairs joins, and nearly all that such chains join."""
    monkeypatch.setattr(verified, "_PART", 16)
    rows = texts(seed)
    got = {r.doc_id: r.component_id for r in simhash.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for i, n, c in groups_of(rows, 5) if n}
    joined = {c: i for i, c in want.items()}
    assert all(want[got[i]] == want[i] for i in want)  # within true groups
    assert len({got[i] for i in want}) <= len(joined) * 1.02


def test_one_copy_stays(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(4, base), (9, f"{base} x"), (4, f"{base} y"), (7, "other text of five words"), (4, base), (None, base), (7, None), (8, "")]
    kept = simhash.keep_one_copy(spark.createDataFrame(rows, "key long, body string").withColumn("hash", F.lit(1)), "key", "body")
    assert kept.columns == ["key", "body", "hash"]
    left = sorted((str(r.key), r.body or "") for r in kept.collect())
    fours = [x for x in left if x[0] == "4"]
    assert [x for x in left if x[0] != "4"] == [("7", ""), ("7", "other text of five words"), ("None", base)]
    assert fours in ([("4", base)] * 2, [("4", f"{base} y")])
