"""Near-duplicate groups by sketches against brute force: hot groups, chains, copies, nulls and odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowgraph.llm import minhash, queries, verified

SCHEMA = "doc_id long, text string"


def shingles(text, k):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def groups_of(rows, k):
    """The smallest id of each row's component, over all pairs of rows."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                up[top(i)] = top(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[top(i)] = min(doc_id, low.get(top(i), doc_id))
    return [(doc_id, len(sets[i]), low.get(top(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def texts(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [word() for _ in range(60)]
    rows = []
    for _ in range(120):  # copies that are near the base, but often not near each other
        own = list(base)
        for at in rng.sample(range(60), rng.randrange(1, 4)):
            own[at] = word()
        rows.append(own)
    chain = [word() for _ in range(40)]
    for _ in range(30):
        chain = [*chain[1:], word()]
        rows.append(chain)
    rows += [[word() for _ in range(rng.randrange(1, 50))] for _ in range(60)]
    rows = [" ".join(r) for r in rows]
    rows += [rows[0], rows[0].upper(), rows[3], "one", "ONE", "one two", "two one", "É é", "É É", "", None, " \n", "x y " * 4000, "x y " * 4001]
    ids = rng.sample(range(10**6), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rows = texts(seed) + [(None, "one two three four five"), (None, None), (None, "one"), (7, "same id first text"), (7, "quite another text"), (7, "same id first text")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = minhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(groups_of(rows, 2), key=str)


def test_cells_of_large_buckets(spark, monkeypatch):
    """Buckets and clusters are cut in parts of a few members."""
    monkeypatch.setattr(verified, "_PART", 7)
    for rows, orders in ((texts(3), 1), (texts(4), 2)):
        found = verified.verified_groups(spark.createDataFrame(rows, SCHEMA), verified.Sketches(minhash.mark, minhash.near, minhash.agree), 2, "doc_id", "text", orders=orders)
        found = found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        assert sorted(map(tuple, found.collect()), key=str) == sorted(groups_of(rows, 2), key=str)


def test_sketches():
    rng = np.random.default_rng(4)
    for similarity in (0.5, 0.8, 0.95):
        for size in (3, 40, 3000):
            both = int(round(size * similarity))
            agree = []
            for _ in range(60):
                items = rng.integers(1, 1 << 63, 2 * size - both, dtype=np.uint64)
                a, b = np.sort(items[:size]), np.sort(items[size - both :])
                sketch = minhash.fast_sketches(np.concatenate([a, b]), np.array([0, size, 2 * size]))
                assert (sketch != minhash._EMPTY).all() and np.isin(sketch & np.uint64(0), [0]).all()
                agree.append((sketch[0] == sketch[1]).mean())
            exact = both / (2 * size - both)
            assert abs(np.mean(agree) - exact) < 0.03
            assert np.std(agree) < 1.2 * (exact * (1 - exact) / minhash.BINS) ** 0.5 + 0.01
    assert (minhash.fast_sketches(np.zeros(0, dtype=np.uint64), np.array([0, 0])) == 0).all()


def test_shingle_sets():
    own, bounds = verified.shingle_sets(pa.array(["a b a b a", "A\tb", None, "", "a", "a b c"]), 2)
    assert np.diff(bounds).tolist() == [2, 1, 0, 0, 1, 2]
    assert own[bounds[1]] in own[: bounds[1]] and own[bounds[1]] in own[bounds[5] :]


def test_registered_query_and_tables(spark, tmp_path):
    rows = [(1, "a b c d e f g h i j k", "x"), (2, "a b c d e f g h i j", "x"), (3, "z", "x"), (None, "z", "x"), (5, None, "x")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, node string").write.parquet(f"{path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_minhash(spark, path).collect()), key=str)
    assert got == sorted([(1, 10, 1, True), (2, 9, 1, False), (3, 1, 3, True), (None, 1, 3, False), (5, 0, 5, True)], key=str)
    empty = spark.createDataFrame([], "key long, body string, hash int, component_id int")
    found = minhash.near_duplicates(empty, "key", "body")
    assert found.columns == ["key", "n_shingles", "component_id"] and found.isEmpty()


def test_sql_of_the_query(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    rows = texts(5)
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(queries.OP12_SQL).fetchall()) == sorted((i, n, c, i == c) for i, n, c in groups_of(rows, 2))
