"""The Merkle manifest and the periodic runs against plain versions, over nulls, repeated rows, odd names and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgraph.llm import merkle, periodic, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 :][:8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def plain_manifest(rows):
    leaf = lambda r, text: digest("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    for i, g in enumerate(order):
        for at, (doc_id, own, r) in enumerate(groups[g]):
            path = siblings(trees[g], at) + siblings(top, i)
            now = own
            if doc_id is not None and r[1] is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                now = leaf(r, lower(r[1]))
            for left, right in path:
                now = digest(left + now + right)
            yield doc_id, own, trees[g][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), now, now == top[-1][0]


def write(spark, path, rows, parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{path}/documents.parquet")
    return str(path)


def documents(sizes):
    rng, rows = random.Random(3), []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(10**6), rng.choice([None, "", "Ärger UND Text", "x" * 5000, f"Word {rng.random()}"]), lang, rng.choice([None, "s"]), rng.choice([None, 3])))
    return rows + rows[:4] + [(None, None, None, None, None), (None, "A", None, None, None), (7, "A", "one", "s", 1), (7, "B", "one", "s", 1)]


@pytest.mark.parametrize("sizes", [{None: 3, "": 1, "é": 8, "a": 1100, "b": 9, "zz": 65, "one": 512}, {f"g{i}": 1 for i in range(30)}, {"only": 0}])
def test_manifest(spark, tmp_path, sizes):
    rows = documents(sizes)
    got = queries.op11_merkle_manifest(spark, write(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows), key=str)


def test_manifest_of_one_row_and_none(spark, tmp_path):
    one = queries.op11_merkle_manifest(spark, write(spark, tmp_path / "one", [(5, "Text", "a", "s", 4)])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest("")
    assert queries.op11_merkle_manifest(spark, write(spark, tmp_path / "none", [])).count() == 0


def test_manifest_with_clashing_names(spark):
    names = ["place", "size", "digest", "members", "__n", "__task", "level0", "path", "above", "g"]
    rows = spark.createDataFrame([(i, "k", *map(str, range(8))) for i in range(20)], names)
    found = merkle.manifest(rows, "place", "size", ("place", "g"), tampered=F.upper)
    assert found.columns == ["place", "leaf", "subroot", "root", "path", "folded_root"]
    assert found.count() == 20 and found.select("root").distinct().count() == 1
    assert found.where("folded_root <> root").isEmpty()  # digits have no upper case
    assert merkle.manifest(rows, "place", "size", ("place", "g"), tampered=lambda c: F.concat(c, c)).where("folded_root = root").isEmpty()


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def test_runs_against_plain_version():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            texts.append([])
            for _ in range(rng.randrange(5)):
                texts[-1] += [rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9)
        bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        got = periodic.runs_of(np.array([w for t in texts for w in t], dtype=np.int64), bounds)
        assert list(zip(*[x.tolist() for x in got])) == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_long_runs():
    for words in ([0] * 200_000, [0, 1, 2] * 60_000, list(range(50_000)) * 5):
        _, start, length, period = periodic.runs_of(np.array(words), np.array([0, len(words)]))
        assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [len(words)], [len(set(words))])


def test_registered_runs(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "É", "long-word"]) for _ in range(rng.randrange(80))) + rng.choice(["", " x y\tx y\nx y\x0bx y\x0c  x y"]), "l", "s", 1) for i in range(120)]
    rows += [(1, "a a a a a a", "l", "s", 1), (None, "b b b b b b b", "l", "s", 1), (500, None, "l", "s", 1), (501, "", "l", "s", 1), (502, " \n\t", "l", "s", 1), (503, "no split here " * 6, "l", "s", 1)]
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, write(spark, tmp_path, rows)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert got == sorted(want, key=str)
    assert any(r[1] for r in got) and queries.op13_periodic_runs(spark, write(spark, tmp_path / "none", [])).count() == 0


def test_runs_ignore_other_columns(spark):
    rows = spark.createDataFrame([("k", "go " * 7, 1, 2)], "key string, body string, id int, runs int")
    found = periodic.periodic_runs(rows, "key", "body").first()
    assert (found.key, found.n_words, [tuple(r) for r in found.runs], found.collapsed) == ("k", 7, [(0, 7, 1)], "go")
