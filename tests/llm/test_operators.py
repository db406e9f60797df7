"""The operators of the training-data pipeline against brute force, round trips and held-out labels, with edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowgraph.llm import decontaminate, langid, linededup, packing, parsing, pitmanyor, rans, simhash, tokencount, tokenfile, toxicity
from flowgraph.llm.components import connected_components
from flowgraph.llm.tokens import Encoder, encoder

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, fp long, id string"


def docs_of(spark, texts, parts=3):
    rows = [(i, t, None, None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def words(n, seed, kinds=50):
    rng = random.Random(seed)
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


EDGES = [None, "", " \n\t ", "one", "É É é", "x" * 3000, "a b c", "a b c", "中文 と 🙂 text", "a." * 500]


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_decontamination_is_brute_force(spark):
    item = words(25, 1)
    texts = [" ".join(words(30, 2) + item[3:18] + words(20, 3)), " ".join(item).upper(), " ".join(item[:9]), "tiny item", *EDGES]
    items = spark.createDataFrame([(7, " ".join(item)), (8, "Tiny, item!"), (9, ""), (10, None), (11, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, texts), items).collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    for i, text in enumerate(texts):
        own, hit, which = cut(text), set(), set()
        for r in items.collect():
            w = cut(r.text)
            n = min(10, len(w))
            for s in range(len(w) - n + 1) if n else []:
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[s : s + n]:
                        hit |= set(range(at, at + n))
                        which.add(str(r.item_id))
        assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == (len(own), len(hit), sorted(which)), text
    assert decontaminate.contamination(docs_of(spark, texts), items.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs_of(spark, texts).where("false"), items).count() == 0
    shuffled = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs_of(spark, texts), items, broadcast_bytes=0).collect()}
    assert shuffled == {i: r.n_hit for i, r in got.items()}


@pytest.mark.parametrize("path, spaces", [(BYTE_BPE, True), (WORD_BPE, False)])
def test_encoder_is_the_tokenizer(path, spaces):
    rng = random.Random(9)
    parts = ["a", "B", "é", "é", " ", " ", "  ", "\n", "\t", "\x1c", "　", "'s", "12", "<|endoftext|>", "!", "ΑΣ", "中", "🙂", "\xa0", "the", "İ", "\r\n", "\x85", ".", "...", " ,", "a."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(3000)]
    encoder = Encoder(path, spaces)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path, spaces", [(BYTE_BPE, True), (WORD_BPE, False)])
def test_added_tokens_are_the_tokenizers(spark, path, spaces):
    rng = random.Random(10)
    parts = ["a", "B", " ", "  ", "\n", "12", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "the", ".", "é", "\x1f"]
    texts = ["see <|endoftext|> here", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000))]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder(path, spaces).encode(texts)] == want
    if not spaces:
        rows = packing.pack(docs_of(spark, texts[:1]), path).collect()
        assert np.frombuffer(rows[0]["ids"], "<u4").tolist()[: len(want[0])] == want[0]


def test_packing_keeps_every_id(spark):
    texts = [" ".join(words(n, n)) for n in (1, 5, 900, 40, 3000, 700, 333, 20, 2500)] + EDGES
    rows = packing.pack(docs_of(spark, texts), WORD_BPE, size=64, windows=3, merge=2).collect()
    plain = Tokenizer.from_file(WORD_BPE)
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    for i, own in enumerate(ids):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum((np.frombuffer(r["ids"], "<u4").tolist() for r in mine), []) == own
        assert all(r.doc_tokens == len(own) for r in mine)
    lengths = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert max(lengths.values()) <= 64 and sum(n < 60 for n in lengths.values()) <= 1
    assert packing.pack(docs_of(spark, texts).where("false"), WORD_BPE).count() == 0


def test_language_model_beats_unigrams(spark):
    rng = random.Random(2)
    text = lambda: " ".join(x for _ in range(60) for x in rng.choice([("the", "cat"), ("a", "dog"), ("le", "chat"), ("le", "chien")]))
    texts = [text() for _ in range(60)] + EDGES
    rows = pitmanyor.score(docs_of(spark, texts), "doc_id % 3 <> 0").collect()
    assert len(rows) == len(texts)
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t)) + [None]
    counts = {}
    for i, t in enumerate(texts):
        for w in cut(t) if i % 3 else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = cut(texts[r.doc_id])
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id % 3 != 0, len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own), rel=1e-12)
    held = [r for r in rows if not r.train and r.doc_id < 60]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitmanyor.score(docs_of(spark, texts), "false").where("score = 0 and n_known = 0").count() == len(texts)  # one kind, the unknown
    assert pitmanyor.score(docs_of(spark, texts).where("false"), "true").count() == 0


def test_no_bucket_holds_all_occurrences_of_a_word(spark, monkeypatch):
    tables = {}
    keep = pitmanyor.materialize
    monkeypatch.setattr(pitmanyor, "materialize", lambda df, name: tables.setdefault(name, keep(df, name)))
    rows = pitmanyor.score(docs_of(spark, ["hot " * 20_000 + f"w{i}" for i in range(4)], parts=1), "doc_id < 3").collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in rows) == [*((i, 20_002, 20_002) for i in range(3)), (3, 20_002, 20_001)]
    binary = [c for c, kind in tables["buckets"].dtypes if kind == "binary"]
    largest = tables["buckets"].select(F.greatest(*(F.coalesce(F.octet_length(c), F.lit(0)) for c in binary))).collect()
    assert max(n for n, in largest) < 1000  # not the 80,000 occurrences


def test_context_words_are_counted_whole(spark):
    texts = [" ".join(f"p{part}n{i}" for i in range(600)) + " " for part in range(4)]
    rows = [(text * 3 + "common " * 2, True) for text in texts]  # in no part among the first 512
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "text string, train boolean")
    common = pitmanyor._tokens(pa.array(["common"]))[0][0]
    assert pitmanyor.context_words(docs)[0] == common  # eight times, others three


def test_scores_do_not_hang_on_partitions_or_buckets(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the cat", "a dog", "the dog", f"rare{rng.randrange(40)}"]) for _ in range(40)) for _ in range(40)]
    one = {r.doc_id: r.score for r in pitmanyor.score(docs_of(spark, texts, parts=1), "doc_id % 3 <> 0").collect()}
    monkeypatch.setattr(pitmanyor.np, "log2", lambda x: 5.0)  # 32 buckets instead of 8
    many = {r.doc_id: r.score for r in pitmanyor.score(docs_of(spark, texts, parts=5), "doc_id % 3 <> 0").collect()}
    assert one == pytest.approx(many, rel=1e-12)


def all_seatings(customers, room, weight, discount):
    """The probability of each number of tables, from all ways to seat customers one by one."""
    chance = {}

    def seat(sizes, left, w):
        if not left:
            chance[len(sizes)] = chance.get(len(sizes), 0) + w
            return
        for i, n in enumerate(sizes):
            seat([*sizes[:i], n + 1, *sizes[i + 1 :]], left - 1, w * (n - discount))
        seat([*sizes, 1], left - 1, w * (room + discount * len(sizes)) * weight)

    seat([], customers, 1.0)
    return {t: w / sum(chance.values()) for t, w in chance.items()}


def test_tables_are_drawn_from_all_seatings():
    keys, n = np.arange(1, 40_001, dtype=np.uint64), 40_000
    for customers, room, weight, discount in ((2, 1.0, 0.3, 0.5), (5, 40.0, 0.1, 0.8), (7, 3.0, 0.9, 0.2)):
        got = pitmanyor.draw_tables(np.full(n, customers), np.full(n, room), np.full(n, weight), discount, keys, 7)
        for t, p in all_seatings(customers, room, weight, discount).items():
            assert np.mean(got == t) == pytest.approx(p, abs=0.012)
    many = pitmanyor.draw_tables(np.array([0, 1, 1024, 1025, 100_000]), np.full(5, 2.0), np.full(5, 0.01), 0.5, keys[:5], 1)
    assert many[0] == 0 and many[1] == 1 and (many[2:] >= 1).all() and many[4] < 2000


def test_seating_is_a_distribution():
    keys = np.array([(w << 12) | c for w in range(1, 6) for c in (0, 2, 3)], dtype=np.uint64)  # nothing before, word 1 before, and directly
    trains = np.array([3, 0, 4, 1, 2, 0, 100, 7, 30, 1, 1, 1, 0, 5, 0])
    leaf, direct = np.zeros(2048), np.zeros(2048)
    leaf[1], direct[0], direct[1] = trains[2::3].sum(), trains[0::3].sum(), trains[1::3].sum()
    model = pitmanyor.Model(trains.sum(), 5, (0.4, 0.5, 0.6), leaf, np.zeros(2048), direct, np.zeros(2048), 0)
    seating = pitmanyor.Seating(keys, trains, model, 1)
    m = seating.model
    for _ in range(3):  # totals that fit the seats
        tables = seating.totals()
        m.leaf_tables, m.mid_tables, m.root_tables = tables[:2048], tables[2048:-1], tables[-1]
        p = seating.predictive()
        unknown = (m.strength[2] + m.discount[2] * m.root_tables) / (m.v + 1) / (m.strength[2] + m.root_customers)
        for f in (0, 1):
            rest = (m.strength[1] + m.discount[1] * m.mid_tables[f]) * unknown / (m.strength[1] + m.mid_customers[f])
            assert p[f::3].sum() + rest == pytest.approx(1)
        rest *= (m.strength[0] + m.discount[0] * m.leaf_tables[1]) / (m.strength[0] + leaf[1])
        assert p[2::3].sum() + rest == pytest.approx(1)
        seating.sweep()
    c = trains[2::3]
    assert (seating.t_leaf <= c).all() and (seating.t_leaf >= (c > 0)).all() and (seating.t_mid <= seating.customers()).all() and (seating.t_root <= seating.root_c).all()


def test_token_counts_are_the_best_segmentation(spark):
    scores = tokencount.piece_scores(PIECES)
    trie = tokencount.PreTokenTrie(scores)

    def best(word):
        top = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(top[end - 1][0] + n * trie.byte, top[end - 1][1] - n)]
            options += [(top[s][0] + scores[word[s:end]], top[s][1] - 1) for s in range(end) if word[s:end] in scores]
            top[end] = max(options)
        return top[-1][0], -top[-1][1]

    texts = ["the quick browner fox the foxes", "Straße 中文🙂 unbelievable unbelievably", *EDGES]
    got = {r.doc_id: r for r in tokencount.count_tokens(docs_of(spark, texts), PIECES).collect()}
    for i, text in enumerate(texts):
        parts = [best("▁" + w) for w in (text or "").split()]
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(parts), sum(c for _, c in parts))
        assert got[i].score == pytest.approx(sum(s for s, _ in parts))


def test_line_dedup(spark):
    passage = " ".join(words(30, 5)) + "\n" + " ".join(words(30, 6))
    texts = [f"own a\n{passage}\nown b", f"other\n\n{passage}\n\nend", passage.split("\n")[0] + "\nx", " ".join(words(55, 7)), " ".join(words(55, 7)), f"{passage}\n{passage}", *EDGES]
    got = {r.doc_id: r for r in linededup.delete_repeated_runs(docs_of(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].text == "other\n\nend" and got[1].n_deleted == 2
    assert got[2].text == texts[2] and got[3].n_deleted == 0 and got[4].text == "" and got[5].n_deleted == 4
    assert [got[i].text for i in range(6, len(texts))] == texts[6:]
    assert got[0].lang is None and got[0].id == "x"
    rng = random.Random(3)
    pool = [" ".join(words(rng.randrange(1, 20), 100 + i)) for i in range(12)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    got = {r.doc_id: r.text for r in linededup.delete_repeated_runs(docs_of(spark, texts), min_words=15).collect()}
    first = {}
    for i, t in enumerate(texts):
        for j, line in enumerate(t.split("\n")):
            first.setdefault(line, (i, j))
    kept = {line for t in got.values() for line in t.split("\n")}
    assert set(first) <= kept  # nothing is lost
    assert linededup.delete_repeated_runs(docs_of(spark, texts).where("false")).count() == 0


def brute_line_dedup(texts, min_words):
    """Every run of lines that also starts at an earlier place, compared place by place."""
    lines = [[x.strip() for x in (t or "").split("\n") if x.strip()] for t in texts]
    places = [(i, at) for i in range(len(lines)) for at in range(len(lines[i]))]
    gone = [set() for _ in lines]
    for i, at in places:
        for j, before in places:
            if (j, before) >= (i, at):
                break
            n = 0
            while at + n < len(lines[i]) and before + n < len(lines[j]) and lines[i][at + n] == lines[j][before + n]:
                n += 1
            if sum(len(x.split()) for x in lines[i][at : at + n]) >= min_words:
                gone[i] |= set(range(at, at + n))
    return [len(g) for g in gone]


def test_line_dedup_finds_every_repeated_run(spark):
    common = [" ".join(words(10, 900 + i, 500)) for i in range(8)]
    texts = ["\n".join(f"{own}\n{line}" for line, own in zip(common, (" ".join(words(45, 70 + i, 500)) for i in range(8))))]
    for i, line in enumerate(common):  # a passage around a line that stands earlier among other lines, twice
        passage = "\n".join([" ".join(words(25, 300 + i, 500)), line, " ".join(words(25, 400 + i, 500))])
        texts += [f"first {i}\n{passage}", f"second {i}\n{passage}"]
    got = {r.doc_id: r for r in linededup.delete_repeated_runs(docs_of(spark, texts)).collect()}
    assert [got[i].n_deleted for i in range(len(texts))] == brute_line_dedup(texts, 50) == [0] + [0, 3] * len(common)
    rng = random.Random(8)
    pool = [" ".join(words(rng.choice([1, 2, 5, 9]), 500 + i)) for i in range(9)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    for min_words in (4, 12, 15):
        got = {r.doc_id: r for r in linededup.delete_repeated_runs(docs_of(spark, texts), min_words=min_words).collect()}
        assert [got[i].n_deleted for i in range(len(texts))] == brute_line_dedup(texts, min_words)


def test_toxicity_learns_words_and_finds_sentences(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(300):
        own = [" ".join(f"w{rng.randrange(200)}" for _ in range(8)) + "." for _ in range(5)]
        toxic = i % 4 == 0
        if toxic:
            own[2] = "you vile" + rng.choice(["ness", "st", "r"]) + " thing."
        texts.append(" ".join(own))
        labels.append((i, int(toxic)))
    docs = docs_of(spark, texts + EDGES)
    table = spark.createDataFrame([*labels, (900, 1), (0, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, table.where("doc_id < 200"))).collect()
    assert len(rows) == len(texts) + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if 200 <= r.doc_id < 300]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    spot = next(r for r in held if r.doc_id % 4 == 0)
    assert "you vile" in texts[spot.doc_id].encode()[spot.sentences[0].start : spot.sentences[0].end].decode()
    assert toxicity.score(docs, toxicity.train(docs, table.where("false"))).count() == len(rows)


def test_language_id(spark):
    rng = random.Random(5)
    stems = {"aa": ["tion", "the", "ing"], "bb": ["keit", "sch", "ung"], "cc": ["eau", "oix", "que"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang, None, "x") for i, lang in enumerate(sorted(stems) * 40)]
    docs = spark.createDataFrame(rows + [(500 + i, t, None, None, "x") for i, t in enumerate([*EDGES, "123 — €"])], SCHEMA)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs.where("doc_id % 2 = 0"))).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _, _ in rows)
    assert {got[500 + i].lang_pred for i in (0, 1, 2, len(EDGES))} == {"und"} and got[500].score == 0
    assert langid.keep_identified(docs, langid.train(docs)).where("doc_id < 500").count() == len(rows)
    nothing = langid.predict(docs, langid.train(docs.where("false")))
    assert nothing.where("lang_pred <> 'und' or score <> 0").count() == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 300, 50257):
        counts = (1e6 / (np.arange(kinds) + 1)).astype(np.int64) + 1
        table = rans.Table.of(np.arange(kinds), rans.quantized(counts))
        assert table.freq.sum() == 1 << rans.SCALE and table.freq.min() > 0
        blocks = [rng.choice(kinds, size=n, p=counts / counts.sum()).astype(np.uint32) for n in (rans.BLOCK, 1, 31, 33, 16385)]
        coded = rans.encode(blocks, table)
        assert all((a == b).all() for a, b in zip(blocks, rans.decode(coded, table)))
    coded[0]["payload"] = coded[0]["payload"][:40] + bytes([coded[0]["payload"][40] ^ 1]) + coded[0]["payload"][41:]
    with pytest.raises(ValueError):
        rans.decode(coded, table)


def test_token_file_round_trip(spark, tmp_path):
    texts = [*EDGES, *[" ".join(words(40, i)) for i in range(20)], " ".join(words(40000, 1))]
    tokenfile.write_token_file(docs_of(spark, texts), f"file://{tmp_path}/f", BYTE_BPE)
    plain = Tokenizer.from_file(BYTE_BPE)
    pieces = sorted(tokenfile.read_token_file(spark, f"file://{tmp_path}/f").collect(), key=lambda r: (r.doc_id, r.offset))
    start = 0
    for i, text in enumerate(texts):
        mine = [r for r in pieces if r.doc_id == i]
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert sum((np.frombuffer(r["ids"], "<u4").tolist() for r in mine), []) == ids
        assert {r.start for r in mine} == {start} and {r["size"] for r in mine} == {len(ids)}
        start += len(ids)


def brute_fingerprint(text):
    import xxhash

    own = (text or "").encode().lower().split()
    grams = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([b" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_are_brute_force(spark):
    base = words(200, 8, 10_000)
    texts = [" ".join(base), " ".join(base), " ".join([*base, "more"]), " ".join(words(50, 9)), *EDGES]
    got = {r.doc_id: r for r in simhash.near_duplicate_groups(docs_of(spark, texts), shard_rows=2).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    for i in range(len(texts)):
        assert got[i].fp & (1 << 64) - 1 == fps[i] and got[i].component_id == group[i], texts[i]
    rng = random.Random(6)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(3)]
    values = sorted(set(values))
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, rep long")
    found = {r.node: r.component for r in connected_components(simhash.near_links(rows, shard_rows=5)).collect()}
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert {i: found.get(i, i) for i in range(len(values))} == dict(enumerate(label))
    assert simhash.near_duplicate_groups(docs_of(spark, texts).where("false")).count() == 0


def shingles(text, k=5):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def test_near_copies_of_similarity_four_fifths_are_found(spark):
    rng = random.Random(13)
    texts, pairs = [], []
    for i in range(150):
        base = [f"v{rng.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for at in rng.sample(range(300), rng.randrange(1, 7)):
                copy[at] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    texts += EDGES
    got = {r.doc_id: r.component_id for r in simhash.near_copy_groups(docs_of(spark, texts)).collect()}
    for i in range(0, 450, 3):
        for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2)):
            x, y = shingles(texts[a]), shingles(texts[b])
            if len(x & y) >= 0.8 * len(x | y):
                pairs.append(got[a] == got[b])
    assert len(pairs) > 200 and np.mean(pairs) >= 0.95
    assert all(got[i] // 3 == i // 3 for i in range(450))  # no others
    assert got[450] == got[451] == got[452] == 450 and got[456] == got[457] == 456 and got[458] == 458
    assert simhash.near_copy_groups(docs_of(spark, texts).where("false")).count() == 0


def test_a_large_group_is_cut_into_parts_and_loses_no_link(spark):
    rng = random.Random(14)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}  # one tight group
    chain = [rng.getrandbits(64)]
    for _ in range(60):  # and a long one
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(values | set(chain) | {rng.getrandbits(64) for _ in range(100)})
    rows = [(v.to_bytes(8, "big"), i, 0, 0) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "fp binary, rep long, choice int, bits long")
    label = simhash.linked(np.array(values, dtype=np.uint64)[:, None], 3)
    slow = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3 and slow[i] != slow[j]:
                low, high = sorted((slow[i], slow[j]))
                slow = [low if x == high else x for x in slow]
    assert label.tolist() == slow
    for shard_rows, pivots in ((1000, 64), (60, 64), (60, 4), (60, 0)):
        found = {r.node: r.component for r in connected_components(simhash.shard_links(table, ["choice", "bits"], 3, shard_rows, pivots)).collect()}
        assert [found.get(i, i) for i in range(len(values))] == slow


def test_parsing_is_local_and_reports_edits(spark):
    rng = random.Random(7)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    a, b, c = parsing.fingerprints([f"prefix {shared}", f"{shared}xyz", other])
    assert parsing.likeness(a, b) > 0.7 and parsing.likeness(a, c) < 0.1
    texts = [shared, other, *EDGES, "aaaa" * 400, shared]
    for parts in (1, 3, 40):
        rows = {r.doc_id: r for r in parsing.edit_report(docs_of(spark, texts), parts=parts).collect()}
        assert len(rows) == len(texts)
        for i, text in enumerate(texts):
            own, nxt = text or "", texts[i - 1] or ""
            half = len(own) // 2
            assert rows[i].n_chars == len(own)
            assert rows[i].edited_sha256 == hashlib.sha256((own[: len(own) - half] + nxt[:half]).encode()).hexdigest()
            assert rows[i].fingerprint == parsing.fingerprints([own])[0]
            assert rows[i].near_next == parsing.likeness(rows[i].fingerprint, parsing.fingerprints([nxt])[0])
    assert rows[0].fingerprint == rows[len(texts) - 1].fingerprint
    single = parsing.edit_report(docs_of(spark, ["alone in here"])).first()
    assert single.near_next == 1.0
    assert parsing.edit_report(docs_of(spark, texts).where("false")).count() == 0


def test_training_marks_agree_with_crc32(spark):
    got = spark.range(50).select("id", F.expr("crc32(cast(id as string))").alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(words(60, 21, 3000))
    item = " ".join(words(30, 22, 3000))
    english = lambda seed: " ".join(words(120, seed, 3000))
    texts = [english(1), english(1), f"{english(2)}\n{passage}", f"{english(3)}\n{passage}", f"{english(4)} {item}", None, "123 456", *[english(s) for s in range(30, 50)]]
    rows = [(i, t, "en" if t else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "line_dedup":
            assert docs.where("doc_id = 3").first().text == english(3)
    clean = {0, 2, 3, *range(7, len(texts))}
    assert kept[0] == clean | {1, 4} and kept[1] == clean | {4} and kept[2] == clean | {4} and kept[3] == kept[4] == clean


def test_large_ids_stay_next_to_null_ones(spark):
    ids = [None, (1 << 60) + 1, (1 << 53) + 1, -(1 << 62) + 1]
    docs = spark.createDataFrame([(i, f"text number {n} of some", "aa") for n, i in enumerate(ids)], "doc_id long, text string, lang string").repartition(1)
    same = lambda df: {r.doc_id for r in df.select("doc_id").collect()} == set(ids)
    assert same(packing.pack(docs, WORD_BPE)) and same(pitmanyor.score(docs, "true")) and same(tokencount.count_tokens(docs, PIECES))
    assert same(linededup.delete_repeated_runs(docs)) and same(simhash.near_duplicate_groups(docs)) and same(parsing.edit_report(docs, parts=2))
    assert same(decontaminate.contamination(docs, spark.createDataFrame([(1, "text number")], "item_id long, text string")))
    assert same(langid.predict(docs, langid.train(docs)))


def test_an_item_of_many_rows_is_listed_once_and_an_empty_benchmark_hits_nothing(spark):
    docs = docs_of(spark, ["one two three four", "other words", None])
    items = spark.createDataFrame([(i, "two three") for i in (3, 12, 3)] + [(5, "three four")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {0: (3, ["12", "3", "5"]), 1: (0, []), 2: (0, [])}
    assert decontaminate.drop_contaminated(docs, items.where("false")).count() == 3


def test_null_ids_and_repeated_rows_stay(spark):
    rows = [(None, "some text here. and more of it", None, None, "x"), (None, None, None, None, None), (5, "twice the same", "aa", 1, "x"), (5, "twice the same", "aa", 1, "x"), (3, "", "bb", None, "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    items = spark.createDataFrame([(None, "twice the same"), (1, None)], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert set(found) == {None, 5, 3} and found[5].n_hit == 3 and list(found[5]["items"]) == []
    assert decontaminate.drop_contaminated(docs, items).count() == 3
    assert packing.pack(docs, WORD_BPE).where("start = 0").count() == 5
    assert pitmanyor.score(docs, "doc_id = 5").count() == 5
    assert tokencount.count_tokens(docs, PIECES).count() == 5
    assert linededup.delete_repeated_runs(docs).count() == 5
    labels = spark.createDataFrame([(5, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 5
    assert langid.predict(docs, langid.train(docs)).count() == 5
    groups = simhash.near_duplicate_groups(docs).collect()
    assert len(groups) == 5 and all(r.component_id == 5 for r in groups if r.doc_id == 5)
    assert simhash.keep_one_per_group(docs).count() == 5
    assert parsing.edit_report(docs, parts=3).count() == 5
    path = f"file:///tmp/spark-tokens-{random.randrange(1 << 60)}"
    tokenfile.write_token_file(docs, path, BYTE_BPE)
    assert tokenfile.read_token_file(spark, path).count() == 5
