"""The registered queries of the training-data operators over small tables, column by column, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowgraph.llm import langid, parsing, queries, textops, toxicity

EDGES = [None, "", " \n\t ", "one", "É É é İ", "x" * 3000, "a b c", "a b c", "中文 と 🙂 text", "a." * 500, "see <|endoftext|> here", "12 34 — €", "long word " * 30_000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    stems = {"aa": ["tion", "the", "ing", "er"], "bb": ["keit", "sch", "ung", "er"], "cc": ["eau", "oix", "que", "er"]}
    made, langs = [], []
    for i in range(90):
        lang = sorted(stems)[i % 3]
        own = [" ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(8)) + "." for _ in range(rng.randrange(2, 9))]
        if i % 4 == 0:
            own[1] = "you vile" + rng.choice(["ness", "st"]) + " thing."
        made.append(rng.choice([" ", "\n"]).join(own))
        langs.append(lang)
    passage = " ".join(f"p{i}" for i in range(70))
    made += [f"before\n{passage}\nafter", f"{passage}\nend", made[3], made[4] + " more", *EDGES]
    return made, langs + [None] * (len(made) - 90)


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(zip(*texts))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "p3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 p14"), (12, "One"), (2, "a b c")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def crc(value):
    return zlib.crc32(str(value).encode())


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def rows_of(spark, sf_dir, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


def test_op1(spark, sf_dir, texts):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    items = {r.item_id: cut(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = rows_of(spark, sf_dir, "op1_decontaminate")
    for i, text in enumerate(texts[0]):
        own, hit, which = cut(text), set(), set()
        for item, w in items.items():
            n = min(10, len(w))
            windows = {tuple(w[s : s + n]) for s in range(len(w) - n + 1)}
            for at in range(len(own) - n + 1):
                if tuple(own[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    which.add(str(item))
        listed = hashlib.sha256(",".join(sorted(which)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(own), len(hit), len(which), listed, bool(hit))


def test_op2(spark, sf_dir, texts):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts[0]]
    rows = queries.op2_packing(spark, sf_dir).collect()
    lengths = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert len(piece) == 4 * r.length and zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert max(lengths.values()) <= 2048 and sum(lengths.values()) == sum(map(len, ids)) == sum(r.length for r in rows)
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows) and len(lengths) <= sum(map(len, ids)) / 2040 + 1


def test_op3(spark, sf_dir, texts):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t)) + [None]
    counts = {}
    for i, t in enumerate(texts[0]):
        for w in cut(t) if crc(i) % 7 != 2 else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, r in rows_of(spark, sf_dir, "op3_lm_scoring").items():
        own = cut(texts[0][i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 7 == 2, len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own), rel=1e-11)
        assert r.score <= 0


def test_op4_and_op5(spark, sf_dir, texts):
    got = rows_of(spark, sf_dir, "op4_token_counts")
    assert all(got[i].n_pretokens == len((t or "").split()) <= got[i].n_tokens for i, t in enumerate(texts[0]))
    got = rows_of(spark, sf_dir, "op5_line_dedup")
    assert got[91].text == "end" and got[91].n_deleted == 1 and got[90].text == texts[0][90]
    assert all(got[i].text == texts[0][i] for i in range(90))


def test_op6(spark, sf_dir, texts):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = toxicity.train(docs, labels.where(queries.TOXICITY_TRAINING))

    def features(word):
        data = np.frombuffer(word, dtype=np.uint8)
        own = [int(textops.span_hashes(data, np.array([0]), np.array([len(data)]))[0])]
        for n in toxicity.STEMS:
            stem = textops.span_hashes(data, np.array([0]), np.array([min(n, len(data))]))
            own.append(int(textops.mix(stem + np.uint64(n))[0]) if len(data) >= n else 0)
        return [h >> 64 - toxicity.FEATURE_BITS for h in own]

    known = {}
    for i, r in rows_of(spark, sf_dir, "op6_toxicity").items():
        clean = 1.0
        for sentence in re.split(rb"[.!?\n]", (texts[0][i] or "").encode().lower()):
            words = re.findall(rb"[a-z\x80-\xff]+", sentence)
            if words:
                z = bias + sum(weights[f] for w in words for f in known.setdefault(w, features(w)))
                clean *= 1 - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert r.score == pytest.approx(1 - clean, abs=1e-9) and r.held_out == (crc(i) % 5 == 0) and r.predicted == int(r.score >= 0.5)
        assert i >= 90 or r.predicted == (i % 4 == 0)


def test_op7(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.where(queries.LANGUAGE_TRAINING))
    words, grams = ({int(k): row for k, row in zip(keys, logs)} for keys, logs in ((model.word_keys, model.word_logs), (model.gram_keys, model.gram_logs)))

    def logs(word):
        points = np.array([ord(c) for c in word], dtype=np.uint32)
        own = int(textops.span_hashes(points, np.array([0]), np.array([len(points)]))[0])
        if own in words:
            return words[own]
        for n in langid.GRAMS:
            found = []
            for at in range(len(points) - n + 1):
                h = np.full(1, n, dtype=np.uint64)
                for p in points[at : at + n]:
                    h = textops.mix(h + np.uint64(p))
                if int(h[0]) in grams:
                    found.append(grams[int(h[0])])
            if found:
                return sum(found) / len(found)
        return np.zeros(len(model.languages))

    known = {}
    for i, r in rows_of(spark, sf_dir, "op7_language_id").items():
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in texts[0][i] or "")
        runs = "".join(c if c.isalpha() else " " for c in low).split()
        assert r.held_out == (crc(i) % 4 == 2)
        if not runs:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        sums = sum(known[w] if w in known else known.setdefault(w, logs(w)) for w in runs)
        best = int(np.argmax(sums))
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(1 / np.exp(sums - sums[best]).sum(), abs=1e-6)
        assert i >= 90 or r.lang_pred == texts[1][i]


def test_equal_languages_go_to_the_first_and_each_language_has_its_share(spark):
    docs = spark.createDataFrame([(1, "same words", "bb"), (2, "same words", "aa"), (3, "other things here now", "cc")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert told[1][0] == told[2][0] == "aa" and told[1][1] == told[2][1] <= 0.5
    many = [(i, " ".join(f"{chr(97 + j // 26)}{chr(97 + j % 26)}aa" for j in range(200)), "big") for i in range(20)] + [(50 + i, "rareword rareword", "tiny") for i in range(2)]
    model = langid.train(spark.createDataFrame(many, "doc_id long, text string, lang string"), max_words=20)
    known = {int(k) for k in model.word_keys}
    points = np.array([ord(c) for c in "rareword"], dtype=np.uint32)
    assert len(known) == 11 and int(textops.span_hashes(points, np.array([0]), np.array([8]))[0]) in known


def test_op8(spark, sf_dir, texts):
    plain, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = rows_of(spark, sf_dir, "op8_token_file")
    for i, t in enumerate(texts[0]):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op9(spark, sf_dir, texts):
    import xxhash

    fps = []
    for t in texts[0]:
        own = ascii_lower(t).encode().split()
        own = re.findall(rb"[^\x20\x09-\x0D]+", ascii_lower(t).encode())
        grams = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([b" ".join(own)] if own else [])
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if grams else np.zeros((0, 64))
        fps.append(sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(grams)))
    group = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = rows_of(spark, sf_dir, "op9_simhash")
    assert all((got[i].fingerprint, got[i].component_id) == (f"{fp:016x}", group[i]) for i, fp in enumerate(fps))


def plain_fingerprint(text):
    """One text at a time and one symbol at a time; only the hashes are shared."""
    name = lambda symbols: int(textops.span_hashes(np.array(symbols, dtype=np.uint64), np.array([0]), np.array([len(symbols)]))[0])
    scatter = lambda x: int(textops.mix(np.array([x & (1 << 64) - 1], dtype=np.uint64))[0])
    symbols, level, found, top = list(text.encode("utf-8", "surrogatepass")), 0, set(), 0
    while symbols:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        symbols = [s if n == 1 else scatter(s * 0x9E3779B97F4A7C15 + n) for s, n in runs]
        labels = symbols
        for _ in range(4):
            tossed = []
            for at, s in enumerate(labels):
                differ = s ^ (labels[at - 1] if at else s ^ 1)
                low = (differ & -differ).bit_length() - 1
                tossed.append(2 * low + (s >> low & 1))
            labels = tossed
        begin = [at for at in range(len(symbols)) if at == 0 or (at + 1 < len(symbols) and labels[at - 1] < labels[at] > labels[at + 1])]
        symbols = [name(symbols[a:b]) for a, b in zip(begin, [*begin[1:], len(symbols)])]
        level += 1
        if level >= parsing.LEVEL:
            found |= {scatter(s + level) for s in symbols}
        if len(symbols) == 1:
            top = scatter(symbols[0] + (level << 8))
            break
    values = sorted({v >> 32 for v in found | ({top} if top else set())})
    return f"{top:016x}" + "".join(f"{v:08x}" for v in values[: parsing.SKETCH])


def test_op10(spark, sf_dir, texts):
    got, n = rows_of(spark, sf_dir, "op10_fingerprints"), len(texts[0])
    for i, t in enumerate(texts[0]):
        own, nxt = t or "", texts[0][i - 1 if i else n - 1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(own) < 5000 and len(edited) < 5000:
            assert got[i].fingerprint == plain_fingerprint(own) and got[i].edited_fingerprint == plain_fingerprint(edited)
        assert got[i].near_edited == parsing.likeness(got[i].fingerprint, got[i].edited_fingerprint)
        assert got[i].near_next == parsing.likeness(got[i].fingerprint, got[i - 1 if i else n - 1].fingerprint)
