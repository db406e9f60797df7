"""The registered queries of this subpackage, one for each operator, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.llm import decontaminate, langid, linededup, merkle, minhash, packing, parsing, periodic, pitmanyor, simhash, tokencount, tokenfile, toxicity
from flowgraph.llm.storage import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside all documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words of a text for DuckDB: A-Z lower-cased, then runs of digits, letters and non-ASCII characters.
_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: Rows that language identification may learn from.
LANGUAGE_TRAINING = "crc32(cast(doc_id as string)) % 4 <> 2"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_pieces(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packed_pieces(table(spark, sf_dir, "documents"))


#: Rows that language-model scoring may learn from.
SCORING_TRAINING = "crc32(cast(doc_id as string)) % 7 <> 2"


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    scored = pitmanyor.score(table(spark, sf_dir, "documents"), SCORING_TRAINING)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of lines that stand earlier."""
    cut = linededup.delete_repeated_runs(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_deleted", "text")


#: Rows that toxicity may learn from.
TOXICITY_TRAINING = "crc32(cast(doc_id as string)) % 5 <> 0"


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(TOXICITY_TRAINING))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (~F.expr(TOXICITY_TRAINING)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = table(spark, sf_dir, "documents")
    told = langid.predict(docs, langid.train(docs.where(LANGUAGE_TRAINING)))
    return told.select("doc_id", (~F.expr(LANGUAGE_TRAINING)).alias("held_out"), "lang_pred", "score")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to a token file in the shared folder and read back."""
    path = scratch_path(spark, "tokens")
    tokenfile.write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    rows = tokenfile.read_token_file(spark, path, whole_ids=False)
    whole = F.col("n") == F.col("size")
    rows = rows.select("doc_id", "start", "size", F.when(whole, F.col("crc")).alias("crc"), F.when(~whole, F.struct("offset", "ids")).alias("part"))
    docs = rows.groupBy("doc_id", "start", "size").agg(F.max("crc").alias("crc"), F.array_sort(F.collect_list("part")).alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return docs.select("doc_id", "start", F.col("size").alias("n_tokens"), F.coalesce("crc", F.crc32(joined)).alias("ids_crc32"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return parsing.edit_report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def ascii_lower(text) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with every third one's text tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered=ascii_lower, where=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by two-word shingles."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP12_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w] ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS g FROM d WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


#: CRC-32 of a text of ASCII characters for DuckDB, bit by bit.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT for i in range(8)]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""


def _sql_leaf(text: str) -> str:
    parts = (f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


OP11_SQL = f"""
WITH RECURSIVE
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT lang FROM documents)),
hashed AS (
  SELECT doc_id, lang, {_sql_leaf('text')} AS leaf, CASE WHEN {_SQL_CRC.format(x="CAST(doc_id AS VARCHAR)")} % 3 = 0
    THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents
),
leaves AS (
  SELECT doc_id, leaf, coalesce(changed, leaf) AS first, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n
  FROM hashed JOIN langs ON hashed.lang IS NOT DISTINCT FROM langs.lang
),
low AS (
  SELECT t, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT t, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY t, lvl, n, pos // 8
),
high AS (
  SELECT 0 AS lvl, t AS pos, h, (SELECT count(*) FROM langs) AS n FROM low WHERE n = 1
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, n, pos // 8
),
nodes AS (SELECT t, lvl, pos, h FROM low WHERE n > 1 UNION ALL SELECT -1, lvl, pos, h FROM high WHERE n > 1),
sib AS (
  SELECT t, lvl, pos, coalesce(string_agg(h, '') OVER (PARTITION BY t, lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY t, lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes
),
steps AS (
  SELECT a.t, a.pos, s.lvl AS step, s.l, s.r FROM leaves a JOIN sib s ON s.t = a.t AND s.pos = a.pos >> (3 * s.lvl)
  UNION ALL
  SELECT a.t, a.pos, 1000 + s.lvl, s.l, s.r FROM leaves a JOIN sib s ON s.t = -1 AND s.pos = a.t >> (3 * s.lvl)
),
paths AS (SELECT t, pos, list(l || '|' || r ORDER BY step) AS path, string_agg(l || r, '' ORDER BY step) AS all_ FROM steps GROUP BY t, pos),
roots AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, u.h AS subroot, root, sha256(coalesce(all_, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (
  SELECT doc_id, leaf, t, all_, list_reduce(list_prepend(first, coalesce(path, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM leaves LEFT JOIN paths USING (t, pos)
) AS folded JOIN low u ON u.t = folded.t AND u.n = 1 CROSS JOIN roots
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document's words, by a hash of its id, repeat with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    told = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    told = told.withColumn("n", F.size("words").cast("long"))
    told = told.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    told = told.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return told.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents."""
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.expr("(1000 * best.length) div (-best.less)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_packing": op2_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_token_file": op8_token_file,
    "op9_simhash": op9_simhash,
    "op10_fingerprints": op10_fingerprints,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_minhash": op12_minhash,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_minhash": OP12_SQL,
}
