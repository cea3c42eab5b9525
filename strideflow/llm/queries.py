"""The registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_fsm, chosen_path, language_id, packing, phrases, quality_knn, secret_scan, spelling, suffix_dedup, suffix_tree, token_rollup, tree_dedup, winnow
from .common import read, shared_dir, stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; held-out rows are never learned from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_knn.score(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside a 10-word window of a benchmark item."""
    out = winnow.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after four batches: inserts with guessed
    counts, their revision, deletes (sent twice), the deleted ones again."""
    rows = stage(token_rollup.counted(read(spark, sf_dir, "documents"), TOKENIZER, "byte_bpe_50k"), "counts")
    guessed = rows.withColumn("tokens", F.ceil(F.col("characters") / 4))
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/llm-rollups/{uuid.uuid4().hex}")
    rollup.commit("1-documents", token_rollup.inserts(guessed))
    rollup.commit("2-counts", token_rollup.revisions(guessed, rows))
    for _ in range(2):  # the second commit of a batch changes nothing
        rollup.commit("3-deleted", token_rollup.deletes(some))
    rollup.commit("4-again", token_rollup.inserts(some))
    return rollup.totals()


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles,
    Jaccard similarity of 0.8 or more."""
    return chosen_path.similar_classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; the text model is counted over all documents."""
    return language_id.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each group of equal texts stays."""
    return tree_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


#: the conversation that op9 adds: its texts hold the template's own marks
MARKED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of turns and loss text, read back from the formatted output."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED, "conv_id long, turn long, role string, text string")
    out = chat_fsm.format_conversations(turns.unionByName(marked))
    again = out.withColumn("t", chat_fsm.read_turns(F.col("formatted"))).withColumn("masked", chat_fsm.loss_text(F.col("segments")))
    flat = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return again.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left without 50-byte strings that also start
    in a document with a smaller id."""
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left without 20-word sequences that also
    start earlier."""
    out = suffix_tree.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


def slipped(rows: DataFrame) -> DataFrame:
    """The contract's typing errors: where 199 divides h, the CRC-32 of
    ``<doc_id>:<word>``, the word loses its code point h % length."""
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "word"))
    at = (h % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return rows.select(F.when(h % 199 == 0, cut).otherwise(F.col("word")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word of all documents."""
    rows = slipped(spelling.runs(read(spark, sf_dir, "documents")))
    return spelling.variants(spelling.vocabulary(rows))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_knn, op2_winnowing, op3_token_rollup, op4_best_fit_packing, op5_chosen_path, op6_language_id, op7_secret_scan, op8_exact_dedup, op9_chat_format, op10_suffix_dedup, op11_suffix_tree, op12_spelling_variants, op13_phrase_mining)}

_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = {
    "op2_winnowing": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, n, gram FROM (
  SELECT item, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0) x,
  LATERAL (SELECT array_to_string(x.w[x.p:x.p + x.n - 1], ' ') AS gram)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram FROM (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item, dw.n AS n, p FROM dw JOIN iw ON dw.n = iw.n AND dw.gram = iw.gram),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d""",
    "op9_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
s AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS esc,
  CASE role WHEN 'user' THEN 10 WHEN 'system' THEN 12 WHEN 'assistant' THEN 15 END AS head,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(head + length(esc) + 8) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant'
    WHEN prev = 'assistant' THEN role = 'user' ELSE false END) AND bool_and(next IS NOT NULL OR role = 'assistant') AS valid
FROM s GROUP BY conv_id""",
    "op11_suffix_tree": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM late),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n, count(*) FILTER (first) AS spans FROM (
  SELECT doc_id, lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM i - 1 AS first FROM gone) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
    "op13_phrase_mining": r"""
WITH p AS (SELECT lang, row_number() OVER () AS id, piece FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM (
  SELECT lang, a, w, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c WHERE k > 2)) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
}
