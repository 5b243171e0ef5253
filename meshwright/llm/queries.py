"""Queries of the operators over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import chat, chroma, decontam, hpylm, interleave, langid, minhash, pieces, pii, token_store
from meshwright.llm.common import fold_of, materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


#: A-Z in lower case, as the contracts of words and shingles say.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TREES_SQL = """
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, role, coalesce(role, '') AS r, coalesce(text, '') AS x, text FROM said),
sized AS (
  SELECT *, length(x) + list_sum([(length(x) - length(replace(x, p, ''))) // length(p)
    FOR p IN ['␛', '<s>', '</s>', '<<SYS>>', '<</SYS>>', '<<TURN ', '<</TURN>>', '[INST]', '[/INST]']]) AS inner_chars,
    CASE r WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(r) END AS frame_chars
  FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST), '')) AS loss_sha256,
  CAST(sum(inner_chars + frame_chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT a AS id, a AS r FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least_of AS (SELECT id, min(r) AS m FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON id = d.doc_id"""

LEAKS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
found AS (SELECT doc_id, i, m, item FROM dw JOIN bw USING (m, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


@register("op1_token_frames")
def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write framed files, read them back: doc_id, start, n_tokens, ids_crc32."""
    manifest = token_store.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read_token_files(manifest)


@register("op3_interleaved_shards")
def op3_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law rows: eight shards, counts at most one apart, every shard with the whole mixture."""
    out = interleave.interleave(table(spark, sf_dir, "documents"), shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


@register("op4_reply_trees", TREES_SQL)
def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and the planted one, and read turns and loss text back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_trees(chat.as_tree(rows.unionByName(planted)), best=1)
    back = made.select(
        "conv_id", chat.parse_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@register("op5_piece_viterbi")
def op5_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, their digest, and whether they decode to the text."""
    return pieces.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op6_language_centroids")
def op6_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text; fitted on the training fold only."""
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit_on_training_fold(docs))
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "lang_pred", "score", "rejected")


@register("op9_wu_manber", LEAKS_SQL)
def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and which items occur."""
    out = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op10_char_bilstm_crf")
def op10_char_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: exact base spans and those the tagger adds."""
    return pii.find(table(spark, sf_dir, "documents"))


@register("op7_bayes_minhash", NEAR_SQL)
def op7_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=85)


@register("op8_pitman_yor")
def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole text, learnt from the training fold, beside the base score."""
    return hpylm.score(table(spark, sf_dir, "documents"))


@register("op2_chroma_prints")
def op2_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all recordings (embeddings played as notes), and what the queries align with.

    One row a recording and match; rows without a match have nulls. Queries are the rows whose
    vec_id is divisible by 100, searched against all rows.
    """
    media = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples"))
    prints = materialize(chroma.fingerprint_table(media, render=True), "prints")
    found = chroma.search(prints, prints.where("id % 100 = 0"))
    return chroma.classes(prints).join(found, "id", "left").withColumnRenamed("id", "vec_id")
