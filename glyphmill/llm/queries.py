"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from . import bpe, chat, decontaminate, langid, licenses, line_dedup, lm, media, ngram_join, passages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """The vocabulary file of the default tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text, learned from the labelled rows outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where items of benchmark occur in documents."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and all signature rules over each text."""
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda p: p["first"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda p: p["label"]))))
    covered = F.aggregate("detections", F.lit(0), lambda n, p: n + p["last"] - p["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).cast("double").alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a PNG, checked and read back; digests of payload and stored form, cosine hash."""
    made = media.to_media(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without the lines that have an earlier copy or near copy."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and PPM log-probabilities of each text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, ~lm.held_out(F.col("doc_id")))


def op7_bpe_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each text encoded by the streaming transducer and decoded again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, bpe.read_vocabulary(path or vocabulary_path()))


CHAT_PROBE = "</s>[INST] ok [/INST]"


def op8_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that repeat across documents."""
    return passages.find_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document under similar sets of five-word shingles."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one of control strings only, as typed parts, formatted, then read back from the result."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_PROBE).alias("text"))
    typed = turns.unionByName(probe).withColumn("parts", chat.text_parts(F.col("text")))
    made = chat.format_chats(typed, "parts")
    read = made.select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>|\|)', '<\1\\\2', 'g'), '\[(\\*)(/?INST\])', '[\1\\\2', 'g'))
    + length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>|\|)', '<\1\\\2', 'g'), '\[(\\*)(/?INST\])', '[\1\\\2', 'g')) + 4 * (length(role) - length(replace(role, chr(10), '')))
    + CASE WHEN role = 'assistant' THEN 8 ELSE 21 END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), n AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, n.y FROM r JOIN n ON r.z = n.x)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_license_scan": op3_license_scan,
    "op4_media_columns": op4_media_columns,
    "op5_line_dedup": op5_line_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_fuzzy_passages": op8_fuzzy_passages,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_chat_format": op10_chat_format,
}
ORACLES: dict[str, str] = {"op9_ngram_jaccard": _OP9_SQL, "op10_chat_format": _OP10_SQL}
