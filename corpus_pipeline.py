"""A corpus pipeline of five operators: language, lines, near duplicates, benchmark passages, tokens.

Each stage takes the documents that the one before has kept, as a written table,
and returns them with the columns of documents; the last returns their tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.cluster import materialize, ship
from glyphmill.llm import bpe, decontaminate, langid, line_dedup, ngram_join
from glyphmill.llm.queries import vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification, learned from their own labels, does not reject."""
    ship(spark)
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that has nothing else goes."""
    ship(spark)
    made = line_dedup.dedup_lines(docs)
    emptied = (F.col("text") == "") & (F.col("n_kept") < F.col("n_lines"))
    made = made.filter(~F.coalesce(emptied, F.lit(False)))
    return made.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    ship(spark)
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    ship(spark)
    made = bpe.encode_decode(docs, bpe.read_vocabulary(vocabulary_path()), keep=["lang", "source", "text"])
    intact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", intact.alias("intact"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL has no language models, fuzzy lines or transducers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
