"""Character and word error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text_edits


def _rate(nothing: Column, other_nothing: Column, edits: Column, size: Column) -> Column:
    """edits / size; against an empty reference 0 for an empty prediction and 1 for any other."""
    return F.when(nothing, F.when(other_nothing, 0.0).otherwise(1.0)).otherwise(edits / size)


def cer(pred: Column, ref: Column) -> Column:
    """Character error rate, not clipped at 1."""
    return _rate(ref == "", pred == "", text_edits(pred, ref)["chars"], F.char_length(ref))


def wer(pred: Column, ref: Column) -> Column:
    """Word error rate, not clipped at 1."""
    found = text_edits(pred, ref)
    return _rate(found["ref_words"] == 0, found["pred_words"] == 0, found["words"], found["ref_words"])


def score_rows(rows: DataFrame) -> DataFrame:
    """rows (pred, ref, ...) with cer and wer."""
    return rows.withColumns({"cer": cer(F.col("pred"), F.col("ref")), "wer": wer(F.col("pred"), F.col("ref"))})


def macro_metrics(scored: DataFrame) -> DataFrame:
    """The mean of the rows' rates, 0 over no rows, and their number."""
    zero = F.lit(0.0)
    return scored.agg(F.coalesce(F.avg("cer"), zero).alias("cer"), F.coalesce(F.avg("wer"), zero).alias("wer"), F.count("*").alias("num_samples"))


def pair_by_position(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """preds (row_idx, pred) with refs (row_idx, ref); raises if one side has a row that the other lacks."""
    both = preds.select("row_idx", "pred", F.lit(True).alias("_p")).join(refs.select("row_idx", "ref", F.lit(True).alias("_r")), "row_idx", "full_outer")
    lacks = F.col("_p").isNull() | F.col("_r").isNull()
    wrong = F.raise_error(F.lit("predictions and references differ in number")).cast("string")
    return both.select("row_idx", F.when(lacks, wrong).otherwise(F.col("pred")).alias("pred"), "ref")
