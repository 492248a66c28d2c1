"""Evaluation of predictions against references, and comparison of two models."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import macro_metrics, score_rows
from ..sources.examples import head, index_by
from .predict import Factory, apply_predictor

_EXAMPLE = ("id", "image_path", "ref", "pred")


def result_rows(items: DataFrame, factory: Factory, max_samples: int | None = None) -> DataFrame:
    """row_idx, id, image_path, ref, pred: predictions beside their references, row by row."""
    answered = apply_predictor(head(items, max_samples), factory)
    return answered.select("row_idx", "id", "image_path", F.col("text").alias("ref"), "pred")


def summary(results: DataFrame) -> DataFrame:
    """cer, wer, num_samples as one row."""
    return macro_metrics(score_rows(results))


def report(results: DataFrame) -> DataFrame:
    """One row: metrics, num_samples and the examples in order. Gathers the examples in one value, as a report is."""
    rows = score_rows(results)
    example = F.struct("row_idx", *_EXAMPLE)
    zero = F.lit(0.0)
    one = rows.agg(F.coalesce(F.avg("cer"), zero).alias("cer"), F.coalesce(F.avg("wer"), zero).alias("wer"), F.count("*").alias("num_samples"), F.array_sort(F.collect_list(example)).alias("x"))
    return one.select(F.struct("cer", "wer").alias("metrics"), "num_samples", F.transform("x", lambda e: F.struct(*[e[c].alias(c) for c in _EXAMPLE])).alias("examples"))


def example_rows(results: DataFrame, *shown: Column | str) -> DataFrame:
    """A report's examples as rows: shown, or all of their columns, and position (long) in the report. Gathers nothing.

    Only what is shown is written when rows are counted; texts cross one shuffle.
    """
    rows = results.select(F.col("row_idx").alias("_row"), *_EXAMPLE)
    return index_by(rows, "_row", "id", "image_path", ties=("ref", "pred"), keep=shown or _EXAMPLE).withColumnRenamed("row_idx", "position")


def compare(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """The difference of two models' rates, the second less the first, from result rows of the same items."""
    a, b = summary(base), summary(tuned)
    a = a.select(F.col("cer").alias("base_cer"), F.col("wer").alias("base_wer"), F.col("num_samples").alias("base_samples"))
    b = b.select(F.col("cer").alias("tuned_cer"), F.col("wer").alias("tuned_wer"), F.col("num_samples").alias("tuned_samples"))
    both = a.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row each
    return both.withColumns({"delta_cer": F.col("tuned_cer") - F.col("base_cer"), "delta_wer": F.col("tuned_wer") - F.col("base_wer")})


def compare_report(base: DataFrame, tuned: DataFrame, base_id: str, tuned_id: str) -> dict:
    """Both reports with their model's id, and the differences."""
    a, b = report_dict(base), report_dict(tuned)
    delta = {k: b["metrics"][k] - a["metrics"][k] for k in ("cer", "wer")}
    return {"base": {"model_id": base_id} | a, "finetuned": {"model_id": tuned_id} | b, "delta": delta}


def report_dict(results: DataFrame) -> dict:
    """The report as a dict on the driver."""
    return report(results).first().asDict(recursive=True)


def write_report(made: dict, path: str) -> None:
    """made as one indented JSON document; the folder is created, an old file replaced."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f, ensure_ascii=False, indent=2)


def write_step_report(made: dict, output_dir: str, step: int) -> str:
    """The report of an evaluation within a run, named after its step; the path."""
    path = os.path.join(output_dir, f"eval_step_{step}.json")
    write_report(made, path)
    return path


def write_report_rows(results: DataFrame, path: str) -> None:
    """A report too large for one document: scored examples as JSON lines in a folder, written in parallel."""
    score_rows(results).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
