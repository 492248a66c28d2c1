"""Inference over a directory: a text file for each image and one summary."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import materialize
from ..functions.media import stem
from ..sources.images import list_images
from .predict import Factory, apply_predictor


def result_files(answers: DataFrame, results_dir: str) -> DataFrame:
    """image, result_txt, text and last: of images with one stem, the last by path keeps the file."""
    named = answers.select(F.col("path").alias("image"), F.concat(F.lit(results_dir.rstrip("/") + "/"), stem(F.col("path")), F.lit(".txt")).alias("result_txt"), F.col("pred").alias("text"))
    order = Window.partitionBy("result_txt").orderBy(F.desc("image"))
    return named.withColumn("last", F.row_number().over(order) == 1)


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, text in zip(batch.result_txt, batch.text, strict=True):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        yield batch[["result_txt"]]


def infer_directory(spark: SparkSession, examples_dir: str, results_dir: str, factory: Factory, summary_dir: str | None = None) -> DataFrame:
    """Runs a predictor over a directory's images and writes its results; raises if there are none.

    results_dir must be a folder that the executors share. File names do not
    depend on the task, so a task that is run again writes the same files. The
    summary has every image in scan order, also those whose file another took.
    """
    images = list_images(spark, examples_dir)
    if images.isEmpty():
        raise FileNotFoundError(f"no images in {examples_dir}")
    found = materialize(result_files(apply_predictor(images, factory, "path"), results_dir))
    found.filter("last").mapInPandas(_write, "result_txt string").count()
    rows = found.select("image", "result_txt", "text")
    if summary_dir:
        rows.orderBy("image").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(summary_dir)
    return rows
