"""Image files as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import is_image


def list_images(spark: SparkSession, directory: str) -> DataFrame:
    """path of each image directly in directory, by path. Contents are not read; Spark lists no files of zero bytes."""
    found = spark.read.format("binaryFile").load(directory).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    return found.filter(is_image(F.col("path"))).orderBy("path")


def read_bytes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content of whole files."""
    return spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")


def decode_images(files: DataFrame, decoder: Callable[[bytes], bytes], mode: str = "RGB") -> DataFrame:
    """files (path, content) with pixels from decoder, which is made for mode once in a worker."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(mode=mode, pixels=[decoder(bytes(c)) for c in batch.content])[["path", "mode", "pixels"]]

    return files.select("path", "content").mapInPandas(work, "path string, mode string, pixels binary")
