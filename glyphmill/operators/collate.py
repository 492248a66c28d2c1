"""Rows to padded, masked batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the label that a loss passes over.
IGNORED = -100


def with_prompt(text: Column, prompt: str) -> Column:
    """prompt before text; nothing for an empty prompt."""
    return F.concat(F.lit(prompt), text) if prompt else text


def truncate(ids: Column, most: int | None) -> Column:
    """The first most ids; all if most is None."""
    return ids if most is None else F.slice(ids, 1, most)


def pad(ids: Column, width: Column, pad_id: int) -> Column:
    """ids up to width."""
    return F.concat(ids, F.array_repeat(F.lit(pad_id).cast("int"), width - F.size(ids)))


def mask(ids: Column, pad_id: int) -> Column:
    """Labels for ids: padding is passed over."""
    return F.transform(ids, lambda x: F.when(x == pad_id, IGNORED).otherwise(x))


def batches(rows: DataFrame, batch_size: int, pad_id: int = 0, most: int | None = None) -> DataFrame:
    """rows (row_idx, input_ids, maybe labels) with batch, width and padded input_ids; where labels are null or missing, ids with padding masked."""
    if "input_ids" not in rows.columns:
        raise ValueError("rows need input_ids")
    given = "labels" in rows.columns
    cut = rows.withColumns({"input_ids": truncate(F.col("input_ids"), most), "batch": F.floor(F.col("row_idx") / batch_size)})
    width = cut.groupBy("batch").agg(F.max(F.size("input_ids")).alias("width"))
    padded = cut.join(width, "batch").withColumn("input_ids", pad(F.col("input_ids"), F.col("width"), pad_id))
    own = mask(F.col("input_ids"), pad_id)
    return padded.withColumn("labels", F.coalesce("labels", own) if given else own)


def process(rows: DataFrame, factory: Callable[[], Callable[..., dict]], prompt: str = "", most: int | None = None) -> DataFrame:
    """rows (row_idx, image_path, text) as input_ids, and labels if the processor gives any.

    The processor is made once for each task and called with images, text and
    max_length for a batch of rows; it must answer with input_ids for each. A
    row without labels of its own gets null, which batches() masks.
    """
    texts = rows.select("row_idx", "image_path", with_prompt(F.col("text"), prompt).alias("text"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        processor = factory()
        for frame in frames:
            made = processor(images=frame.image_path.tolist(), text=frame.text.tolist(), max_length=most)
            if "input_ids" not in made:
                raise ValueError("a processor must answer with input_ids")
            labels = made.get("labels", [None] * len(frame))
            yield pd.DataFrame({"row_idx": frame.row_idx, "input_ids": list(made["input_ids"]), "labels": list(labels)})

    return texts.mapInPandas(work, "row_idx long, input_ids array<int>, labels array<int>")


def collate(rows: DataFrame, batch_size: int, **options) -> DataFrame:
    """One row a batch: input_ids and labels as arrays of rows, in order."""
    made = batches(rows, batch_size, **options)
    listed = made.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("row_idx", "input_ids", "labels"))).alias("x"))
    return listed.select("batch", F.transform("x", lambda r: r["input_ids"]).alias("input_ids"), F.transform("x", lambda r: r["labels"]).alias("labels"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """rows in a random order that the seed fixes, by row_idx alone."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col("row_idx")), "row_idx")
