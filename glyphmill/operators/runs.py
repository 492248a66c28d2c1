"""The record of a training run: when to log and evaluate, what was configured, which values were seen."""

from __future__ import annotations

import dataclasses
import json
import math
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC = "run string, step long, name string, value double"


def logs_at(step: Column, every: int) -> Column:
    """Whether a step is logged; step 0 is."""
    return step % every == 0


def evaluates_at(step: Column, every: int, has_validation: bool = True) -> Column:
    """Whether a step is followed by an evaluation; step 0 never is."""
    if not has_validation or every <= 0:
        return F.lit(False)
    return (step > 0) & (step % every == 0)


def total_steps(batches: int, epochs: int, max_steps: int = 0) -> int:
    """How many micro-batches a run takes: max_steps, or if that is 0 all epochs'."""
    return max_steps or epochs * math.ceil(batches)


def metric_rows(spark: SparkSession, run: str, step: int, values: dict[str, float]) -> DataFrame:
    """The values of one step as rows."""
    return spark.createDataFrame([(run, step, k, float(v)) for k, v in values.items()], METRIC)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Adds rows to a run's metric table."""
    rows.write.mode("append").parquet(path)


def write_config(config: Any, path: str) -> None:
    """A dataclass as JSON; values that JSON lacks as their text."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dataclasses.asdict(config), f, ensure_ascii=False, indent=2, default=str)


def train(*_: Any, **__: Any) -> None:
    """Model training and adapter merging are no data operations; run them under TorchDistributor."""
    raise NotImplementedError("training is outside this package: hand a function to pyspark.ml.torch.distributor.TorchDistributor")
