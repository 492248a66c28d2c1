"""Applying an image-to-text model to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.results import coerce_result

#: The number types a model can be loaded in.
DTYPES = ("float16", "bfloat16", "float32")


class Predictor(Protocol):
    """Answers for a list of image paths, in their order."""

    def __call__(self, paths: list[str]) -> list[Any]: ...


#: The default prompt, and an image's and a tile's side.
PROMPT, BASE_SIDE, TILE_SIDE = "<image>\nFree OCR.", 1024, 640


@dataclass(frozen=True)
class InferenceOptions:
    """What a predictor factory is told; extra holds options of one model only, such as decoding constraints."""

    prompt: str = PROMPT
    base_size: int = BASE_SIDE
    image_size: int = TILE_SIDE
    crop_mode: bool = True
    dtype: str = "bfloat16"
    device: str = "cpu"
    save_results: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise ValueError(f"dtype must be one of {', '.join(DTYPES)}, not {self.dtype}")


Factory = Callable[[], Predictor]


def first_of(*factories: Factory) -> Factory:
    """The first factory that works; None as predictor if none does."""

    def make() -> Predictor:
        for factory in factories:
            try:
                return factory()
            except Exception:  # noqa: BLE001, S112
                continue
        return None

    return make


def apply_predictor(items: DataFrame, factory: Factory, path_col: str = "image_path") -> DataFrame:
    """items with pred. The model is made once for each task; rows go to it in Arrow batches."""
    schema = T.StructType([*items.schema.fields, T.StructField("pred", T.StringType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        if not callable(model):
            raise AttributeError("the factory made nothing that can be called")
        for batch in batches:
            answers = model(batch[path_col].tolist())
            if len(answers) != len(batch):
                raise ValueError("a predictor must answer each path")
            yield batch.assign(pred=[coerce_result(a) for a in answers])

    return items.mapInPandas(work, schema)


class ReplacePredictor:
    """For tests: the texts it was given by path, with one string replaced by another."""

    def __init__(self, texts: dict[str, str], old: str, new: str):
        self.texts, self.old, self.new = texts, old, new

    def __call__(self, paths: list[str]) -> list[Any]:
        return [self.texts[p].replace(self.old, self.new) for p in paths]
