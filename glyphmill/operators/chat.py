"""Requests to a chat-completions endpoint, and its answers."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.media import data_url
from ..functions.results import message_text


def endpoint(base_url: Column) -> Column:
    """The completions address under a base address, whatever slashes that ends in."""
    return F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit("/chat/completions"))


def headers(api_key: Column) -> Column:
    """The request's headers as a map; a key that is null or empty gives none."""
    plain = F.create_map(F.lit("Content-Type"), F.lit("application/json"))
    signed = F.map_concat(plain, F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), api_key)))
    return F.when(F.coalesce(api_key, F.lit("")) != "", signed).otherwise(plain)


def payload(model: str, prompt: Column, image_url: Column | None = None, max_tokens: int = 2048, temperature: float = 0.0) -> Column:
    """The request's JSON: one user message of a text part and, if given, an image part."""
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("image_url"))
    none = F.lit(None).cast("string")
    parts = [part("text", prompt, none)] + ([] if image_url is None else [part("image_url", none, image_url)])
    message = F.struct(F.lit("user").alias("role"), F.array(*parts).alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), F.array(message).alias("messages")))


def image_requests(images: DataFrame, model: str, prompt: str, **options) -> DataFrame:
    """path, request for images (path, content)."""
    return images.select("path", payload(model, F.lit(prompt), data_url(F.col("path"), F.col("content")), **options).alias("request"))


def http_post(base_url: str, api_key: str | None = None) -> Callable[[], Callable[[str], str]]:
    """Makes a function that posts a request and gives the answer's text; an HTTP error raises."""

    def make() -> Callable[[str], str]:
        address = base_url.rstrip("/") + "/chat/completions"
        named = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})

        def post(request: str) -> str:
            body = json.dumps(json.loads(request)).encode()
            with urllib.request.urlopen(urllib.request.Request(address, data=body, headers=named)) as answer:  # noqa: S310
                return answer.read().decode()

        return post

    return make


def call(requests: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """requests (request, ...) with response and text; the poster is made once for each task."""
    schema = T.StructType([*requests.schema.fields, T.StructField("response", T.StringType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        post = make()
        for batch in batches:
            yield batch.assign(response=[post(r) for r in batch.request])

    return requests.mapInPandas(work, schema).withColumn("text", message_text(F.col("response")))
