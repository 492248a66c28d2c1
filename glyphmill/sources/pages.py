"""Where a crawl gets its pages: a table of known pages, or HTTP."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FETCHED = "url string, ok boolean, content_type string, body string, content binary, error string"


class PageStore:
    """Pages from a table (url, and some of content_type, body, content); a URL that it lacks is an error, of several with one URL the least counts."""

    def __init__(self, pages: DataFrame):
        have = dict(pages.dtypes)
        typed = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
        rows = pages.select("url", F.struct(typed("content_type", "string"), typed("body", "string"), typed("content", "binary")).alias("p"))
        self.pages = rows.groupBy("url").agg(F.min("p").alias("p")).select("url", "p.*", F.lit(True).alias("_known"))

    def fetch(self, urls: DataFrame) -> DataFrame:
        """urls (url, ...) with what was fetched."""
        found = urls.join(self.pages, "url", "left").withColumn("ok", F.coalesce("_known", F.lit(False))).drop("_known")
        return found.withColumn("error", F.when(~F.col("ok"), "not found"))


class HttpFetcher:
    """Pages by HTTP GET, one attempt each; whatever goes wrong is that URL's error."""

    def __init__(self, user_agent: str = "glyphmill/0.1", timeout: float = 15.0):
        self.user_agent, self.timeout = user_agent, timeout

    def _get(self, url: str) -> dict:
        try:
            request = urllib.request.Request(url, headers={"User-Agent": self.user_agent})
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                content = answer.read()
                charset = answer.headers.get_content_charset() or "utf-8"
                return {"ok": True, "content_type": (answer.headers.get("Content-Type") or "").lower(), "body": content.decode(charset, "replace"), "content": content, "error": None}
        except Exception as e:  # noqa: BLE001
            return {"ok": False, "content_type": None, "body": None, "content": None, "error": str(e)}

    def fetch(self, urls: DataFrame) -> DataFrame:
        """urls (url, ...) with what was fetched."""

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([{"url": u} | self._get(u) for u in batch.url], columns=["url", "ok", "content_type", "body", "content", "error"])

        got = urls.select("url").distinct().mapInPandas(work, FETCHED)
        return urls.join(got, "url")
