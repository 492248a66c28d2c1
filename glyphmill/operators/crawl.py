"""Budgeted breadth-first crawl, level by level, over DataFrames.

First-in-first-out order is level order, so a level can be fetched as a whole:
its first occurrences that no earlier level has seen, in order, are cut where a
running sum of fetched pages or of downloads meets its budget. A level is
fetched before that point is known, so a live fetcher may fetch more of a level
than counts. Files are written for what the cut leaves only; if some cannot be
written, the rest of the level is cut again with the budget that they left.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import materialize
from ..functions.urls import is_html, resolve_link, safe_filename, same_host, wants_download

EVENT = "type string, url string, path string, content_type string, error string"
_ORDER = "ord array<bigint>"


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {"a": [], "img": []}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        wanted = {"a": "href", "img": "src"}.get(tag)
        value = dict(reversed(attrs)).get(wanted, ...) if wanted else ...
        if value is not ...:
            self.found[tag].append(value or "")


def links_of(html: str | None) -> list[tuple[int, int, str]]:
    """(kind, position, link) of a page: anchors (0) in order, then images (1) in order."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return [(kind, i, link) for kind, tag in enumerate(("a", "img")) for i, link in enumerate(parser.found[tag])]


def extract_links(pages: DataFrame) -> DataFrame:
    """Of pages (url, body, ord): one row for each link with url, link, and ord extended by kind and position."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, link, [*o, kind, i]) for u, body, o in zip(batch.url, batch.body, batch.ord, strict=True) for kind, i, link in links_of(body)]
            yield pd.DataFrame(rows, columns=["url", "link", "ord"])

    return pages.select("url", "body", "ord").mapInPandas(work, f"url string, link string, {_ORDER}")


def next_frontier(pages: DataFrame, seed: str, same_host_only: bool) -> DataFrame:
    """url, ord of what the links of pages lead to."""
    found = extract_links(pages).select(resolve_link("url", "link").alias("url"), "ord").filter(F.col("url").isNotNull())
    return found.filter(same_host(F.lit(seed), F.col("url"))) if same_host_only else found


def first_unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Each URL of frontier once, at its first place, without those visited."""
    return frontier.groupBy("url").agg(F.min("ord").alias("ord")).join(visited.select("url"), "url", "left_anti")


def within_budget(level: DataFrame, max_pages: int, max_downloads: int, pages: int = 0, downloads: int = 0) -> DataFrame:
    """Of level (ord, ok, downloaded): the rows before either budget is met, counting from pages and downloads.

    Running sums go over ranges of the order, each in its own task; only the
    ranges' totals are added up in one.
    """
    own = materialize(level.repartitionByRange("ord").withColumn("_part", F.spark_partition_id()))
    sums = [F.sum(F.col(c).cast("long")) for c in ("ok", "downloaded")]
    totals = own.groupBy("_part").agg(sums[0].alias("p"), sums[1].alias("d"))
    earlier = "coalesce(sum({0}) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _{0}0"
    before = Window.partitionBy("_part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda total, start: F.coalesce(total.over(before), F.lit(0)) + start
    placed = own.join(F.broadcast(totals.selectExpr("_part", earlier.format("p"), earlier.format("d"))), "_part")
    placed = placed.withColumns({"_p": so_far(sums[0], pages) + F.col("_p0"), "_d": so_far(sums[1], downloads) + F.col("_d0")})
    return placed.filter((F.col("_p") < max_pages) & (F.col("_d") < max_downloads)).select(*level.columns)


@dataclass
class CrawlResult:
    """events (ord and the columns of an event, in crawl order), visited URLs, and both counts."""

    events: DataFrame
    visited: DataFrame
    pages: int
    downloads: int


def _no_failure(rows: DataFrame) -> DataFrame:
    return rows.withColumn("write_error", F.lit(None).cast("string"))


def file_writer(directory: str) -> Callable[[DataFrame], DataFrame]:
    """Writes downloads (url, ord, content, path) under directory, a folder the executors share, with write_error for each.

    What goes to one path is written by one task, in crawl order: the last stays.
    """

    def write(rows: DataFrame) -> DataFrame:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                errors = []
                for path, content in zip(batch.path, batch.content, strict=True):
                    try:
                        os.makedirs(directory, exist_ok=True)
                        with open(path, "wb") as f:
                            f.write(content or b"")
                        errors.append(None)
                    except OSError as e:
                        errors.append(str(e))
                yield batch.assign(write_error=errors)

        placed = rows.repartition("path").sortWithinPartitions("path", "ord")
        return placed.mapInPandas(work, T.StructType([*rows.schema.fields, T.StructField("write_error", T.StringType())]))

    return write


def crawl(spark: SparkSession, seed: str, source, out_dir: str = "out", max_pages: int = 50, max_downloads: int = 200, same_host_only: bool = True, write: Callable[[DataFrame], DataFrame] = _no_failure) -> CrawlResult:
    """The crawl from seed over source (a PageStore or HttpFetcher)."""
    frontier = spark.createDataFrame([(seed, [0])], f"url string, {_ORDER}")
    visited = spark.createDataFrame([], "url string")
    events = spark.createDataFrame([], f"level long, {_ORDER}, {EVENT}")
    pages = downloads = level = 0
    folder = out_dir.rstrip("/") + "/downloads/"
    while pages < max_pages and downloads < max_downloads:
        fresh = materialize(first_unvisited(frontier, visited))
        if fresh.isEmpty():
            break
        got = source.fetch(fresh)
        target = F.col("ok") & wants_download(F.col("url"), F.col("content_type"))
        got = materialize(got.withColumns({"target": target, "path": F.when(target, F.concat(F.lit(folder), safe_filename(F.col("url"))))}))
        left, parents = got.select("url", "ord", "ok", F.col("target").alias("downloaded")), None
        while True:
            kept = materialize(within_budget(left, max_pages, max_downloads, pages, downloads))
            mine = got.join(kept.select("url"), "url")
            mine = materialize(write(mine.filter("target")).unionByName(mine.filter("not target").withColumn("write_error", F.lit(None).cast("string"))))
            kind = F.when(~F.col("ok"), "page_error").when(~F.col("target"), None).when(F.col("write_error").isNull(), "download").otherwise("download_error")
            told = mine.withColumn("type", kind).filter(F.col("type").isNotNull()).select(
                F.lit(level).cast("long").alias("level"), "ord", "type", "url",
                F.when(F.col("type") == "download", F.col("path")).alias("path"),
                F.when(F.col("type") == "download", F.lower(F.coalesce("content_type", F.lit("")))).alias("content_type"),
                F.when(F.col("type") == "page_error", F.col("error")).when(F.col("type") == "download_error", F.col("write_error")).alias("error"),
            )
            events, visited = events.unionByName(told), visited.unionByName(mine.select("url"))
            own = mine.filter(F.col("ok") & ~F.col("target") & is_html(F.col("content_type"), F.col("body"))).select("url", "body", "ord")
            parents = own if parents is None else parents.unionByName(own)
            n = mine.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in (("p", F.col("ok")), ("d", F.col("target") & F.col("write_error").isNull()), ("failed", F.col("write_error").isNotNull()))]).first()
            pages, downloads = pages + n["p"], downloads + n["d"]
            if not n["failed"] or pages >= max_pages or downloads >= max_downloads:
                break
            left = materialize(left.join(kept.select("url"), "url", "left_anti"))
            if left.isEmpty():
                break
        events, visited, level = materialize(events), materialize(visited), level + 1
        frontier = materialize(next_frontier(parents, seed, same_host_only))
    return CrawlResult(events, visited, pages, downloads)


def append_events(result: CrawlResult, path: str) -> None:
    """Adds the crawl's events to a folder of JSON lines, in crawl order."""
    result.events.orderBy("level", "ord").select("type", "url", "path", "content_type", "error").coalesce(1).write.mode("append").json(path)
