"""URL predicates, names and joins."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pattern of what is downloaded, and of what a file name cannot hold.
DOWNLOADABLE = r"(?i)\.(png|jpg|jpeg|webp|tif|tiff|pdf)(\?.*)?$"
UNSAFE = "[^a-zA-Z0-9._-]+"
_PARTS = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"


def netloc(url: Column) -> Column:
    """User, host and port as written; empty if the URL has none."""
    return F.regexp_extract(url, _PARTS, 1)


def path(url: Column) -> Column:
    """The path, without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 2), r";[^/]*$", "")


def same_host(seed: Column, url: Column) -> Column:
    """Whether both have the same netloc, letter for letter."""
    return netloc(seed) == netloc(url)


def is_downloadable(url: Column) -> Column:
    """Whether the URL ends in a suffix of an image or PDF, a query aside."""
    return F.rlike(url, F.lit(DOWNLOADABLE))


def wants_download(url: Column, content_type: Column) -> Column:
    """Whether a response is stored rather than searched for links."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return is_downloadable(url) | F.contains(kind, F.lit("application/pdf")) | F.startswith(kind, F.lit("image/"))


def is_html(content_type: Column, body: Column) -> Column:
    """Whether a response is searched for links."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    start = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 200))
    return F.contains(kind, F.lit("text/html")) | (kind == "") | F.contains(start, F.lit("<html"))


def safe_filename(url: Column) -> Column:
    """The last component of the path with other characters than letters, digits, dot, dash, underscore as one underscore."""
    parts = F.filter(F.split(path(url), "/"), lambda p: (p != "") & (p != "."))
    name = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise("download")
    return F.regexp_replace(name, UNSAFE, "_")


@F.pandas_udf(T.StringType())
def resolve_link(base: pd.Series, link: pd.Series) -> pd.Series:
    """link as an absolute URL, as seen from the page base; null if it cannot be read as one."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if x is None else urljoin(b or "", x)
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)
