"""File names and image bytes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types that a request names; all others are octets.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "tif", "tiff")


def base_name(path: Column) -> Column:
    """The last component of a path."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The suffix with its dot, lower-cased; empty if there is none or the name only starts with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """The last component without its suffix."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.char_length(name) - F.char_length(suffix(path)))


def is_image(path: Column) -> Column:
    """Whether the suffix is that of an image."""
    return suffix(path).isin(*[f".{s}" for s in IMAGE_SUFFIXES])


def mime_type(path: Column) -> Column:
    """The type named in a request for a file of this suffix."""
    found = F.lit("application/octet-stream")
    for name, kind in MIME.items():
        found = F.when(suffix(path) == f".{name}", kind).otherwise(found)
    return found


def data_url(path: Column, content: Column) -> Column:
    """content as an inline URL; base64 without line breaks."""
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))
