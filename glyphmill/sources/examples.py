"""Labelled examples from JSON lines, with explicit row positions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import materialize
from ..functions.text import is_blank

SCHEMA = T.StructType([T.StructField("image_path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType())])
_LOW = (1 << 33) - 1


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with row_idx: position over the partitions in their order.

    Place in the partition is written with the rows; only the partitions' sizes
    are then added up, so no task sees more than its own rows.
    """
    own = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))})
    own = materialize(own)
    sizes = own.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("_part", "coalesce(sum(n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before")
    return own.join(F.broadcast(before), "_part").withColumn("row_idx", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def index_file(lines: DataFrame) -> DataFrame:
    """lines of one text file with row_idx, in the file's order."""
    return _numbered(lines)


def index_by(rows: DataFrame, *order: str, ties: tuple[str, ...] = (), keep: tuple[Column | str, ...] = ("*",)) -> DataFrame:
    """rows with row_idx by the columns of order, which tell rows apart.

    Rows of equal order share a task and go by ties there; bounds of tasks are
    taken from order alone, so long texts belong in ties. keep: what is written of each row.
    """
    return _numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order, *ties).select(*keep))


def parse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """lines (row_idx, value) as row_idx, image_path, text, id.

    A missing id is the position as text. strict: a line that is no JSON object,
    lacks a required field or gives it another type than string, or is no UTF-8,
    raises; else such a line has _corrupt set and nulls.
    """
    value = F.try_parse_json("value")
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")), F.lit("VOID"))
    text = lambda k: F.try_variant_get(value, f"$.{k}", "string")
    good = F.coalesce(F.is_valid_utf8("value") & (kind("image_path") == "STRING") & (kind("text") == "STRING"), F.lit(False))
    # the variant parser refuses repeated keys, where the last is meant to win
    plain = F.from_json("value", SCHEMA)
    again = value.isNull() & plain.isNotNull() & plain["image_path"].isNotNull() & plain["text"].isNotNull() & F.is_valid_utf8("value")
    read = lambda k: F.when(value.isNull(), plain[k]).otherwise(text(k))
    bad = ~(good | F.coalesce(again, F.lit(False)))
    rows = lines.select("row_idx", *[read(k).alias(k) for k in ("image_path", "text", "id")], bad.alias("_corrupt"))
    rows = rows.withColumn("id", F.coalesce("id", F.col("row_idx").cast("string")))
    if not strict:
        blank = lambda k: F.when(~F.col("_corrupt"), F.col(k)).alias(k)
        return rows.select("row_idx", blank("image_path"), blank("text"), "id", "_corrupt")
    wrong = F.raise_error(F.concat(F.lit("bad example at row "), F.col("row_idx").cast("string"))).cast("string")
    return rows.select("row_idx", F.when(F.col("_corrupt"), wrong).otherwise(F.col("image_path")).alias("image_path"), "text", "id")


def prefix(rows: DataFrame, max_samples: int | None) -> DataFrame:
    """The rows that a loader reads: the first max_samples, one at least."""
    return rows if max_samples is None else rows.filter(F.col("row_idx") < max(max_samples, 1))


def head(rows: DataFrame, max_samples: int | None) -> DataFrame:
    """The rows that an evaluation keeps; a negative number drops that many from the end."""
    if max_samples is None:
        return rows
    if max_samples >= 0:
        return rows.filter(F.col("row_idx") < max_samples)
    last = rows.agg((F.max("row_idx") + 1 + max_samples).alias("_end"))
    return rows.join(F.broadcast(last), F.col("row_idx") < F.col("_end")).drop("_end")


def resolve_path(path: Column, base: str) -> Column:
    """path itself if absolute, else under base, with dot segments taken out."""
    root = str(Path(base).resolve())

    @F.udf(T.StringType())
    def normal(p):  # noqa: ANN001, ANN202
        return None if p is None else os.path.normpath(os.path.join(root, p))

    # only what has a dot segment or doubled slash leaves the JVM
    odd = F.rlike(path, F.lit(r"(^|/)\.{1,2}(/|$)|//|/$"))
    return F.when(F.startswith(path, F.lit("/")), path).when(odd, normal(path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def read_examples(spark: SparkSession, path: str, base_dir: str | None = None, max_samples: int | None = None, strict: bool = True) -> DataFrame:
    """The examples of one JSON-lines file: row_idx, image_path, text, id.

    Blank lines do not count; lines past max_samples are never parsed.
    """
    if strict:
        start = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 3).alias("c")).first()
        if start is not None and bytes(start["c"]) == b"\xef\xbb\xbf":
            raise ValueError(f"{path} starts with a byte order mark")
    lines = spark.read.text(path).filter(~is_blank(F.col("value")))
    rows = parse(prefix(index_file(lines), max_samples), strict)
    return rows.withColumn("image_path", resolve_path(F.col("image_path"), base_dir or os.path.dirname(path.removeprefix("file://"))))


def example_at(rows: DataFrame, position: int) -> DataFrame:
    """The row at a position, counted from the end if negative; then its default id is the number asked for."""
    if position >= 0:
        return rows.filter(F.col("row_idx") == position)
    end = rows.agg((F.max("row_idx") + 1 + position).alias("_at"))
    found = rows.join(F.broadcast(end), F.col("row_idx") == F.col("_at")).drop("_at")
    return found.withColumn("id", F.when(F.col("id") == F.col("row_idx").cast("string"), str(position)).otherwise(F.col("id")))


def to_items(rows: DataFrame, validate_images: DataFrame | None = None) -> DataFrame:
    """What an evaluation takes of each example. validate_images (path): rows without their file there raise."""
    items = rows.select("row_idx", "id", "image_path", "text")
    if validate_images is None:
        return items
    there = validate_images.select(F.regexp_replace("path", "^file:/*", "/").alias("_path")).distinct()
    joined = items.join(there, F.col("image_path") == F.col("_path"), "left")
    wrong = F.raise_error(F.concat(F.lit("no image at "), F.col("image_path"))).cast("string")
    return joined.select("row_idx", "id", F.when(F.col("_path").isNull(), wrong).otherwise(F.col("image_path")).alias("image_path"), "text")
