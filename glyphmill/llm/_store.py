"""Tables that cut lineage, and joins by fingerprint on them."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialize

#: Bits of the table that tells which fingerprints may be wanted.
BITS = 1 << 23


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referred to; it does so as both sides collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (fp, ...) without most of those whose fp is not in wanted (fp), and without losing one that is.

    The fingerprints of wanted set bits of a table that has at most BITS / 64
    rows whatever the data, so it is broadcast and spares rows a shuffle.
    """
    table = wanted.groupBy(F.expr(f"shiftright(pmod(fp, {BITS}), 6)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(fp, {BITS}) & 63 as int)))").alias("bits"))
    placed = rows.withColumn("word", F.expr(f"shiftright(pmod(fp, {BITS}), 6)"))
    return placed.join(F.broadcast(table), "word").filter(F.expr(f"shiftright(bits, cast(pmod(fp, {BITS}) & 63 as int)) & 1 = 1")).drop("word", "bits")


def shared_keys(rows: DataFrame) -> DataFrame:
    """rows (h, fp, ...) whose h has more than one fp. rows is read twice.

    Least and greatest fp of an h are combined before the shuffle, and the rows
    of a common h are split by the join, so neither needs them in one task.
    """
    ends = rows.groupBy("h").agg(F.min("fp").alias("least"), F.max("fp").alias("greatest")).filter("least <> greatest")
    ends = materialize(ends.select("h"))
    named = rows.withColumnRenamed("fp", "_fp")
    return likely(named.withColumn("fp", F.col("h")), ends.select(F.col("h").alias("fp"))).drop("fp").withColumnRenamed("_fp", "fp").join(ends, "h").select(*rows.columns)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        if len(fp):
            new = np.r_[last is None or fp[0] != last, fp[1:] != fp[:-1]]
            last = fp[-1]
            yield batch.filter(pa.array(new))


def once_each(rows: DataFrame) -> DataFrame:
    """One row (the rows of an fp are equal) for each fp, as a written table."""
    return materialize(rows.repartition("fp").sortWithinPartitions("fp").mapInArrow(_first_of_each, rows.schema))
