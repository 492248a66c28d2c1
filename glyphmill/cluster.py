"""What a job needs from the cluster: the package's source on the workers, and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that the operators ask for where the session still has Spark's default.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"
_sent: set[str] = set()
_own: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's source to the application's Python files, once; workers need not have it installed.

    Arrow batches of the session are held to BATCH_BYTES, unless it sets them:
    ten thousand long texts at a time would fill small executors.
    """
    if spark.conf.get(BATCH_KEY, BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        handle, name = tempfile.mkstemp(prefix="glyphmill-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w") as made:
            for path in sorted(root.rglob("*.py")):
                made.write(path, path.relative_to(root.parent))
        context.addPyFile(name)
        _sent.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of the context's checkpoints.

    Only a local master, where driver and executors are one process, gets a
    temporary folder when neither is set.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="glyphmill-"))
    return _own[0]


def materialize(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again.

    A lost executor then costs a reread instead of the whole lineage, and an
    iteration starts from a plan of one scan. The tables stay until release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphmill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes every table that this application has materialized."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/glyphmill/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
