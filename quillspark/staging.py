"""Points at which a plan is cut: rows that several later steps read are computed once and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session uses a temporary folder, and a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{tempfile.gettempdir()}/quillspark-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


#: Paths that scratch has given out, by application.
_GIVEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there stays until ``clear``, as a returned DataFrame may read it."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete what lies at the paths that ``scratch`` has given out to this application, once results have been used."""
    for path in _GIVEN.pop(spark.sparkContext.applicationId, []):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
