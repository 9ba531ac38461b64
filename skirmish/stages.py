"""Tables that a job writes between its stages."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a session without executors of its own (``local[n]``) may leave that unset; it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="skirmish-stages-"))
            atexit.register(_LOCAL[0].cleanup)
        root = _LOCAL[0].name
    return f"{root}/skirmish-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, written to the shared folder and read back: later stages, and ones that run again, start from the files.

    by: a column of few values; readers of one of them read its folder only. A value is dealt to as many files as the
    session has cores, by a hash of its rows, so that as many tasks read it; a frequent value has more.
    """
    path = shared_folder(df.sparkSession)
    if by is None:
        df.write.parquet(path)
    else:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(df.sparkSession.sparkContext.defaultParallelism))
        df.withColumn("_part", part).hint("rebalance", F.col(by), F.col("_part")).drop("_part").write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)
