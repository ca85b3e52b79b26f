"""The folder that the driver and all executors share, for tables between two jobs."""

from __future__ import annotations

import os
import re
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A folder of this machine is made only where Spark runs on it alone."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _made:
        _made[context.applicationId] = mkdtemp(prefix="gazelark-")
    return _made[context.applicationId]


_made: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_path(spark: SparkSession) -> str:
    """Under which path tasks may open files themselves: / where Spark runs on one machine, else the
    folder in spark.checkpoint.dir, if it is a path that all machines have mounted; empty without one."""
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return "/"
    folder = shared_folder(spark)
    return "" if re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", folder) else plain_path(folder)


def plain_path(path: str) -> str:
    """A path without its scheme file: and without dots or repeated slashes."""
    return "/" + os.path.normpath(path.removeprefix("file:")).lstrip("/")


def within(path: str, shared: str) -> bool:
    return shared == "/" or (shared != "" and plain_path(path).startswith(shared.rstrip("/") + "/"))


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
