"""Tables that are written to be read again: they cut plans and lineage, and hold masked values only."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of this machine only where there is none."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="sieveline-")
            atexit.register(shutil.rmtree, _own[app], True)
        given = _own[app]
    return given.rstrip("/")


def held(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back. The table lives until release()."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that was held. Call it when no relation is read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
