"""Cutting the lineage of iterative plans through the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a folder of our own on a local master, as in tests; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="shared-"))
    return f"file://{_own[0]}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again; a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder through the file system that its path names."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame that cut() made and nothing reads any more; any other frame is left alone."""
    if path := getattr(df, "_path", None):
        delete(df.sparkSession, path)
