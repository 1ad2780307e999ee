"""Written tables in the folder that all executors share (spark.checkpoint.dir), held by the run that needs them."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import delete, shared_folder


_open: set[Store] = set()


class Store:
    """The tables of one run.  They stay until release(), for results may still read them, or until the driver ends; no store touches another's."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._tables = spark, set(), set()
        _open.add(self)

    def place(self, name: str) -> str:
        path = f"{shared_folder(self.spark)}/llm-{name}-{uuid.uuid4().hex}"
        self._paths.add(path)
        return path

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """The rows of df as a table, read again: cuts the lineage and survives lost executors."""
        path = self.place(name)
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def bucketed(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """The rows of df as a table bucketed by key without a shuffle, so that joins by it move only the other side.

        Spark knows buckets from its catalog alone.  Where the session may not write that, the table is a plain one and
        joins move it too: the same rows at the price of a shuffle.
        """
        table, path = f"{name}_{uuid.uuid4().hex}", self.place(name)
        try:
            self.spark.sql(f"create table {table} ({df.schema.toDDL()}) using parquet options (compression 'zstd') clustered by ({key}) into {buckets} buckets location '{path}'")
        except PySparkException:
            return self.written(df, name)
        self._tables.add(table)
        df.write.insertInto(table)
        return self.spark.table(table)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that written() made and nothing reads any more; any other frame is left alone."""
        if (path := getattr(df, "_path", None)) in self._paths:
            delete(self.spark, path)
            self._paths.discard(path)

    def release(self) -> None:
        """Deletes all tables of this run; call it once its result has been read or written."""
        for table in list(self._tables):
            with contextlib.suppress(PySparkException):
                self.spark.sql(f"drop table if exists {table}")
        for path in list(self._paths):
            delete(self.spark, path)
        self._tables.clear()
        self._paths.clear()
        _open.discard(self)


@atexit.register
def _close() -> None:
    """What nobody released goes with the driver, if its session still lives."""
    for store in list(_open):
        with contextlib.suppress(Exception):
            if store.spark.sparkContext._jsc is not None:
                store.release()
