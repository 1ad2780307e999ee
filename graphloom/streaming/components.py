"""Components of a graph whose edges arrive as a stream: each micro-batch joins old labels with its own edges only.

The labels of the last two batches stand in a folder, one folder a batch, so a stream that starts anew goes on from what its checkpoint has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.algorithms import incremental_components
from ..plans.lineage import delete


class StreamingComponents:
    """Labels after the batches so far; a batch that runs again reads the labels before it and writes the same."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _batches(self) -> list[int]:
        """Numbers of the batches whose labels were written whole, ascending."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName()[6:]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def labels(self, before: int | None = None) -> DataFrame:
        """Labels after the last batch, or after the last one below a number."""
        done = [n for n in self._batches() if before is None or n < before]
        return self.spark.read.parquet(f"{self.folder}/batch={done[-1]}") if done else self.spark.createDataFrame([], "id long, label long")

    def update(self, batch: DataFrame, number: int) -> None:
        edges = batch.select("src", "dst").where("src is not null and dst is not null").persist()
        incremental_components(self.labels(number), edges).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        edges.unpersist()
        for old in self._batches():
            if old < number - 1:
                delete(self.spark, f"{self.folder}/batch={old}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
