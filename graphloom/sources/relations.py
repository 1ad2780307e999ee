"""Tables of strings: folders of CSV files with a header, one table a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary
from .workspace import valid_name


def read_relations(spark: SparkSession, paths: dict[str, str], sep: str = ",") -> dict[str, DataFrame]:
    return {name: spark.read.csv(path, sep=sep, header=True, inferSchema=False) for name, path in paths.items()}


def read_folder(spark: SparkSession, folder: str, sep: str = ",") -> dict[str, DataFrame]:
    """Every file (or folder of parts) of a folder as a table of strings, by its name up to the first dot."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(at))
    return read_relations(spark, {valid_name(n): f"{folder}/{n}" for n in names if n[0] not in "._"}, sep)


def write_folder(tables: dict[str, DataFrame], folder: str, sep: str = ",") -> None:
    """CSV with a header, a folder of parts for each table."""
    for name, table in tables.items():
        strings(table).write.mode("overwrite").csv(f"{folder}/{name}", sep=sep, header=True)


def write_binary(tables: dict[str, DataFrame], folder: str) -> None:
    """Cells of fixed width, a folder of files for each table."""
    for name, table in tables.items():
        binary.write_table(table, folder, name)


def read_binary(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: binary.read_table(spark, folder, name) for name in names}


def strings(table: DataFrame) -> DataFrame:
    """Every column as a string."""
    return table.select([F.col(f"`{c}`").cast("string").alias(c) for c in table.columns])


def write_relations(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet, one folder a table."""
    for name, table in tables.items():
        strings(table).write.mode("overwrite").parquet(f"{path}/{name}")


def replace_separator(spark: SparkSession, path: str, to: str, old: str = "\t", new: str = " ", files: int | None = None) -> None:
    table = spark.read.csv(path, sep=old, inferSchema=False)
    (table.coalesce(files) if files else table).write.mode("overwrite").csv(to, sep=new)
